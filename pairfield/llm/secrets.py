"""Secret scanning with corpus-wide ownership frequency; DataFrame operations only.

Candidates are the matches of a few expressions, leftmost and non-overlapping for each kind: three
base kinds and further credential forms. Each candidate's value is hashed, and for each hash the
distinct owners and repositories that have it are counted. A value that several owners share, or two
owners in many repositories, is a copied example; what belongs to one owner, however often, or to few
looks live. Base matches are always reported; matches of the further forms where they look live.

Positions are code points: the text splits at the matches, so a match starts where the lengths of
the gaps and matches before it end. A null text counts as empty; a null owner is an owner of its
own. Texts are scanned whole, however long. Repeated rows each have their result, and count once for
ownership if their ids are equal. An empty table gives an empty result. Names of other columns don't
matter; masked() returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialised

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, expression, group of the value, least length of the value; shorter runs can't match where the expression itself counts.
BASE = (("assign", _ASSIGN, 2, 6), ("access", "(AKIA[A-Z0-9]{16,})", 1, 20), ("hex", "([0-9a-f]{24,})", 1, 24))
FURTHER = (
    ("vendor", "(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", 1, 14),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 20),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[ \n\r]*([A-Za-z0-9+/=]{16,})", 1, 16),
)
KINDS = BASE + FURTHER
#: A value of this many owners or more is a copied example, and one of two owners that is in this many repositories or more.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
MASK = "[SECRET]"


def _found(text: Column) -> Column:
    """All matches of all kinds in a text: kind number, place among its kind, length of the gap before, and the match."""
    def of(kind: int, regex: str) -> Column:
        matches, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
        pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"))
        return F.when(text.rlike(regex), F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), x["m"].alias("found"))))

    none = F.array().cast("array<struct<kind:int,gap:int,found:string>>")
    return F.concat(*[F.coalesce(of(k, regex), none) for k, (_, regex, _, _) in enumerate(KINDS)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """row, doc_id, kind (number), start, stop and hash of each match that is long enough, with owners and live; one row without a kind for a document that has none.

    One scan of the texts; what follows is a few short rows for each match.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(docs[id_col], text).alias("key"),
        docs[id_col].cast("long").alias("doc_id"),
        docs[owner_col].cast("string").alias("owner"),
        docs[repository_col or id_col].cast("string").alias("repository"),
        _found(text).alias("all"),
    )
    rows = materialised(scanned.select("row", "key", "doc_id", "owner", "repository", F.posexplode_outer("all").alias("place", "m")).select("row", "key", "doc_id", "owner", "repository", "place", "m.kind", "m.gap", "m.found"))
    before = W.partitionBy("row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.where("kind IS NOT NULL").withColumn("stop", F.sum(F.col("gap") + F.length("found")).over(before)).withColumn("start", F.col("stop") - F.length("found"))
    value = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("found", regex, group)) for k, (_, regex, group, _) in enumerate(KINDS)])
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, (*_, n) in enumerate(KINDS)])
    kept = placed.withColumn("value", value).where(F.length("value") >= least).withColumn("hash", F.sha2("value", 256))
    matches = kept.select("row", "key", "doc_id", "owner", "repository", "kind", "start", "stop", "hash")
    live = matches.join(ownership(matches), "hash").withColumn("live", ~copied(F.col("owners"), F.col("repositories")))
    columns = ["row", "key", "doc_id", "kind", "start", "stop", "hash", "owners", "repositories", "live"]
    empty = {c: F.lit(None).cast(t) for c, t in live.select(columns).dtypes}
    # each document's first row, or the one row of a document without matches, stands for the document
    heads = rows.where("place IS NULL OR place = 0").select(*[F.col(c) if c in ("row", "key", "doc_id") else empty[c].alias(c) for c in columns])
    return live.select(columns).unionByName(heads)


def copied(owners: Column, repositories: Column) -> Column:
    """Whether a value with so many distinct owners and repositories is a copied example."""
    return (owners >= EXAMPLE_OWNERS) | ((owners > 1) & (repositories >= EXAMPLE_REPOSITORIES))


def ownership(matches: DataFrame) -> DataFrame:
    """hash, owners and repositories: in how many distinct ones each value occurs.

    Counted level by level, so that no task gets a common value's rows together. The grouping keeps
    a part of the hash beside it: a join on the hash alone then deals both sides out anew, and
    Spark can split a common value's partition.
    """
    named = matches.select("hash", F.substring("hash", 1, 2).alias("part"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    by_repository = named.groupBy("hash", "part", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "part", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash", "part").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")).drop("part")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base matches, digests of base and all reported spans, how many matches look live and how many are copied examples, and the most owners and repositories that a match has (0: no match), of each row that candidates() scanned."""
    base = len(BASE)
    span = F.when((F.col("kind") < base) | F.col("live"), F.struct("start", "kind", "stop"))
    rows = found.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"most_{c}") for c in ("owners", "repositories")],
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.filter("all", lambda x: x["kind"] < base)), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_live", "n_example", "most_owners", "most_repositories")


def masked(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every live-looking match in the text replaced by MASK (and length_col brought up to date); other rows and columns as they are.

    Only ids and places are joined to the texts, by id and a hash of id and text; equal rows share them.
    """
    key, id_, cuts_ = fresh(docs, "key", "id", "cuts")
    live = found.where("live").dropDuplicates(["key", "doc_id", "kind", "start"])
    earlier = W.partitionBy("key", "doc_id").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    cuts = live.withColumn("done", F.coalesce(F.max("stop").over(earlier), F.lit(0))).groupBy(F.col("key").alias(key), F.col("doc_id").alias(id_)).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "done", "stop"))).alias(cuts_))
    text = docs[text_col]
    part = F.transform(cuts_, lambda x: F.when(x["start"] >= x["done"], F.concat(F.substring(text, x["done"] + 1, x["start"] - x["done"]), F.lit(MASK))).otherwise(F.lit("")))
    last = F.array_max(F.transform(cuts_, lambda x: x["stop"]))
    new = F.when(F.col(cuts_).isNull(), text).otherwise(F.concat(F.concat_ws("", part), F.substring(text, last + 1, F.length(text))))
    same = (F.xxhash64(docs[id_col], F.coalesce(text, F.lit(""))) == cuts[key]) & docs[id_col].cast("long").eqNullSafe(cuts[id_])
    keyed = docs.join(cuts, same, "left").withColumn(text_col, new)
    if length_col in docs.columns:
        keyed = keyed.withColumn(length_col, F.when(F.col(cuts_).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return keyed.select(docs.columns)


def _duck(name: str, regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def sql() -> str:
    """DuckDB SQL for report(candidates(documents))."""
    each = " UNION ALL ".join(
        f"""SELECT r, doc_id, owner, {k} AS kind, {least} AS least, {group} AS g, {_duck(name, regex)} AS re, regexp_extract_all(t, {_duck(name, regex)}) AS m, string_split_regex(t, {_duck(name, regex)}) AS gap FROM d"""
        for k, (name, regex, group, least) in enumerate(KINDS)
    )
    value = "CASE kind " + " ".join(f"WHEN {k} THEN regexp_extract(x, {_duck(name, regex)}, {group})" for k, (name, regex, group, _) in enumerate(KINDS)) + " END"
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, *_) in enumerate(KINDS)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
a AS ({each}),
e AS (SELECT r, doc_id, owner, kind, least, m[i] AS x, CAST(list_sum(list_transform(gap[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: length(z))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0)),
v AS (SELECT *, {value} AS val FROM e),
c AS (SELECT r, doc_id, owner, kind, s, s + length(x) AS f, sha256(val) AS h FROM v WHERE length(val) >= least),
o AS (SELECT h, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repositories FROM c GROUP BY h),
l AS (SELECT c.*, owners, repositories, NOT (owners >= {EXAMPLE_OWNERS} OR owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES}) AS live, {names} || ':' || s || ':' || f AS span FROM c JOIN o USING (h)),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners, max(repositories) AS most_repositories,
             string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS b, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)} OR live) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN g USING (r)"""
