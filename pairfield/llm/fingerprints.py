"""Document fingerprints by consistent weighted sampling; DataFrame operations only.

Terms are overlapping shingles of five words, or all words of a shorter text, so an edit changes the
terms that contain it alone. In runs that no space splits (of more than 64 characters, or of a
script without spaces) each character counts as a word. A term's weight is the number of its
occurrences in the text. For each of K samples
a term draws r and c from Gamma(2, 1) and b from U(0, 1), by hashing; with weight S,
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). The term with the least a is the sample,
and (term, t) its code. Two texts agree in a sample with a probability that equals their generalised
Jaccard similarity, the sum of smaller weights over the sum of larger ones.

The least a of a text of weight T is exponential with rate T, so it is above DEPTH / T with
probability exp(-DEPTH); and a >= c exp(-r) / S, c >= 1 - exp(-c). Terms that this keeps above
DEPTH / T are out of a sample before its logarithms are taken.

The terms of a text become numbers, are counted within its row, and only then stand in rows of their
own; a grouping by text and term over all texts would hold many times the texts.

Neighbours in order of doc_id meet in ranges: the texts are dealt out once, by range; each range
also gets a copy of the document before it. Terms, samples and fingerprints are then made range by
range without another exchange of texts, however often a term or text occurs.

A null text counts as empty; empty texts have the fingerprint of ones and are like each other alone.
Documents of equal id follow each other by text, a null id comes lowest. A single document is its
own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, range_bounds, range_count, range_index

SAMPLES, SHINGLE = 64, 5
#: No sample of a text is as high as DEPTH over its weight, but with a probability of 2e-8, in which case its code is that of an empty text.
DEPTH = 18.0
#: Characters of words that spaces split: all but spaces, Thai, Lao, Burmese, Khmer, kana and ideographs.
_SPACED = r"[!-\x{dff}\x00-\x08\x0e-\x1f\x{f00}-\x{fff}\x{10a0}-\x{177f}\x{1800}-\x{2e7f}\x{a000}-\x{f8ff}\x{fb00}-\x{feff}\x{fff0}-\x{1ffff}\x{40000}-\x{10ffff}]"
_WORD = rf"(?>(?<!\S){_SPACED}{{1,64}}+(?!\S)|\S)"
_LOWEST = -(2**63)
_EMPTY = 2**24 - 1
#: Above every sample.
_NO = 2**63 - 1
#: Samples of a term that are made in one row; the code that Java compiles grows with it and has a limit.
AT_ONCE = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def terms_of(words: Column) -> Column:
    """The terms of an array of words, in order, as 64-bit hashes."""
    n = F.size(words)
    shingles = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n - (SHINGLE - 1), F.lit(0))) for k in range(SHINGLE)])
    hashed = F.transform(shingles, lambda x: F.xxhash64(x))
    return F.when(n >= SHINGLE, hashed).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _share(bits: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(0x1FFFFF) + F.lit(0.5)) / F.lit(float(1 << 21))


def samples(texts: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """keys and codes (of several columns codes0, codes1 ..), the array of the K sample codes of each text; no row of texts shares its keys.

    The samples are made AT_ONCE together, side by side in one row, so a term is looked up in the
    aggregation once for so many samples. A term that occurs once in the first two texts of a row
    has the same samples in both and is drawn once.
    """
    sides = range(len(columns))
    every = lambda name: [f"{name}{s}" for s in sides]
    # a projection for each step: what is used several times is then made once
    terms = texts.select(*keys, *[words_of(F.col(c)).alias(f"words{s}") for s, c in enumerate(columns)]).select(*keys, *[terms_of(F.col(f"words{s}")).alias(f"terms{s}") for s in sides])
    terms = terms.select(*keys, *every("terms"), *[F.size(f"terms{s}").alias(f"total{s}") for s in sides])
    terms = terms.select(*keys, *every("terms"), *every("total"), *[(F.size(F.array_distinct(f"terms{s}")) < F.col(f"total{s}")).alias(f"repeats{s}") for s in sides])
    # most texts repeat no term; in the others equal terms are brought together by sorting
    terms = terms.select(*keys, *[F.when(F.col(f"repeats{s}"), F.sort_array(f"terms{s}")).otherwise(F.col(f"terms{s}")).alias(f"terms{s}") for s in sides], *every("total"), *every("repeats"))

    def last(s: int) -> Column:
        return F.filter(F.sequence(F.lit(1), F.col(f"total{s}")), lambda i: (i == F.col(f"total{s}")) | (F.get(f"terms{s}", i - 1) != F.get(f"terms{s}", i)))

    def counted(s: int) -> Column:
        return F.transform(f"last{s}", lambda i, k: F.struct(F.get(f"terms{s}", i - 1).alias("h"), (i - F.when(k == 0, F.lit(0)).otherwise(F.get(f"last{s}", k - 1))).alias("n")))

    terms = terms.select(*keys, *every("terms"), *every("total"), *[F.when(F.col(f"repeats{s}"), last(s)).alias(f"last{s}") for s in sides])
    terms = terms.select(*keys, *every("terms"), *every("total"), *[F.when(F.col(f"last{s}").isNotNull(), counted(s)).alias(f"counted{s}") for s in sides])
    nothing = F.array().cast("array<struct<h:bigint,n:int>>")
    terms = terms.select(
        *keys,
        *every("total"),
        *[F.when(F.col(f"counted{s}").isNotNull(), F.transform(F.filter(f"counted{s}", lambda x: x.n == 1), lambda x: x.h)).otherwise(F.col(f"terms{s}")).alias(f"once{s}") for s in sides],
        *[F.coalesce(F.filter(f"counted{s}", lambda x: x.n > 1), nothing).alias(f"more{s}") for s in sides],
    )
    shares = len(columns) > 1
    if shares:
        terms = terms.select("*", F.array_intersect("once0", "once1").alias("both"))
        terms = terms.select(*keys, *every("total"), *every("more"), "both", *[(F.array_except(f"once{s}", "both") if s < 2 else F.col(f"once{s}")).alias(f"once{s}") for s in sides])
    single = lambda name: F.arrays_zip(F.col(name).alias("h"), F.array_repeat(F.lit(1), F.size(name)).alias("n"))
    own = [F.struct(F.lit(s).alias("of"), F.col(f"total{s}").alias("total"), F.concat(single(f"once{s}"), f"more{s}").alias("x")) for s in sides]
    # the bound on a term of two texts is that of the lighter one, which keeps more
    common = [F.struct(F.lit(-1).alias("of"), F.least("total0", "total1").alias("total"), F.concat(single("both"), nothing).alias("x"))] if shares else []
    groups = terms.select(*keys, F.explode(F.array(*own, *common)).alias("g")).select(*keys, "g.of", "g.total", "g.x")
    # a text without terms has one row, without a weight, that stands for it
    rows = groups.select(*keys, "of", "total", F.explode_outer("x").alias("x"))
    weighted = rows.select(*keys, "of", F.col("x.h").alias("h"), F.ln("x.n").alias("l"), (DEPTH * F.col("x.n") / F.col("total")).alias("most"))
    drawn = weighted.select("*", F.explode(F.array(*[F.lit(k) for k in range(0, SAMPLES, AT_ONCE)])).alias("block"))
    least = _drawn(drawn).groupBy(*keys, "of", "block").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(AT_ONCE)])
    if shares:
        mine = lambda s: F.col("of").isin(s, -1) if s < 2 else F.col("of") == s
        least = least.groupBy(*keys, "block").agg(*[F.min(F.when(mine(s), F.col(f"m{k}"))).alias(f"m{s}_{k}") for s in sides for k in range(AT_ONCE)])
    else:
        least = least.select(*keys, "block", *[F.col(f"m{k}").alias(f"m0_{k}") for k in range(AT_ONCE)])
    codes = [F.array(*[F.when(F.col(f"m{s}_{k}") != _NO, F.col(f"m{s}_{k}").bitwiseAND(0xFFFFFF).cast("int")).otherwise(F.lit(_EMPTY)) for k in range(AT_ONCE)]) for s in sides]
    parts = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *[c.alias(f"codes{s}") for s, c in enumerate(codes)]))).alias("parts"))
    return parts.select(*keys, *[F.flatten(f"parts.codes{s}").alias(f"codes{s}" if shares else "codes") for s in sides])


def _drawn(terms: DataFrame) -> DataFrame:
    """terms (h, l: ln of the weight, most, block) with m0 ..: of a sample ln a in the high bits and the code in the low 24, so the least one names the sample; _NO for a term that can't be it.

    Steps of their own again. A logarithm costs more than all else, so a term first passes the bound
    with exp(-r) alone, then the one that knows t, and only then c is made.
    """
    each = range(AT_ONCE)
    col = lambda name: (lambda k: F.col(f"{name}{k}"))
    u, v, q, d, r, y, t = map(col, "uvqdryt")
    steps = (
        ("u", lambda k: F.xxhash64("h", F.col("block") + k)),
        ("v", lambda k: F.xxhash64(u(k))),
        ("q", lambda k: _share(u(k), 0) * _share(u(k), 21)),
        ("d", lambda k: 1 - _share(u(k), 42) * _share(v(k), 0)),
        ("r", lambda k: F.when(d(k) * q(k) <= F.col("most"), -F.ln(q(k)))),
        ("y", lambda k: F.col("l") / r(k) + _share(v(k), 21)),
        ("t", lambda k: F.floor(y(k))),
    )
    for name, made in steps:
        terms = terms.withColumns({f"{name}{k}": made(k) for k in each})

    def packed(k: int) -> Column:
        over = r(k) * (t(k) + 1 - y(k))
        ln_a = F.ln(-F.ln(1 - d(k))) - over - F.col("l")
        code = F.xxhash64("h", F.col("block") + k, t(k)).bitwiseAND(0xFFFFFF)
        return F.when(d(k) <= F.col("most") * F.exp(over), F.shiftleft(((ln_a + 96) * float(1 << 32)).cast("long"), 24).bitwiseOR(code)).otherwise(F.lit(_NO))

    return terms.withColumns({f"m{k}": packed(k) for k in each})


def likeness(a: Column, b: Column) -> Column:
    """The share of equal codes of two fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(SAMPLES))


def in_hex(codes: Column) -> Column:
    """A fingerprint as a string: six hexadecimal digits for each sample."""
    return F.lower(F.concat_ws("", F.transform(codes, lambda x: F.lpad(F.hex(x), 6, "0"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return samples(rows, ["row", "doc_id"], "text").select("doc_id", in_hex(F.col("codes")).alias("fingerprint"))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs by ranges of doc_id, with place (1, 2, ... in ascending order), ghost (a copy of the document before the range) and below (the text of the document before)."""
    parts = range_count(docs, 4 * partitions(docs.sparkSession))
    bounds = range_bounds(docs, "doc_id", parts)
    keyed = docs.withColumn("part", range_index(F.col("doc_id"), bounds)).withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    tops = {r["part"]: r["key"] for r in keyed.groupBy("part").agg(F.max("key").alias("key")).collect()}  # two numbers for each range
    filled = sorted(tops)
    follows = docs.sparkSession.createDataFrame([(tops[filled[i - 1]], p) for i, p in enumerate(filled)] or [(None, 0)], "key long, part int")
    ghosts = keyed.drop("part").join(F.broadcast(follows), "key").withColumn("ghost", F.lit(True))
    both = keyed.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", "part", "key", "ghost"))
    order = W.partitionBy("part").orderBy(F.desc("ghost"), "key", "text")
    return both.withColumn("place", F.row_number().over(order)).withColumn("below", F.lag("text").over(order))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs."""
    ranged = _ranged(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("below", F.lit("")), F.lit(1), third))
    rows = ranged.select("part", "place", "ghost", "doc_id", "text", edited.alias("edited"))
    keys = ["part", "place"]
    about = rows.select(*keys, "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    order = W.partitionBy("part").orderBy("place")
    # with doc_id among the keys both uses of rows read the same columns, so Spark deals the texts out once
    made = samples(rows, [*keys, "doc_id"], "text", "edited").select(*keys, F.col("codes0").alias("text_codes"), F.col("codes1").alias("edited_codes"))
    made = made.withColumn("next_codes", F.lag("text_codes").over(order))
    found = made.select(
        *keys,
        in_hex(F.col("text_codes")).alias("fingerprint"),
        in_hex(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("text_codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("text_codes"), F.coalesce("next_codes", "text_codes")).alias("near_next"),
    )
    return about.join(found, keys).where(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
