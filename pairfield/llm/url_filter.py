"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over a URL (host, path and query) together with literal tokens that
any matching URL has: host labels `h:`, whole path segments `p:`, words (runs of letters and digits)
`w:`. Each rule stands in the index under that one of its tokens which is rarest in the URLs at hand;
a URL's tokens fetch its candidate rules, and only their expressions run. Host rules (a host, all its
subdomains, a path prefix) decide by the longest rule; a URL that none fits is blocked by a matching
pattern rule, and is allowed otherwise.

The index is a fixed table in the plan, in buckets by hash, so a URL is judged where it is read, in
one narrow stage; rules come as a tuple, which bounds them.

A null URL, or one without `://`, has an empty host and path, no rule, and is allowed. URLs of any
length are judged whole. Every row is judged by itself, so repeated rows repeat results, and an empty
table gives an empty one; only the id and the url are read, so names of other columns don't matter.
Among equally long fitting rules (which then are the same rule) and among patterns the first given wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; name: what is reported; regex: over host and path, of a pattern rule over lower-cased host, path and query; tokens: literals of every match; host_rule: whether it decides before patterns."""

    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    host_rule: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """The rule for a host with all its subdomains and a path prefix, given as host/path."""
    host, slash, path = rule.partition("/")
    whole = (slash + path).split("/")[1:-1]  # the last segment may go on in the URL
    tokens = tuple(f"h:{x}" for x in host.split(".")) + tuple(f"p:{x}" for x in whole if x)
    return Rule(verdict, rule, r"(?s)\A(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tokens)


def pattern(name: str, regex: str, *words: str) -> Rule:
    """The pattern rule that blocks what regex finds in lower-cased host, path and query; words are in every match, each bounded by other characters."""
    return Rule("block", name, regex, tuple(f"w:{w}" for w in words), host_rule=False)


def spam_word(word: str) -> Rule:
    """Blocks hosts with a word, alone or beside hyphens and digits, in one of their labels."""
    return pattern(f"host:{word}", rf"\A(?:[^/?]*[^a-z0-9/?])?{word}(?:[^a-z0-9]|\z)", word)


def page_kind(*segments: str) -> Rule:
    """Blocks paths with the segments, one after the other."""
    path = "/".join(segments)
    return pattern(f"path:{path}", rf"\A[^/?]*/(?:[^?]*/)?{re.escape(path)}(?:[/?.]|\z)", *[w for x in segments for w in re.findall("[a-z0-9]+", x)])


def parameter(name: str, value: str = "") -> Rule:
    """Blocks queries with a parameter, of any value or of one."""
    ends = rf"{re.escape(value)}(?:[&;]|\z)" if value else ""
    return pattern(f"query:{name}={value}", rf"\?(?:[^#]*[&;])?{re.escape(name)}={ends}", *re.findall("[a-z0-9]+", f"{name}={value}"))


#: The rules of the registered query, and the pattern rules that judge what they leave: spam, pages that are no text, endless variants of a page.
RULES = (host_rule("block", "com/en/"), host_rule("allow", "example.com/en/7"), host_rule("allow", "net/de/"), host_rule("block", "example.net/de/8"), host_rule("block", "org/es/"))
SPAM_WORDS = ("spam", "casino", "casinos", "poker", "betting", "slots", "jackpot", "pills", "viagra", "cialis", "pharmacy", "payday", "replica", "porn", "xxx", "escort", "warez", "torrent", "keygen", "adserver", "doubleclick")
PAGE_KINDS = (("wp-login",), ("wp-admin",), ("cgi-bin",), ("login",), ("signin",), ("logout",), ("register",), ("cart",), ("checkout",), ("feed", "comments"), ("user", "password"), ("index", "of"))
PARAMETERS = (("replytocom", ""), ("sessionid", ""), ("phpsessid", ""), ("jsessionid", ""), ("action", "edit"), ("action", "history"), ("do", "diff"), ("add-to-cart", ""), ("share", "email"), ("format", "print"))
PATTERNS = (*map(spam_word, SPAM_WORDS), *[page_kind(*x) for x in PAGE_KINDS], *[parameter(*x) for x in PARAMETERS])


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def subject(url: Column, host: Column, path: Column) -> Column:
    """Host, path and query."""
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)", 1)
    return F.concat(host, path, F.when(F.instr(url, "://") > 0, query).otherwise(F.lit("")))


def tokens_of(host: Column, path: Column, whole: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    words = F.transform(F.regexp_extract_all(F.translate(whole, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(labels, segments, words, F.array(F.lit("*"))))


def _fixed(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _index(tokens: list[str]) -> Callable[[Column], Column]:
    """A function from a token to the ranks of the rules that stand under it (tokens[rank])."""
    size = 1 << max(0, (len(tokens) - 1).bit_length())
    buckets: list[list[int]] = [[] for _ in range(size)]
    for rank, token in enumerate(tokens):
        buckets[xxhash.xxh64_intdigest(token.encode(), 42) % size].append(rank)
    held = F.array(*[F.array(*map(F.lit, b)).cast("array<int>") for b in buckets])
    return lambda token: F.filter(F.get(held, F.pmod(F.xxhash64(token), F.lit(size)).cast("int")), lambda r: F.get(_fixed(tokens, "string"), r) == token)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (of the pattern rule that blocked) of each row of pages."""
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.select("page_id", "host", "path", F.coalesce(subject(F.col("url"), F.col("host"), F.col("path")), F.lit("")).alias("whole"))
    tokened = parsed.withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("whole")))

    # the rarest token of each rule, by the URLs themselves; only tokens of rules are counted
    given = sorted({t for r in (*rules, *patterns) for t in r.tokens})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in given], "token string"))  # as many as the rules have
    counted = tokened.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    often = {r["token"]: r["count"] for r in counted.collect()}  # one row for each token of a rule

    # rank: patterns in order, then host rules by length; the highest that fits decides
    ranked = [*reversed(patterns), *sorted(reversed(rules), key=lambda r: len(r.name))]
    fetch = _index([min(r.tokens, key=lambda t: (often.get(t, 0), t), default="*") for r in ranked])
    lower = F.translate("whole", _UPPER, _LOWER)
    seen = lambda r: F.when(F.get(_fixed([x.host_rule for x in ranked], "boolean"), r), F.concat("host", "path")).otherwise(lower)
    candidates = F.flatten(F.transform("tokens", fetch))
    fits = F.filter(candidates, lambda r: F.rlike(seen(r), F.get(_fixed([x.regex for x in ranked], "string"), r)))
    judged = tokened.select("page_id", "host", "path", F.array_max(fits).alias("best"))
    of = lambda values, kind: F.get(_fixed(values, kind), F.col("best"))
    by_host = of([r.host_rule for r in ranked], "boolean")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(by_host, of([r.name for r in ranked], "string")).alias("rule"),
        F.coalesce(of([r.verdict for r in ranked], "string"), F.lit("allow")).alias("verdict"),
        F.when(~by_host, of([r.name for r in ranked], "string")).alias("pattern"),
    )


#: DuckDB SQL for judge() with RULES and PATTERNS over the table pages.
SQL = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) ELSE '' END AS query FROM p),
r(decision, name) AS (VALUES {", ".join(f"('{r.verdict}', '{r.name}')" for r in RULES)}),
f AS (SELECT n, decision, name, row_number() OVER (PARTITION BY n ORDER BY length(name) DESC) AS k
      FROM u JOIN r ON (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1))) AND starts_with(path, substr(name, instr(name, '/')))),
b(i, name, re) AS (VALUES {", ".join(f"({i}, '{r.name}', '{r.regex}')" for i, r in enumerate(PATTERNS))}),
q AS (SELECT n, arg_min(name, i) AS pattern FROM u JOIN b ON regexp_matches(translate(host || path || query, '{_UPPER}', '{_LOWER}'), re) GROUP BY n)
SELECT page_id, host, path, f.name AS rule, coalesce(decision, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN f.name IS NULL THEN pattern END AS pattern
FROM u LEFT JOIN f ON u.n = f.n AND k = 1 LEFT JOIN q ON u.n = q.n"""
