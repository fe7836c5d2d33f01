"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

A-Z are lower-cased and words are runs of ASCII letters, digits and all characters beyond ASCII. A
window is `window` consecutive words of an item; an item of fewer words, but not none, is one
window. The automaton's letters are numbers of the benchmark's words, so it has at most `window`
states for each word of the benchmark; a text is read once, as numbers of its words (0 for a word
that the benchmark doesn't have). Ends of matches lead back to word numbers, and these to places in
the original text.

A worker process builds the automaton of a block once and keeps it for its next tasks; a block is
bounded by its windows, and a larger benchmark is read in blocks, with a pass each.

Null or empty texts have no words and are never contaminated; benchmark rows without words or
without an id have no windows; an empty benchmark marks nothing, and an empty table gives an empty
result. Repeated items and ids count once, repeated documents each have their row, long texts are
read whole. Names of other columns don't matter; decontaminated() returns them as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialised, small_batches

WINDOW = 10
#: Bytes of benchmark text in one automaton (about 160,000 windows, up to 200 MB in a worker); a larger benchmark is read in blocks of about this, each with its own automaton and pass.
BLOCK_BYTES = 1 << 20
#: Byte to byte: lower-cased letters, digits and bytes beyond ASCII stay, all others become spaces. Also holds for each byte of UTF-8.
_WORDS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))
_ANY = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, in UTF-8."""
    return text.encode().translate(_WORDS).split() if text else []


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each word of words_of(text) stands in text, in code points, end exclusive."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [m.span() for m in _ANY.finditer(lower)]


class Windows:
    """All windows of a benchmark in an automaton over numbers of words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(words[i : i + window], set()).add(item)
        self.sizes, self.items = list(map(len, found)), list(found.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, key in enumerate(found):
            self.automaton.add_word(key, i)
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the disjoint spans of hit words (end exclusive), and the items with a window."""
        words = words_of(text)
        if not words or not self.items:
            return len(words), [], set()
        numbers = tuple(map(self.number.get, words, repeat(0)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end, of in sorted((e + 1 - self.sizes[v], e + 1, v) for e, v in self.automaton.iter(numbers)):
            items |= self.items[of]
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
        return len(words), spans, items


#: The automaton that this process holds, by the name of its block.
_held: dict[str, Windows] = {}


def _windows(name: str, items, window: int) -> Windows:
    if name not in _held:
        _held.clear()
        _held[name] = Windows(items.value, window)
    return _held[name]


def _blocks(benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of at most about block_bytes; one block at a time is held."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[text_col].alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    held, size, any_yet = [], 0, False
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"].encode())
        if size >= block_bytes:
            yield held
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield held


def places_of(text: str | None, spans: list[tuple[int, int]]) -> list[int]:
    """Start and end, in code points of the text, of each span of words."""
    if not spans:
        return []
    words = word_offsets(text)
    return [x for start, end in spans for x in (words[start][0], words[end - 1][1])]


def _scanned(docs: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    items, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # bounded by block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, items, window)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [windows.scan(t) for t in texts]
            yield batch_of(_SCHEMA, row=batch.column(0), doc_id=batch.column(1), n_words=[r[0] for r in rows], spans=[[x for s in r[1] for x in s] for r in rows], places=[places_of(t, r[1]) for t, r in zip(texts, rows)], items=[sorted(r[2]) for r in rows])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, spans array<long>, places array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (hit words: start, end, start, end ...), places (the same in code points of the text) and items (sorted ids of items with windows) of each row.

    With one block, which is the rule, the plan is one narrow stage. With more, each block is one
    pass over the texts and the passes' few hits are put together by row.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block_bytes, item_col, item_text_col)
    numbered = docs.select(F.lit(0).cast("long").alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(numbered, first, window).drop("row")
    numbered = materialised(numbered.withColumn("row", F.monotonically_increasing_id()))
    passes = _scanned(numbered, first, window)
    while second is not None:
        passes = passes.unionByName(_scanned(numbered, second, window).where(F.size("spans") > 0))
        second = next(blocks, None)
    several = passes.select("row", "doc_id", "n_words", "items", *[_pairs(c).alias(c) for c in ("spans", "places")])
    both = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    united = several.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), both("spans").alias("spans"), both("places").alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of words that touch are one; places are joined where the spans are
    joined = united.select("row", "doc_id", "n_words", "items", _merged(F.arrays_zip(F.col("spans.s").alias("s"), F.col("spans.e").alias("e"), F.col("places.s").alias("from"), F.col("places.e").alias("to"))).alias("m"))
    flat = lambda a, b: F.flatten(F.transform("m", lambda x: F.array(x[a], x[b])))
    return joined.select("doc_id", "n_words", flat("s", "e").alias("spans"), flat("from", "to").alias("places"), "items")


def _pairs(flat: str) -> Column:
    """start, end, start, end ... as an array of pairs."""
    pair = F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, (2 * i).cast("int")).alias("s"), F.get(flat, (2 * i + 1).cast("int")).alias("e")))
    return F.when(F.size(flat) > 0, pair).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def _merged(spans: Column) -> Column:
    """Ascending spans (s, e, from, to) with those that touch by s and e put together."""
    one = "struct<s:bigint,e:bigint,from:bigint,to:bigint>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to")).cast(one)
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x.cast(one))))

    return F.aggregate(spans, F.array().cast(f"array<{one}>"), step)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has no window of the benchmark; one narrow stage for each block."""
    place = docs.columns.index(text_col)

    def clean(block):
        items, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # bounded by block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _windows(name, items, window)
            for batch in batches:
                yield batch.filter(pa.array([not windows.scan(t)[1] for t in batch.column(place).to_pylist()], pa.bool_()))

        return run

    small_batches(docs.sparkSession)
    schema = docs.schema
    for block in _blocks(benchmark, block_bytes, item_col, item_text_col):
        docs = docs.mapInArrow(clean(block), schema)
    return docs


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()'s rows, and hits: the places of hit words as start:end, comma-joined."""
    n_hit = F.aggregate(_pairs("spans"), F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    hits = F.concat_ws(",", F.transform(_pairs("places"), lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), hits.alias("hits"))


def without_hits(text: str, places: list[int]) -> str:
    """A text without its hit words, by their places."""
    starts, ends = [0, *places[1::2]], [*places[::2], len(text)]
    return "".join(text[i:j] for i, j in zip(starts, ends))


__all__ = ["Windows", "contamination", "decontaminated", "places_of", "report", "without_hits", "word_offsets", "words_of"]
