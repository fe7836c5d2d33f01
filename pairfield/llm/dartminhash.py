"""Near-duplicate documents: DartMinHash signatures, a banded join, exact checks and components.

Darts: each element of a weighted set owns the strip from 0 to its weight. The plane over it (weight
by rank) is ruled in unit cells; hashing says how many darts fall in a cell and where. A dart below
the element's weight counts for the set, and each of K coordinates keeps the counting dart of least
rank. Only ranks below a cut that K coordinates need on average are thrown, more if one stays empty,
so a set costs about K log K + n darts instead of K n. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity.

A text is the weighted set of its word shingles, each with the number of its occurrences as weight,
so a line repeated in one text and not in the other counts as often as it does; similarity is
generalised Jaccard, the sum of smaller weights over that of larger ones. Exact checks compare plain
sets of (shingle, number of the occurrence), which says the same.

Texts are equal if their normalised words are; each distinct text is a node. Nodes whose signatures
agree in a band share a bucket. A bucket never becomes all pairs: its members are compared with one
of them (the leader), exactly, by their word shingles, and links join components. Nodes that some
bucket still has in different components meet again, exactly: two sets of the threshold share one
of their rarest shingles, so these are the second buckets, and a passage that many documents have
brings none together. What these have in different components is compared in rounds of leaders,
and all of it as soon as the pairs are no more than a few for each member, or after ROUNDS rounds in
as many passes as that takes. So no two texts that share a bucket and are similar enough stay in
different classes. Buckets with many members, which are few by their number, are dealt out by node too.

Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased; a shingle
is five words, or all words of a shorter text. Texts without words are copies of each other. Rows
of equal doc_id are one document, in the classes of all its texts; rows without an id are documents
of their own and have no class. An empty table gives an empty result; only the id and the text are
read, so names of other columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import least_labels
from .common import IdFilter, batch_of, fresh, materialised, removed, scratch, small_batches

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares none of 20 bands of 5 with probability 0.0004.
BANDS, ROWS = 20, 5
#: Pairs for each document that are compared at once after the first round.
PAIRS_A_NODE = 64
#: Nodes from which a shingle counts as frequent.
OFTEN = 32
#: Rounds of leaders before what is left is compared in passes.
ROUNDS = 6
#: A bucket is hot from so many members on, and from so large a share of all of them that HOT_BUCKETS at most can be; its members are dealt to SALTS tasks.
HOT_MEMBERS, HOT_BUCKETS, SALTS = 512, 50_000, 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = 1 << 20
#: Byte to byte: lower-cased letters, digits and bytes beyond ASCII stay, all others become spaces.
_WORDS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with all bits depending on all bits of x (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _share(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Shingles:
    """Hashes of the word shingles of texts, by differences of a running polynomial."""

    def __init__(self, words: int = SHINGLE):
        self.words = words
        base = np.full(_BYTES * 2, _BASE, np.uint64)
        base[0] = 1
        self.power = np.multiply.accumulate(base)
        base[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(base)

    def line(self, text: str | None) -> bytes:
        """The normalised words of a text, with single spaces."""
        return b" ".join((text or "").encode().translate(_WORDS).split())

    def __call__(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of normalised words, ascending, and how often each occurs."""
        found, start = [], 0
        while len(line) - start > len(self.power) - 1:
            stop = line.rfind(b" ", start, start + len(self.power) - 1)
            again = stop
            for _ in range(self.words - 1):
                again = line.rfind(b" ", start, again) if again > start else -1
            if stop <= start or again <= start:  # words of megabytes: hashed whole, one shingle at a time
                return self._slow(line)
            found.append(self._of(line[start:stop]))
            start = again + 1
        found.append(self._of(line[start:]))
        return np.unique(np.concatenate(found) if len(found) > 1 else found[0], return_counts=True)

    def _of(self, line: bytes) -> np.ndarray:
        if not line:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(line, np.uint8)
        spaces = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * self.power[: len(data)], dtype=np.uint64)])
        k = min(self.words, len(starts))
        s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
        return mixed((running[e] - running[s]) * self.inverse[s] + (e - s).astype(np.uint64))

    def _slow(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = line.split()
        k = min(self.words, len(words))
        return np.unique(np.array([int.from_bytes(blake2b(b" ".join(words[i : i + k]), digest_size=8).digest(), "little") for i in range(len(words) - k + 1)], np.uint64), return_counts=True)


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A plain set, ascending, for a weighted one: each element as often as it counts, told apart by number."""
    each = np.repeat(elements, counts)
    place = (np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    return np.unique(np.where(place == 0, each, mixed(each + place * np.uint64(_BASE))))


class DartMinHash:
    """Signatures of weighted sets."""

    def __init__(self, k: int = BANDS * ROWS, seed: int = 1):
        self.k, self.seed = k, np.uint64(seed)
        self.darts = k * np.log(max(k, 2)) + 2 * k
        chances = np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)]))
        self.up_to = np.cumsum(chances)  # of a Poisson count with mean 1, a cell's area

    def __call__(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The k values of a set of 64-bit elements (all 0 for an empty one); weights are positive, by default 1."""
        if not len(elements):
            return np.zeros(self.k, np.uint32)
        weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
        rows = np.ceil(weights).astype(np.int64)
        element, weight = np.repeat(elements, rows), np.repeat(weights, rows)
        row = np.arange(len(element)) - np.repeat(np.cumsum(rows) - rows, rows)
        cut = self.darts / weights.sum()
        while True:
            signature, full = self._thrown(element, weight, row, cut)
            if full:
                return signature
            cut *= 2

    def _thrown(self, element: np.ndarray, weight: np.ndarray, row: np.ndarray, cut: float) -> tuple[np.ndarray, bool]:
        columns = int(np.ceil(cut))
        column = np.tile(np.arange(columns), len(element))
        one_by_one = np.repeat(np.arange(len(element)), columns)
        cell = mixed(element[one_by_one] + self.seed * np.uint64(_BASE) + mixed((row[one_by_one].astype(np.uint64) << np.uint64(32)) + column.astype(np.uint64)))
        n = np.searchsorted(self.up_to, _share(cell), "right")
        of = np.repeat(np.arange(len(cell)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        dart = mixed(cell[of] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        second = mixed(dart + np.uint64(_BASE))
        rank = column[of] + _share(second)
        height = row[one_by_one][of] + _share(mixed(second + np.uint64(_BASE)))
        counts = np.flatnonzero((rank < cut) & (height < weight[one_by_one][of]))
        latest_first = counts[np.argsort(-rank[counts], kind="stable")]
        coordinate = (dart[latest_first] % np.uint64(self.k)).astype(np.int64)
        signature, seen = np.zeros(self.k, np.uint32), np.zeros(self.k, bool)
        signature[coordinate] = (dart[latest_first] >> np.uint64(32)).astype(np.uint32)  # the last written has the least rank
        seen[coordinate] = True
        return signature, bool(seen.all())


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit hash for each band of a signature; different bands have different hashes."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        out = mixed(out * np.uint64(_BASE) + rows[:, i] + np.uint64(1))
    return out.view(np.int64)


def _signed(docs: DataFrame, path: str) -> DataFrame:
    """Writes and returns, for each row of docs (doc_id, text): doc_id, key (of its normalised words) and bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, darts = Shingles(), DartMinHash()
        for batch in batches:
            keys, bands = [], []
            for text in batch.column(1):
                line = shingles.line(text.as_py())
                hashes, counts = shingles(line)
                keys.append(blake2b(line, digest_size=16).digest())
                bands.append(bands_of(darts(hashes, counts)).tolist() if len(hashes) else [])
            yield batch_of(schema, doc_id=batch.column(0), key=keys, bands=bands)

    docs.mapInArrow(run, "doc_id long, key binary, bands array<long>").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _shingled(docs: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Writes and returns node and shingles (ascending 64-bit hashes) of each different text of the documents of nodes.

    Texts are read again rather than kept for all documents; a filter of bounded size passes over
    most of the others, and the join of the hashes removes the rest. For more ids than the filter
    can tell apart the texts themselves are joined with them first.
    """
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    nodes = materialised(nodes)
    ids = IdFilter(nodes, "node")
    table, test = ids.table, ids.test

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            batch = batch.filter(pa.array(test(table.value, batch.columns[2:]), pa.bool_()))
            found = [occurrences(*shingles(shingles.line(t.as_py()))).tobytes() for t in batch.column(1)]
            yield batch_of(schema, node=batch.column(0), shingles=found)

    texts = docs.select("doc_id", "text")
    if ids.full:
        texts = texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    made = texts.select("doc_id", "text", *ids.places("doc_id")).mapInArrow(run, "node long, shingles binary")
    made = made if ids.full else made.join(nodes, "node", "left_semi")
    made.dropDuplicates(["node", "shingles"]).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def hot(counts: DataFrame) -> DataFrame:
    """The hot ones of buckets (bucket, n members): HOT_BUCKETS at most, so they can go to all tasks."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return materialised(counts.where(F.col("n") >= max(HOT_MEMBERS, total // HOT_BUCKETS)).select("bucket", F.lit(True).alias("hot")), 1)


def dealt(many: DataFrame, others: DataFrame, hot: DataFrame, on: tuple[str, ...] = (), node: str = "node") -> DataFrame:
    """The inner join of many and others by bucket (and the columns of on); rows of many in hot buckets are dealt out by node as well, with a copy of the others for each part."""
    marked = many.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(node), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = others.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.explode(copies)).drop("hot")
    return marked.join(copied, ["bucket", "salt", *on]).drop("salt")


def _rare_shingles(shingles: DataFrame, threshold: float) -> DataFrame:
    """node and bucket for each of the rarest shingles of a node, as many as two sets of the threshold must share one of; with n, the size of its set, s, how many shingles it can have in common with a node whose rarest common shingle this is, and short, whether the shingle is among the fewer that the smaller of two similar sets must share.

    Rarity is counted over the given nodes. A passage that many documents have comes last in every
    set and brings none of them together. A shingle that no other node has is common to no two; and
    if the rarest common shingle is a frequent one, then all common ones are.
    """
    schema = pa.schema([("node", pa.int64()), ("text", pa.int64()), ("size", pa.int64()), ("bucket", pa.int64())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(x.as_py(), np.int64)
                yield batch_of(schema, node=np.full(len(found), node), text=np.full(len(found), crc32(found)), size=np.full(len(found), len(found)), bucket=found)

    each = shingles.select("node", "shingles").mapInArrow(single, "node long, text long, size long, bucket long")
    often = materialised(each.groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.count("*").alias("n")).where("n > 1").drop("part"))
    of_text = W.partitionBy("node", "text")
    known = F.count("*").over(of_text)
    place = F.col("size") - known + F.row_number().over(of_text.orderBy("often", "bucket"))  # shingles of one text alone come first
    ranked = dealt(each, often.withColumnRenamed("n", "often"), hot(often)).select("node", "bucket", F.col("size").alias("n"), known.alias("known"), F.count_if(F.col("often") >= OFTEN).over(of_text).alias("frequent"), place.alias("place"), "often")
    first = lambda share: F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    return ranked.where(first(threshold)).select("node", "bucket", "n", F.when(F.col("often") < OFTEN, F.col("known")).otherwise(F.col("frequent")).alias("s"), first(2 * threshold / (1 + threshold)).alias("short"))


def _possible(shared: DataFrame, threshold: float) -> DataFrame:
    """The members of buckets that can be similar to some other member at all.

    A set of n shingles, s of them common at most, is similar to no member of its bucket by more than
    s / (n + max(0, smallest - s)), for the smallest set of the bucket.
    """
    smallest = materialised(shared.groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.min("n").alias("smallest"), F.count("*").alias("n")).drop("part"))
    most = F.col("s") / (F.col("n") + F.greatest(F.col("smallest") - F.col("s"), F.lit(0)))
    return dealt(shared, smallest.select("bucket", "smallest"), hot(smallest)).where(most >= threshold - 1e-9).drop("smallest")


def similar(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of threshold or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if small and small >= threshold * large else 0
                keep.append(large > 0 and common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(schema)

    one = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of each node of edges (a, b)."""
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    return least_labels(both, both.count()).withColumnRenamed("root", "label")


def _part(c: Column) -> Column:
    """A function of a key that stands beside it in a grouping, so that a later join on the key alone deals both sides out and can split a common key."""
    return F.hash(c) % 64


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of each row of docs with an id."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL")
    signed = _signed(docs, scratch(spark, "signatures"))
    texts = materialised(signed.groupBy("key", _part(F.col("key")).alias("part")).agg(F.min("doc_id").alias("node")).select("key", "node"))
    firsts = signed.select("doc_id", "key", "bands").join(texts.select(F.col("node").alias("doc_id"), "key"), ["doc_id", "key"])
    members = firsts.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    sizes = materialised(members.groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.count("*").alias("n")).where("n > 1").drop("part"))
    crowded = hot(sizes)
    shared = _led(materialised(dealt(members, sizes, crowded).select("bucket", "node", "n")), crowded)
    held = scratch(spark, "shingles")
    shingles = _shingled(docs, shared.select("node").distinct(), held)

    # first round: every member of a bucket with its leader
    led = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialised(similar(led, shingles, threshold))
    labels = components(edges)
    # what a bucket still has apart meets again in the rare shingles that similar sets must share
    left = _apart(shared.select("bucket", "node"), labels, crowded).select("node").distinct()
    rare = materialised(_rare_shingles(materialised(shingles.join(left, "node", "left_semi")), threshold))
    for _ in range(2):  # what leaves makes room for more to leave
        rare = materialised(_possible(rare, threshold))
    edges = _linked_apart(rare, labels, edges, shingles, threshold, PAIRS_A_NODE * signed.count())
    removed(spark, held)

    same = signed.select("doc_id", "key").join(texts, "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    # a document of several texts joins their classes; a document of one text has the class of its node
    several = signed.groupBy("doc_id").agg(F.count_distinct("key").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    named = components(edges.union(same.join(several, "a", "left_semi").select("a", "b")))
    placed = signed.select("doc_id", "key").join(texts, "key").select("doc_id", "node")
    own = placed.join(named.select(F.col("node").alias("doc_id"), F.col("label").alias("own")), "doc_id", "left")
    return own.join(named, "node", "left").select("doc_id", F.coalesce("own", "label", "node").alias("class_id"))


def _linked_apart(shared: DataFrame, labels: DataFrame, edges: DataFrame, shingles: DataFrame, threshold: float, budget: int) -> DataFrame:
    """edges with every similar pair that shares a bucket of shared (bucket, node, n, s, short) and lies in different components, or a path between them.

    Up to budget pairs, a number proportional to the documents, are compared at once.
    """
    tested, crowded = None, hot(shared.groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.count("*").alias("n")).drop("part"))
    for done in itertools.count():
        left = materialised(_apart(shared.select("bucket", "node"), labels, crowded))
        counts = left.agg(F.count("*").alias("members"), F.sum("others").alias("pairs")).first()
        if not counts["members"]:
            return edges
        if counts["pairs"] <= 2 * budget or done == ROUNDS:
            known = materialised(left.select("bucket", "node", "label").join(shared, ["bucket", "node"]))
            small, large = (known.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "s", "short")]) for x in "ab")
            common = F.least("s_a", "s_b")
            apart = (F.col("label_a") != F.col("label_b")) & (common >= (threshold - 1e-9) * (F.col("n_a") + F.col("n_b") - common))
            ordered = F.col("short_a") & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & ((F.col("node_a") < F.col("node_b")) | ~F.col("short_b"))))
            passes = math.ceil(counts["pairs"] / (2 * budget))
            for i in range(passes):
                one = small.where(F.pmod(F.xxhash64("node_a", F.lit(2)), F.lit(passes)) == i)
                pairs = dealt(one, large, crowded, node="node_a").where(apart & ordered).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
                edges = materialised(edges.union(similar(pairs, shingles, threshold)))
            return edges
        # members that have led their bucket are done; of the others the one with most company leads
        waiting = left if tested is None else left.join(tested.withColumnRenamed("by", "node"), ["bucket", "node"], "left_anti")
        company = left.groupBy("node").agg(F.sum("others").alias("company"))
        chosen = waiting.join(company, "node").groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.max(F.struct("company", "node", "label")).alias("x"))
        led = materialised(chosen.select("bucket", F.col("x.node").alias("by"), F.col("x.label").alias("lb")))
        if led.isEmpty():
            return edges
        pairs = dealt(left, led, crowded).where("label <> lb").select(F.col("by").alias("a"), F.col("node").alias("b")).distinct()
        edges = materialised(edges.union(similar(pairs, shingles, threshold)))
        tested = led.select("bucket", "by") if tested is None else materialised(tested.union(led.select("bucket", "by")))
        labels = components(edges)


def _led(shared: DataFrame, crowded: DataFrame) -> DataFrame:
    """bucket, node and leader of each member (bucket, node, n members): the member that has most company over all its buckets leads.

    Where many texts were copied from one with changes of their own, that one shares most bands and is similar to each.
    """
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = shared.join(company, "node").groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.max(F.struct("company", -F.col("node"))).alias("x"))
    leaders = leaders.select("bucket", (-F.col("x.col2")).alias("leader"))
    return materialised(dealt(shared.select("bucket", "node"), leaders, crowded))


def _apart(shared: DataFrame, labels: DataFrame, crowded: DataFrame) -> DataFrame:
    """bucket, node, label and others (members of other components in the bucket) of each member of a bucket with several components."""
    labelled = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed_buckets = by_label.groupBy("bucket", _part(F.col("bucket")).alias("part")).agg(F.count("*").alias("labels"), F.sum("n").alias("all")).where("labels > 1").drop("part", "labels")
    others = dealt(by_label, mixed_buckets, crowded, node="label").select("bucket", "label", (F.col("all") - F.col("n")).alias("others"))
    return dealt(labelled, others, crowded, ("label",)).select("bucket", "node", "label", "others")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns unchanged, whose document stands for its class, one row for each; rows without an id stay.

    Most rows stay where they are: only those that a filter of bounded size can't tell from a
    document that goes, or from one with several rows, are joined and numbered.
    """
    doubt, stays, copy = fresh(docs, "doubt", "stays", "copy")
    counted = materialised(classes.groupBy("doc_id").agg(F.max("class_id").alias("class_id"), F.count("*").alias("n")))
    doubtful = IdFilter(counted.where("doc_id <> class_id OR n > 1"), "doc_id")
    marked = docs.withColumn(doubt, doubtful.may_have(id_col))
    staying = counted.where("doc_id = class_id").select(F.col("doc_id").alias(stays))
    order = W.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")]))
    kept = marked.where(F.col(doubt)).join(staying, F.col(id_col) == F.col(stays), "left_semi").withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1)
    return kept.select(docs.columns).unionByName(marked.where(~F.col(doubt)).select(docs.columns))


__all__ = ["DartMinHash", "Shingles", "bands_of", "components", "near_duplicates", "one_of_each", "similar"]
