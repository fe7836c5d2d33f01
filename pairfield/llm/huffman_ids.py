"""Token ids on disk as canonical, length-limited Huffman codes in independent blocks.

Texts are encoded once, into a plain table in the shared scratch folder, and each task leaves the
counts of its ids beside them. Spark sums these; from the counts the driver makes optimal code
lengths of at most `max_len` bits by package merging, one entry at most for each id of the
vocabulary. Then the ids are dealt out by ranges of doc_id, sorted, and written as blocks of whole
documents; the plain table is removed.

A file set holds `header` (symbol, length) and `blocks`, one Parquet part for each range in
ascending order. A block has: its range and number, the ids in the range before it, the number of
ids, the codes (most significant bit first), the bits that each run of MARK ids takes (uint16) as
checkpoints, and the ids and lengths of its documents. A reader starts at any checkpoint: all runs
of a block are decoded side by side, one table look-up for each id.

Null texts are written as the end id alone. Rows with a null doc_id come first; repeated doc_ids
follow each other and keep their own ids. An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordBpe
from .common import batch_of, partitions, range_bounds, range_count, range_index, removed, scratch

END_ID = 2
MAX_LEN = 18
#: Ids in a block before it is closed, and ids from one checkpoint to the next.
BLOCK_IDS, MARK = 1 << 18, 64
#: Words whose ids a worker remembers.
ID_WORDS = 900_000
_BLOCK = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("codes", pa.binary()), ("marks", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))])
_BLOCK_DDL = "range int, block int, ids_before long, n_ids long, codes binary, marks binary, doc_ids array<long>, doc_lens array<long>"


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """The length of each symbol's code (0: count 0), optimal among codes of at most max_len bits.

    Package merging: each level is the leaves merged with the pairs of the level below; how many
    items are taken of a level follows from the packages taken of the one above.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_len:
        raise ValueError(f"{len(used)} symbols don't fit codes of {max_len} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, levels = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_len - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        levels.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = previous = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[s]):
            code <<= n - previous if previous else 0
            codes[s], previous = code, n
            code += 1
    return codes


class Coder:
    """Encodes and decodes blocks under given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.width = max(int(self.lengths.max(initial=0)), 1)
        #: For each next `width` bits: the symbol, and in the low five bits its length.
        self.table = np.zeros(1 << self.width, np.uint32)
        for s in np.flatnonzero(self.lengths):
            spare = self.width - int(self.lengths[s])
            first = int(self.codes[s]) << spare
            self.table[first : first + (1 << spare)] = (int(s) << 5) | int(self.lengths[s])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The codes of ids, and the bits of each run of MARK ids."""
        lens = self.lengths[ids].astype(np.int64)
        if not lens.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(lens)
        starts = ends - lens
        word, at = starts >> 5, (starts & 31).astype(np.uint64)
        shifted = self.codes[ids] << (np.uint64(64) - at - lens.astype(np.uint64))
        n_words = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0
        high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n_words)  # codes don't overlap: sums stay below 2**32
        low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        runs = np.diff(np.concatenate([[0], ends[MARK - 1 :: MARK], ends[-1:] if len(ids) % MARK else []]))
        bits = (high + low[:n_words]).astype(">u4").tobytes()
        return bits[: int(ends[-1] + 7 >> 3)] if len(ids) else b"", runs.astype("<u2").tobytes()

    def decode(self, codes: bytes, marks: bytes, n: int) -> np.ndarray:
        """The n ids of a block."""
        runs = np.frombuffer(marks, "<u2").astype(np.int64)
        at = np.cumsum(runs) - runs
        data = np.frombuffer(codes + bytes(MARK * self.width // 8 + 8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((MARK, len(runs)), np.uint32)
        mask, top = np.uint32((1 << self.width) - 1), 32 - self.width
        for step in range(min(MARK, n)):
            found = self.table[window[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask]
            out[step] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:n]


class _Ids:
    """The ids of texts as arrays, the end id last."""

    def __init__(self, path: str, end_id: int):
        self.encoder = WordBpe(path, self.pack, b"".join, limit=ID_WORDS)
        self.size = max(self.encoder.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = "H" if self.size <= 1 << 16 else "I"
        self.end = self.encoder.value([end_id])

    def close(self) -> None:
        self.encoder.close()

    def pack(self, ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
        data, ends = ids.astype(self.kind).tobytes(), (stops * np.dtype(self.kind).itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def __call__(self, column: pa.Array) -> Iterator[bytes]:
        for numbers, chunks, texts in self.encoder.groups(column):
            values = list(map(self.encoder.chunks.__getitem__, chunks))
            for i, of_text in enumerate(numbers):
                pieces = [map(values.__getitem__, of_text)] if of_text is not None else self.encoder.odd(texts[i].as_py())
                yield b"".join([*(b"".join(p) for p in pieces), self.end])


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs, from the counts that the encoding tasks left in the column counts (id and number, int64 each)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for task in batch.column(0):
                used, n = np.frombuffer(task.as_py(), np.int64).reshape(2, -1)
                if len(used):
                    total = np.concatenate([total, np.zeros(max(0, int(used[-1]) + 1 - len(total)), np.int64)])
                    total[used] += n
        used = np.flatnonzero(total)
        yield batch_of(schema, id=used, n=total[used])

    rows = encoded.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts once and writes their ids below the folder out, in ascending order of doc_id."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    bounds = range_bounds(docs, "doc_id", range_count(docs, partitions(spark)))
    kind = _Ids(tokenizer_path, end_id).kind
    plain = scratch(spark, "plain-ids")
    schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_Ids(tokenizer_path, end_id)) as ids_of:
            total = np.zeros(ids_of.size, np.int64)
            for batch in batches:
                ids = list(ids_of(batch.column(2)))
                n = np.bincount(np.frombuffer(b"".join(ids), kind))
                total[: len(n)] += n
                yield batch_of(schema, range=batch.column(0), doc_id=batch.column(1), ids=ids, counts=[None] * len(ids))
        # a task's last row holds its counts in a column of their own, so that reading them reads no ids
        used = np.flatnonzero(total)
        yield batch_of(schema, range=[None], doc_id=[None], ids=[None], counts=[np.stack([used, total[used]]).astype(np.int64).tobytes()])

    ranged = docs.withColumn("range", range_index(docs["doc_id"], bounds)).select("range", "doc_id", "text")
    ranged.mapInArrow(encode, "range int, doc_id long, ids binary, counts binary").write.option("compression", "zstd").parquet(plain)
    encoded = spark.read.parquet(plain)
    lengths = code_lengths(id_counts(encoded), max_len)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, length int").coalesce(1).write.parquet(f"{out}/header")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        held: list[np.ndarray] = []
        docs_held: list[int | None] = []
        size = before = number = 0
        of = None

        def block() -> pa.RecordBatch:
            codes, marks = coder.encode(np.concatenate(held))
            return batch_of(_BLOCK, range=[of], block=[number], ids_before=[before], n_ids=[size], codes=[codes], marks=[marks], doc_ids=[docs_held], doc_lens=[[len(x) for x in held]])

        for batch in batches:
            for r, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (r != of or size >= BLOCK_IDS):
                    yield block()
                    number, before = (number + 1, before + size) if r == of else (0, 0)
                    held, docs_held, size = [], [], 0
                of = r
                held.append(np.frombuffer(ids, kind))
                docs_held.append(doc)
                size += len(held[-1])
        if held:
            yield block()

    dealt = encoded.where("counts IS NULL").select("range", "doc_id", "ids").repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "doc_id")
    dealt.mapInArrow(blocks, _BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    removed(spark, plain)


def _read(spark: SparkSession, path: str):
    """The blocks of a file set, its code lengths, and the ids before each range."""
    header = spark.read.parquet(f"{path}/header").collect()  # bounded by the vocabulary
    lengths = np.zeros(max([0, *(r["symbol"] for r in header)]) + 1, np.uint8)
    for r in header:
        lengths[r["symbol"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()):  # one row for each written partition
        starts[r["range"]] = total
        total += r["n"]
    return blocks, lengths, starts


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<long>) of each document of a file set."""
    return _decoded(spark, path, "doc_id long, start long, ids array<long>", pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]), lambda ids: {"ids": [x.tolist() for x in ids]})


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a file set, from its blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", schema, lambda ids: {"n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})


def _decoded(spark: SparkSession, path: str, ddl: str, schema: pa.Schema, made) -> DataFrame:
    blocks, lengths, starts = _read(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for b in range(batch.num_rows):
                block = {f: batch.column(f)[b].as_py() for f in batch.schema.names}
                ids = coder.decode(block["codes"], block["marks"], block["n_ids"])
                ends = np.cumsum(block["doc_lens"])
                begins = ends - block["doc_lens"]
                yield batch_of(schema, doc_id=block["doc_ids"], start=begins + (starts[block["range"]] + block["ids_before"]), **made([ids[i:j] for i, j in zip(begins, ends)]))

    return blocks.mapInArrow(run, ddl)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, out: str | None = None) -> DataFrame:
    """Writes the ids of docs as a file set (by default in the shared scratch folder) and returns digests() of what is read back."""
    out = out or scratch(docs.sparkSession, "ids")
    write_ids(docs, tokenizer_path, out, end_id)
    return digests(docs.sparkSession, out)
