"""Token counts of whole texts under a byte-level BPE vocabulary.

Whole-token shortcut: before the job, the driver proves which strings of the vocabulary the model
encodes as exactly one token when they stand alone as a pre-token. Pre-tokens found in that set
count as one; only the others are merged, by the library's own model, once per distinct word.

Nulls count as the empty text (0 bytes, 0 tokens). Special strings inside a text count as one token,
as by the library's default. A null id is passed through. A long text is counted whole, in pieces
that no pre-token crosses. Rows are independent of each other, so repeated rows give repeated results
and an empty table gives an empty one; names of other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocab
from .common import batch_of, text_pieces

#: Tokens that a document may have before over_limit is set.
TOKEN_LIMIT = 1024

#: A space beside another space or the end: words there can't be looked up alone.
_UNEVEN = re.compile(r" (?:\s|\Z)|\s ")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def whole_tokens(path: str) -> frozenset[str]:
    """The texts that the model at path provably encodes, standing alone, as one token.

    Proof by exhaustion: each vocabulary entry is turned back into text, must be one pre-token by
    itself, and is then put through the model's merges.
    """
    tokenizer = vocab.load(path)
    model = tokenizer.model
    back = {c: b for b, c in enumerate(vocab.visible_bytes())}
    proven = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not vocab.UNSETTLED.search(text) and vocab.BYTE_PATTERN.findall(text) == [text] and len(model.tokenize(entry)) == 1:
            proven.add(text)
    return frozenset(proven)


class Counter:
    """Counts the tokens of texts, remembering words."""

    def __init__(self, path: str, whole: Iterable[str]):
        self.tokenizer = vocab.load(path)
        self.split = vocab.splitter(vocab.special_strings(self.tokenizer))
        mapped, model = vocab.byte_mapped(), self.tokenizer.model
        self.pre = vocab.Remembered(lambda p: len(model.tokenize(mapped(p))), dict.fromkeys(whole, 1))
        of = lambda chunk: sum(map(self.pre.__getitem__, vocab.BYTE_PATTERN.findall(chunk)))
        self.first, self.spaced = vocab.Remembered(of), vocab.Remembered(lambda chunk: of(" " + chunk))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.split.split(text) if self.split else [text]
        return len(parts) // 2 + sum(map(self.plain, parts[::2]))

    def close(self) -> None:
        """Forgets all words; a worker runs many tasks, and the next one starts its own."""
        for words in (self.pre, self.first, self.spaced):
            words.clear()
        vocab.released()

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        n = 0
        for piece in text_pieces(text):
            if not piece.isascii() and vocab.UNSETTLED.search(piece):
                n += len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            elif _UNEVEN.search(piece):
                n += sum(map(self.pre.__getitem__, vocab.BYTE_PATTERN.findall(piece)))
            else:
                head, *rest = piece.split(" ")
                n += (self.first[head] if head else 0) + sum(map(self.spaced.__getitem__, rest))
        return n


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs; other columns are not read.

    One narrow stage: text goes to Python in Arrow batches and four numbers a row come back.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Counter(path, whole.value)) as counter:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                n = [counter(t) for t in texts]
                yield batch_of(_SCHEMA, doc_id=batch.column(0), n_bytes=[len(t.encode()) if t else 0 for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
