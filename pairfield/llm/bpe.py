"""Encoding whole texts with a word-end BPE vocabulary, and decoding the ids again.

Tree concatenation: a long text is cut into halves, these into halves and so on, wherever the cuts
fall, and all leaves are encoded side by side: every step makes the next merge of every new word of
all leaves at once (`Merges`), so no half waits for another. Neighbours are joined up the tree: the chunks around a join (text between white space) are encoded anew, in a
window that grows until its first and its last chunk have the ids that they had on either side.
White space parts what the model sees, so from there on both sides stay as they are and the join
is exact. A long word that nothing parts is a tree of its own: leaves are encoded without word
ends, and a window of tokens grows until its first and its last token are those that the two sides
had. Then every adjacent pair of tokens is one that the model leaves apart when it encodes just
these two, which is what makes a sequence the model's own encoding of the whole.

Nulls encode as the empty text (0 tokens, hashes of the empty string). Special strings inside a
text are their own token, as by the library's default. Rows are independent, so ties and repeated
rows repeat results, and an empty table gives an empty one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import closing
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import vocab
from .common import batch_of, text_pieces

#: Code points of a leaf of a long text.
TEXT_LEAF = 2048
#: Bytes of an unsplit word from which it is a tree of its own, and of a leaf of it.
LONG_WORD, LEAF = 512, 128
#: Chunks whose ids and tokens are remembered as strings, which take several times the room of ids.
STRING_WORDS = 240_000
#: Tokens, or chunks, on either side of a join in the first window.
FIRST_WINDOW, FIRST_CHUNKS = 4, 1
#: Bytes of texts that are split into words together; a longer text is taken in pieces.
GROUP_BYTES = 32 << 20
_WORDS_AND_BREAKS = regex.compile(vocab.WORD_PATTERN.pattern + r"|\n")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Merges:
    """A vocabulary's merges, made in many words at once: a step makes the leftmost merge of least rank of each word."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        visible = vocab.visible_bytes()
        self.inner = np.array([vocabulary.get(c, -1) for c in visible], np.int64)
        self.final = np.array([vocabulary.get(c + end, -1) for c in visible], np.int64)
        #: Whether words are merged here; a model that does more than merge is left to the library.
        self.usable = bool(end) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and min(self.inner.min(), self.final.min()) >= 0
        if not self.usable:
            return
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranked = {(vocabulary[a] << 32 | vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.fromiter(ranked, np.int64, len(ranked))
        ranks, made = np.array(list(ranked.values()), np.int32).reshape(-1, 2).T
        #: Tables of keys, ranks and results; a key stands in the first table where its place is free.
        self.tables = []
        for seed in range(1, 1000):
            if not len(keys):
                break
            at = self.place(keys, seed, bits := max(8, int(len(keys)).bit_length() + 2))
            _, first = np.unique(at, return_index=True)
            table = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
            for column, values in zip(table, (keys, ranks, made)):
                column[at[first]] = values[first]
            self.tables.append((seed, bits, *table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, made = keys[rest], ranks[rest], made[rest]

    @staticmethod
    def place(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (NONE if they don't merge) and the result of each pair of ids."""
        keys = left << 32 | right
        rank, made = np.full(len(keys), self.NONE, np.int32), np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for seed, bits, held, ranks, results in self.tables:
            at = self.place(keys[open_], seed, bits)
            same = held[at] == keys[open_]
            rank[open_[same]], made[open_[same]] = ranks[at[same]], results[at[same]]
            open_ = open_[~same & (held[at] >= 0)]
        return rank, made

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (none empty, without spaces), one after the other, and where each word's ids end."""
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 0x20), len(data))
        ids = self.inner[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        ids = np.delete(ids, ends[:-1])
        sizes = np.diff(ends, prepend=-1) - 1
        word, done = np.arange(len(words)), []
        stops = np.cumsum(sizes)
        rank, made = np.full(len(ids), self.NONE, np.int32), np.zeros(len(ids), np.int32)
        inside = np.ones(len(ids), bool)
        inside[stops - 1] = False
        at = np.flatnonzero(inside)
        rank[at], made[at] = self.found(ids[at], ids[at + 1])
        while len(word):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            still = least < self.NONE
            if not still.all():
                mask = np.repeat(still, sizes)
                done.append((word[~still], sizes[~still], ids[~mask]))
                word, sizes, least, ids, rank, made = word[still], sizes[still], least[still], ids[mask], rank[mask], made[mask]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.searchsorted(hits, starts)]  # the leftmost one of each word
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NONE if it was the last
            before, after = at > starts, at + 2 < starts + sizes
            b, a = at[before], at[after]
            rank[b - 1], made[b - 1] = self.found(ids[b - 1], ids[b])
            rank[a], made[a] = self.found(ids[a], ids[a + 2])
            ids, rank, made, sizes = ids[keep], rank[keep], made[keep], sizes - 1
        sizes = np.zeros(len(words), np.int64)
        for w, n, _ in done:
            sizes[w] = n
        stops = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), np.int64)
        for w, n, x in done:
            out[np.arange(len(x)) + np.repeat(stops[w] - n - (np.cumsum(n) - n), n)] = x
        return out, stops


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]


@lru_cache(maxsize=2)
def _loaded(path: str):
    """The tokenizer at path and its merges, once a worker process: both are fixed and small."""
    return vocab.load(path), Merges(_model(path))


class WordBpe:
    """Encodes whole texts, remembering chunks.

    render makes of the ids of words (one after the other, and where each word's end) what is
    remembered for each, and join puts the values of a run of words together. New words of a group
    of texts are encoded together.
    """

    def __init__(self, path: str, render=lambda ids, stops: [x.tolist() for x in np.split(ids, stops[:-1])], join=lambda values: [x for v in values for x in v], long_word: int = LONG_WORD, leaf: int = LEAF, window: int = FIRST_WINDOW, text_leaf: int = TEXT_LEAF, limit: int = vocab.CACHE_WORDS):
        self.path, self.render, self.join = path, render, join
        self.tokenizer, self.merges = _loaded(path)
        self.special = vocab.special_strings(self.tokenizer)
        self.split = vocab.splitter(self.special)
        self.odd_texts = vocab.odd_pattern(self.special)
        self.model, self.end = self.tokenizer.model, self.tokenizer.model.end_of_word_suffix or ""
        self.visible = {b: c for b, c in enumerate(vocab.visible_bytes()) if b != 0x20}
        self._inner = None
        self.long_word, self.leaf, self.window, self.text_leaf = long_word, leaf, window, text_leaf
        #: Values of chunks; a chunk in lower case that is one word is that word, so both stand here.
        self.chunks = vocab.Remembered(self.chunk, limit=limit)

    def close(self) -> None:
        """Forgets all chunks; a worker runs many tasks, and the next one starts its own."""
        self.chunks.clear()
        vocab.released()

    def chunk(self, chunk: str):
        """The value of a chunk: text without white space."""
        words = vocab.WORD_PATTERN.findall(vocab.lowered(vocab.composed(chunk)))
        return self.value(self.word(self.mapped(chunk))) if words == [chunk] else self.join([self.chunks[w] if w != chunk else self.value(self.word(self.mapped(w))) for w in words])

    def value(self, ids: list[int]):
        return self.render(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def mapped(self, words: str) -> str:
        """The visible bytes of words; the spaces between words stay."""
        return words.encode().decode("latin-1").translate(self.visible)

    def learn(self, chunks: Iterable[str]) -> None:
        """Remembers new chunks. Most are one word; the others are split into words together."""
        new = [c for c in self.chunks.room(chunks) if len(c) <= vocab.CACHE_CHARS]
        one = [c for c in new if c.islower() and c.isalpha() and (c.isascii() or c.lower() == c and unicodedata.is_normalized("NFC", c))]
        rest = list(set(new).difference(one)) if len(one) < len(new) else []
        parts = _WORDS_AND_BREAKS.findall(vocab.lowered(vocab.composed("\n".join(rest)))) + ["\n"] if rest else []
        self._learn_words([*one, *{*parts}.difference(one, ("\n",))])
        value = self.chunks.__getitem__
        at, held = iter(rest), []
        for part in parts:
            if part == "\n":
                self.chunks[next(at)] = value(held[0]) if len(held) == 1 else self.join([value(w) for w in held])
                held = []
            else:
                held.append(part)

    def _learn_words(self, words: list[str]) -> None:
        """Remembers new words, encoded side by side."""
        new = [w for w in words if w not in self.chunks and len(w) <= vocab.CACHE_CHARS]
        if new and self.merges.usable:  # else they are encoded one by one when asked for
            self.chunks.update(zip(new, self.render(*self.merges(new))))

    def texts(self, column: pa.Array) -> Iterator[Iterable[list]]:
        """For each text of a column its values, in lists of bounded length that follow each other."""
        for numbers, chunks, texts in self.groups(column):
            values = list(map(self.chunks.__getitem__, chunks))
            for i, of_text in enumerate(numbers):
                yield self.odd(texts[i].as_py()) if of_text is None else [list(map(values.__getitem__, of_text))]

    def groups(self, column: pa.Array) -> Iterator[tuple[Iterable[list[int] | None], list[str], pa.Array]]:
        """Bounded parts of a column of texts: for each text the numbers of its chunks (None: it isn't simple), the chunks by number (which are learnt), and the texts."""
        column = column.fill_null("")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP_BYTES, "right")))
            part = column.slice(start, stop - start)
            huge = sizes[start] - (sizes[start - 1] if start else 0) > GROUP_BYTES
            simple = ~pc.match_substring_regex(part, self.odd_texts).to_numpy(zero_copy_only=False).astype(bool) & (not huge)
            long = simple & (pc.utf8_length(part).to_numpy(zero_copy_only=False) > self.text_leaf)
            trees = {int(i): self.leaves(part[int(i)].as_py()) for i in np.flatnonzero(long)}
            rows = pc.if_else(pa.array(simple & ~long), part, "")
            rows = pc.if_else(pc.string_is_ascii(rows), pc.ascii_lower(rows), rows)
            lists = pc.utf8_split_whitespace(pa.concat_arrays([rows, pa.array([x for leaves in trees.values() for x in leaves], part.type)]))
            found = lists.flatten().dictionary_encode()
            chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.learn(chunks)
            yield self._numbers(simple, trees, found.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), chunks), chunks, part
            start = stop

    def leaves(self, text: str) -> list[str]:
        """A text cut in halves, and these again, until they are no longer than a leaf."""
        text = text.lower() if text.isascii() else text
        out = [text]
        while len(out[0]) > self.text_leaf:
            out = [half for x in out for half in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
        return out

    def _numbers(self, simple: np.ndarray, trees: dict[int, list[str]], index: np.ndarray, starts: np.ndarray, chunks: list[str]) -> list[list[int] | None]:
        """The numbers of each text's chunks; joins put the chunks that they make at the end of chunks."""
        out, row = [], len(simple)
        for i in range(len(simple)):
            if not simple[i]:
                out.append(None)
            elif i not in trees:
                out.append(index[starts[i] : starts[i + 1]].tolist())
            else:
                parts = [(x, index[starts[row + k] : starts[row + k + 1]].tolist()) for k, x in enumerate(trees[i])]
                row += len(parts)
                while len(parts) > 1:
                    parts = [self._together(*parts[k], *parts[k + 1], chunks) for k in range(0, len(parts), 2)]
                out.append(parts[0][1])
        return out

    def _together(self, left_text: str, left: list[int], right_text: str, right: list[int], chunks: list[str]) -> tuple[str, list[int]]:
        """A text of two halves, and the numbers of its chunks."""
        text, k = left_text + right_text, FIRST_CHUNKS
        between = " " if left_text[-1:].isspace() or right_text[:1].isspace() else ""
        while left and right:
            a, b = left[-k:], right[:k]
            window = vocab.SPACES.split(" ".join([chunks[n] for n in a]) + between + " ".join([chunks[n] for n in b]))
            known = {chunks[n]: n for n in (*a, *b)}
            agree = (k >= len(left) or self.chunks[window[0]] == self.chunks[chunks[a[0]]]) and (k >= len(right) or self.chunks[window[-1]] == self.chunks[chunks[b[-1]]])
            # one chunk that reaches over the join can't agree with both sides
            if agree and (len(window) > 1 or k >= max(len(left), len(right))):
                for chunk in window:
                    if chunk not in known:
                        known[chunk] = len(chunks)
                        chunks.append(chunk)
                return text, left[:-k] + [known[chunk] for chunk in window] + right[k:]
            k *= 2
        return text, left + right

    def odd(self, text: str) -> Iterator[list]:
        """The values of a text that holds special strings or unsettled characters, or is very long."""
        for chunks, value in self._cuts(text):
            self.learn(chunks)
            yield list(map(self.chunks.__getitem__, chunks)) if value is None else [value]

    def _cuts(self, text: str) -> Iterator[tuple[list[str], object]]:
        """A text as chunks without white space, or as the value of a part that the library encodes whole."""
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                yield [], self.value([self.special[part]])
                continue
            for piece in text_pieces(part):
                if not piece.isascii() and vocab.UNSETTLED.search(piece):
                    if ids := self.tokenizer.encode(piece, add_special_tokens=False).ids:
                        yield [], self.value(ids)
                elif not vocab.SEPARATORS.search(piece):
                    yield piece.split(), None
                else:
                    yield [c for c in vocab.SPACES.split(piece) if c], None

    def word(self, mapped: str) -> list[int]:
        """Ids of one pre-token in its visible bytes."""
        return [t.id for t in self.model.tokenize(mapped)] if len(mapped) < self.long_word else self.tree(mapped)

    @property
    def inner(self):
        """The same merges without word ends, for the inner leaves of a long word."""
        if self._inner is None:
            from tokenizers import Tokenizer
            from tokenizers.models import BPE

            model = _model(self.path)
            self._inner = Tokenizer(BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]]))
        return self._inner

    def tree(self, mapped: str) -> list[int]:
        """Ids of one long pre-token, from leaves joined up a binary tree."""
        leaves = [mapped[i : i + self.leaf] for i in range(0, len(mapped), self.leaf)]
        parts = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        parts.append([t.id for t in self.model.tokenize(leaves[-1])])
        while len(parts) > 1:
            last = len(parts) - 1
            parts = [self.joined(parts[i], parts[i + 1], i + 1 == last) if i < last else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def joined(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The ids of the text of left and right together; ends: the word ends with right."""
        token, k = self.tokenizer.id_to_token, self.window
        while True:
            a, b = left[-k:], right[:k]
            closed = ends and k >= len(right)
            text = "".join(map(token, a + b))
            if closed and self.end:
                text = text.removesuffix(self.end)
            got = [t.id for t in self.model.tokenize(text)] if closed else self.inner.encode(text, add_special_tokens=False).ids
            if (k >= len(left) or got[0] == a[0]) and (k >= len(right) or got[-1] == b[-1]):
                return left[:-k] + got + right[k:]
            k *= 2


class Digests:
    """Counts and digests of texts' ids and of their decoded texts."""

    def __init__(self, path: str):
        self.encoder = WordBpe(path, self.strings, lambda values: (" ".join([v[0] for v in values]), " ".join([v[1] for v in values]), sum([v[2] for v in values])), limit=STRING_WORDS)
        self.token = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(self.encoder.tokenizer.get_vocab_size())]
        self.number = list(map(str, range(len(self.token))))

    def strings(self, ids: np.ndarray, stops: np.ndarray) -> list[tuple[str, str, int]]:
        ids, stops = ids.tolist(), stops.tolist()
        numbers, tokens = list(map(self.number.__getitem__, ids)), list(map(self.token.__getitem__, ids))
        return [(" ".join(numbers[i:j]), " ".join(tokens[i:j]), j - i) for i, j in zip([0, *stops], stops)]

    def close(self) -> None:
        self.encoder.close()

    def texts(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        for pieces in self.encoder.texts(column):
            ids, decoded, n = sha256(), sha256(), 0
            for values in pieces:
                if values := [v for v in values if v[2]]:
                    between = " " if n else ""
                    ids.update((between + " ".join([v[0] for v in values])).encode())
                    decoded.update((between + " ".join([v[1] for v in values])).encode())
                    n += sum([v[2] for v in values])
            yield n, ids.hexdigest(), decoded.hexdigest()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of each row's ids and of the text decoded from them; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Digests(path)) as digest:
            for batch in batches:
                rows = list(digest.texts(batch.column(1)))
                n, ids, decoded = map(list, zip(*rows)) if rows else ([], [], [])
                yield batch_of(_SCHEMA, doc_id=batch.column(0), n_tokens=n, ids_sha256=ids, decoded_sha256=decoded)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(WordBpe(path)) as encoder:
            for batch in batches:
                yield batch_of(schema, doc_id=batch.column(0), ids=[[x for values in pieces for v in values for x in v] for pieces in encoder.texts(batch.column(1))])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of encodings (doc_id, ids), as the library decodes them, special tokens kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = vocab.load(path)
        for batch in batches:
            yield batch_of(schema, doc_id=batch.column(0), text=tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False))

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
