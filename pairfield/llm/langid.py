"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies element by
element) the vector of its last letter, that of its middle letter permuted once and that of its
first letter permuted twice. A text bundles (adds) the vectors of its trigrams; a language bundles
its texts. A text gets the language whose prototype has the highest cosine with its own vector.

As bundling is a sum, each task sums its learning texts by language and Spark sums the tasks'
vectors: one integer vector for each language reaches the driver. Everything but letters is one
boundary symbol; letters beyond a-z share hashed symbols, so the alphabet has a fixed size.

A null text, or one without a letter, is `und` with score 0; so is every text when there is nothing
to learn from. Rows whose language is null are not learnt from. Equal cosines go to the language
that sorts first. A null doc_id counts as the empty string when rows are held out. Long texts are
read whole, in slices; repeated rows repeat results and are learnt from as often; an empty table
gives an empty result. identified() returns all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, small_batches

UNKNOWN = "und"
DIMENSIONS, SYMBOLS, SEED = 1024, 64, 20_17
#: Characters of a text looked at in one step.
SLICE = 1 << 20
#: Cosines below this are no language that was learnt: (distinct trigrams from which it holds, cosine). Of random letters 99 in 100
#: have 0.116 or less; of 3143 clean texts the least has 0.151 from 30 trigrams on and 0.25 from 75 on. A shorter text cannot be
#: told from random letters and stays.
REJECT_BELOW = ((0, 0.01), (30, 0.125), (75, 0.2))


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


class Profiles:
    """Trigrams of texts and their bundled vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.first, self.middle, self.last = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.dimensions = dimensions
        points = np.arange(0x10000)
        other = 27 + (points * 40503 >> 4) % (SYMBOLS - 27)
        is_letter = np.array([chr(c).isalpha() for c in points])
        self.symbol = np.where(is_letter, other, 0).astype(np.uint32)
        self.symbol[ord("a") : ord("z") + 1] = np.arange(1, 27)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() > 0xFFFF:
            high = points > 0xFFFF
            letter = np.array([chr(c).isalpha() for c in points[high].tolist()])
            points = np.where(high, 0, points)
            codes = self.symbol[points]
            codes[high] = np.where(letter, 27, 0)
            return codes
        return self.symbol[points]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's distinct trigrams and how often each occurs; none if it has no letter."""
        text = text or ""
        if len(text) <= SLICE:
            return np.unique(self._trigrams(np.concatenate([[0], self.codes(text), [0]])), return_counts=True)
        total, carried = np.zeros(SYMBOLS**3, np.int64), np.zeros(1, np.uint32)
        for i in range(0, len(text), SLICE):
            codes = np.concatenate([carried, self.codes(text[i : i + SLICE]), np.zeros(int(i + SLICE >= len(text)), np.uint32)])
            codes = self._collapsed(codes)
            total += np.bincount(self._trigrams(codes), minlength=len(total))
            carried = codes[-2:]
        used = np.flatnonzero(total)
        return used, total[used]

    @staticmethod
    def _collapsed(codes: np.ndarray) -> np.ndarray:
        keep = codes != 0
        keep[0] = True
        keep[1:] |= codes[:-1] != 0
        return codes[keep]

    def _trigrams(self, codes: np.ndarray) -> np.ndarray:
        codes = self._collapsed(codes.astype(np.uint32))
        return (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' bound vectors, each as often as it occurs."""
        total = np.zeros(self.dimensions)
        for i in range(0, len(grams), 1 << 12):
            g = grams[i : i + (1 << 12)]
            bound = self.first[g >> 12] * self.middle[g >> 6 & 63] * self.last[g & 63]
            total += counts[i : i + (1 << 12)].astype(np.float32) @ bound.astype(np.float32)
        return total


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The prototype of each language of docs; only non-null texts and languages count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums, held = Profiles(dimensions), {}, {}

        def settle(lang: str) -> None:
            parts = held.pop(lang)
            grams, n = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(n, np.concatenate([c for _, c in parts]), len(grams))
            sums[lang] = sums.get(lang, 0) + np.rint(profiles.bundle(grams, counts)).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(profiles.trigrams(text))
                if len(held[lang]) >= 128:
                    settle(lang)
        for lang in list(held):
            settle(lang)
        langs = [k for k in sums for _ in range(dimensions)]
        yield batch_of(pa.schema([("lang", pa.string()), ("d", pa.int32()), ("v", pa.int64())]), lang=langs, d=list(range(dimensions)) * len(sums), v=[x for k in sums for x in sums[k].tolist()])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    summed = rows.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    out: dict[str, list[int]] = {}
    for r in summed.collect():  # dimensions numbers for each language
        out.setdefault(r["lang"], [0] * dimensions)[r["d"]] = r["v"]
    return out


class Classifier:
    """Predicts languages from prototypes."""

    def __init__(self, prototypes: dict[str, list[int]]):
        self.langs = sorted(prototypes)
        dimensions = len(prototypes[self.langs[0]]) if self.langs else DIMENSIONS
        self.profiles = Profiles(dimensions)
        vectors = np.array([prototypes[k] for k in self.langs], float).reshape(-1, dimensions)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.of(*self.profiles.trigrams(text))

    def of(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not self.langs or not len(grams) or not grams.any():
            return UNKNOWN, 0.0
        vector = self.profiles.bundle(grams, counts)
        cosines = self.vectors @ vector / max(float(np.linalg.norm(vector)), 1e-300)
        best = int(cosines.argmax())
        return self.langs[best], round(min(1.0, max(0.0, float(cosines[best]))), 6)


def predict(docs: DataFrame, prototypes: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row of docs, from its text alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(prototypes)
        for batch in batches:
            found = [classify(t) for t in batch.column(1).to_pylist()]
            yield batch_of(schema, doc_id=batch.column(0), lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, prototypes: dict[str, list[int]], below: tuple[tuple[int, float], ...] = REJECT_BELOW, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has a language: not `und`, and a cosine of what `below` says for its trigrams, or more."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(prototypes)
        for batch in batches:
            keep = []
            for text in batch.column(place).to_pylist():
                grams, counts = classify.profiles.trigrams(text)
                lang, score = classify.of(grams, counts)
                keep.append(lang != UNKNOWN and score >= max((least for n, least in below if len(grams) >= n), default=0.0))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame, mod: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learnt from the rows whose crc32(doc_id) leaves another remainder."""
    prototypes = learn(docs.where(~held_out(docs["doc_id"], mod, remainder)))
    found = predict(docs, prototypes)
    return found.select("doc_id", held_out(found["doc_id"], mod, remainder).alias("held_out"), "lang_pred", "score")
