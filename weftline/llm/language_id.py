"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on nothing but the letter. A trigram's vector binds
(multiplies) its letters' vectors, each rotated by its place; a text's profile bundles (adds) the vectors of all its
trigrams; a language's prototype bundles those of all its training texts. A text gets the language whose prototype,
less the mean of all prototypes, has the highest cosine with its own profile.

A text that shares no trigram with any prototype has a cosine of about 1/sqrt(``DIMENSIONS``) by chance, 0.011; what
``with_language`` asks for is well above that.

Bundling is linear, so trigrams are counted first and the counts multiplied with the code book; training needs one
product for each language of a batch. Each task sends one vector for each language it saw: what is collected is
languages x dimensions numbers, however many the documents are.

Defined results: a null text, an empty one and one without letters give ``und`` with score 0. Equal cosines: the
language first in code point order. Null labels teach nothing. With no usable label every text is ``und``. Very long
texts are profiled whole, in pieces of the code book. Columns other than the named ones are ignored; repeated rows are
judged each by itself. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import slices

DIMENSIONS = 8192
#: Numbers held at once: of the code book, of profiles.
HELD = 8 << 20
UNDETERMINED = "und"
_SEED = 0x5EED


class Letters:
    """Numbers for the letters seen by this worker, and their vectors. 0 stands for whatever is no letter."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)
        self.known: dict[int, int] = {}
        self.vectors = [self._vector(0)]

    def _vector(self, code_point: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64([_SEED, code_point])).integers(0, 2, self.dimensions, dtype=np.int8)
        return bits * np.int8(2) - np.int8(1)

    def numbers(self, code_points: np.ndarray) -> np.ndarray:
        out = self.number[code_points]
        if (out < 0).any():
            for c in np.unique(code_points[out < 0]).tolist():
                letter = chr(c)
                low = ord(letter.lower()[0]) if letter.isalpha() else 0
                if low and low not in self.known:
                    self.known[low] = len(self.vectors)
                    self.vectors.append(self._vector(low))
                self.number[c] = self.known[low] if low else 0
            out = self.number[code_points]
        return out

    def code_book(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of trigrams, given as numbers in base ``len(vectors)``."""
        v, base = np.stack(self.vectors), len(self.vectors)
        first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
        return (first[grams // (base * base)] * second[grams // base % base] * v[grams % base]).astype(np.float32)


def trigrams(texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the distinct trigrams, distinct trigrams) of every trigram around a letter."""
    points = np.frombuffer(" ".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 1 for t in texts])  # of all points but the first
    x = letters.numbers(points)
    if len(x) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    base, middle = len(letters.vectors), np.flatnonzero(x[1:-1])
    x = x if base**3 < 1 << 31 else x.astype(np.int64)
    grams = (x[middle] * base + x[middle + 1]) * base + x[middle + 2]
    row = row[middle]
    if base**3 <= 1 << 21:
        distinct = np.flatnonzero(np.bincount(grams, minlength=base**3))
        place = np.zeros(base**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        return row, place[grams], distinct
    distinct, place = np.unique(grams, return_inverse=True)
    return row, place, distinct


def bundles(row: np.ndarray, place: np.ndarray, distinct: np.ndarray, rows: int, letters: Letters) -> np.ndarray:
    """The profile of each row. The code book is made in pieces, so that any alphabet fits in memory."""
    out = np.zeros((rows, letters.dimensions), np.float64)
    size = max(1, HELD // letters.dimensions)
    if len(distinct) > size:
        order = np.argsort(place // size, kind="stable")
        row, place = row[order], place[order]
    ends = np.searchsorted(place // size, np.arange(-(-len(distinct) // size) + 1))
    for k, g in enumerate(range(0, len(distinct), size)):
        book = letters.code_book(distinct[g : g + size])
        n, step = len(book), max(1, (2 << 20) // len(book))
        r, p = row[ends[k] : ends[k + 1]], place[ends[k] : ends[k + 1]] - g
        for a in range(0, rows, step):
            b = min(rows, a + step)
            lo, hi = (0, len(r)) if step >= rows else np.searchsorted(r, [a, b])
            counts = np.bincount((r[lo:hi] - a) * n + p[lo:hi], minlength=(b - a) * n).reshape(b - a, n)
            out[a:b] += counts.astype(np.float32) @ book
    return out


def learn(docs: DataFrame, training: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language, from the rows where ``training`` holds and text and lang are not null."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, found = Letters(dimensions), {}
        for batch in slices(batches, most=4 << 20):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            row, place, distinct = trigrams(batch.column(0).to_pylist(), letters)
            row = number[row]
            if len(names) > 100:  # bundles() then works on runs of rows
                order = np.argsort(row, kind="stable")
                row, place = row[order], place[order]
            for name, v in zip(names, bundles(row, place, distinct, len(names), letters), strict=True):
                found[name] = found.get(name, 0) + v
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([np.rint(v).astype(np.int64).tolist() for v in found.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = docs.where(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(sums, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, k, x in summed.collect():
        out.setdefault(lang, np.zeros(dimensions, np.int64))[k] = x
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, the cosine (0 where it is negative)."""
    names = sorted(prototypes)
    if names:
        p = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names])
        p = p - p.mean(axis=0) * (len(names) > 1)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    dimensions = p.shape[1] if names else DIMENSIONS
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dimensions)
        most = max(1, HELD // dimensions)
        for batch in (part.slice(a, most) for part in slices(batches, column="__text", most=1 << 20) for a in range(0, part.num_rows, most)):
            rows = batch.num_rows
            row, place, distinct = trigrams(batch.column(batch.num_columns - 1).to_pylist(), letters)
            has = np.bincount(row, minlength=rows) > 0
            if names:
                v = bundles(row, place, distinct, rows, letters)
                cos = v @ p.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(axis=1)
                score = np.where(has, np.clip(cos[np.arange(rows), best], 0, 1), 0.0)
            else:
                best, score, has = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, bool)
            lang = [names[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(predict, schema)


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = 0.05) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language can be told: it is not ``und`` and scores ``min_score``."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = identify(whole, prototypes, keep=("doc",))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("doc.*")
