"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND, then verified.

Every training text is cut into overlapping passages, and every passage is a query against the inverted index of the
test items. An item's score is divided by its score for itself, so one threshold serves all items; WAND returns every
item at or above it. A passage is twice as long as the longest item and the next one begins an item's length further,
so any item stands whole in some passage. What is retrieved counts as a leak if enough of the item's question and of
its answer (its last line or sentence), measured in word 3-grams, occur in the passage.

Blocks are runs of item numbers, the same for all terms, with items numbered by length, so that short items, whose
terms weigh most, do not loosen the bounds of long ones. The sums of a passage's block maxima are taken for all
passages of a batch at once; WAND then walks through the blocks that may hold an item above the threshold.

The index goes to every task, so its size is bounded: items are dealt to shards of at most ``SHARD_CHARS``
characters, about, by hash, and ``TOGETHER`` shards are searched in one pass over the texts. Document frequencies, the
mean length and the longest item are those of all items, counted beforehand, so how items are dealt changes no result.
Texts are not shuffled.

Defined results: words are runs of letters and digits, lower-cased. Null and empty texts leak nothing; items without
words are never found. An item of one sentence is all question, and its answer counts as found with it. Items shorter
than 3 words are matched by their whole run of words. Of passages that score an item alike, the first is told. Very
long texts are cut into as many passages as they need; very long items make passages longer. Repeated rows each give
their own results, repeated items too. No items, or no documents: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import cut, slices, starts

THRESHOLD, OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75
BLOCK = 4
SHARD_CHARS, TOGETHER = 1 << 19, 8
SHORTEST_PASSAGE = 64
_END = 1 << 62


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and how many each has."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    flat = parts.flatten()
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts), dtype=np.int64))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    return flat.filter(pa.array(full)), np.bincount(row[full], minlength=len(texts))


def grams(words: list, n: int = 3) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line, or in a text of one line its last sentence; empty if there is only one."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _each(texts: list[str]) -> list[list[str]]:
    words, n = words_of(pa.array(texts, pa.string()))
    words, at = words.to_pylist(), starts(n)
    return [words[a:b] for a, b in zip(at, at[1:], strict=False)]


class Index:
    """Inverted lists of normalised BM25 impacts, in blocks with their maxima.

    ``everywhere``: where ``items`` are some of more, the number of all that have words, their mean and greatest length
    in words, and how many hold each of the words of ``items``.
    """

    def __init__(self, items: list[tuple], everywhere: tuple[int, float, int, dict[str, int]] | None = None):
        split, n = words_of(pa.array([t for _, t in items], pa.string()))
        split, at = split.to_pylist(), starts(n)
        kept = sorted((i for i in range(len(items)) if n[i]), key=lambda i: (n[i], i))
        self.ids = [items[i][0] for i in kept]
        texts = [split[at[i] : at[i + 1]] for i in kept]
        vocabulary = sorted({w for t in texts for w in t})
        self.vocabulary = pa.array(vocabulary, pa.string())
        number = {w: k for k, w in enumerate(vocabulary)}
        lengths = np.array([len(t) for t in texts], float)
        of_all = everywhere or (len(texts), float(lengths.mean()) if len(texts) else 1.0, int(max(lengths, default=0)), {})
        all_items, mean, self.longest, holders = of_all
        counts = [{} for _ in vocabulary]
        for i, t in enumerate(texts):
            for w in t:
                c = counts[number[w]]
                c[i] = c.get(i, 0) + 1
        total = len(texts)
        own = np.zeros(total)
        raw = []
        for word, c in zip(vocabulary, counts, strict=True):
            have = holders.get(word, len(c))
            idf = np.log(1 + (all_items - have + 0.5) / (have + 0.5))
            impact = {i: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean)) for i, tf in c.items()}
            for i, x in impact.items():
                own[i] += x
            raw.append(impact)
        self.items = [sorted(c) for c in counts]
        self.impacts = [[raw[k][i] / own[i] for i in items] for k, items in enumerate(self.items)]
        self.bound = np.array([max(x) for x in self.impacts]) if vocabulary else np.zeros(0)
        self.blocks = -(-total // BLOCK)
        self.block_max = np.zeros((len(vocabulary), self.blocks), np.float32)
        for k, (at_items, x) in enumerate(zip(self.items, self.impacts, strict=True)):
            np.maximum.at(self.block_max[k], np.array(at_items) // BLOCK, np.array(x, np.float32) * np.float32(1.000001))
        parts = [question_and_answer(items[i][1]) for i in kept]
        self.question, self.answer = ([grams([number[w] for w in t]) for t in _each([p[k] for p in parts])] for k in (0, 1))

    def search(self, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """The items of a block whose score is at least ``threshold``, by WAND with the block's maxima. ``terms``: distinct."""
        lists, first, end = self.items, block * BLOCK, (block + 1) * BLOCK
        bound = self.block_max[:, block]
        at, here = {}, {}
        for t in terms:
            if bound[t]:
                at[t] = bisect_left(lists[t], first)
                here[t] = lists[t][at[t]]
        out, least = [], threshold - 1e-9

        def move(t: int, item: int) -> None:
            k = bisect_left(lists[t], item, at[t])
            at[t], here[t] = k, lists[t][k] if k < len(lists[t]) and lists[t][k] < end else _END

        while True:
            order = sorted((t for t in here if here[t] != _END), key=here.__getitem__)
            total, pivot = 0.0, -1
            for i, t in enumerate(order):
                total += bound[t]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = here[order[pivot]]
            if here[order[0]] < item:
                for t in order[:pivot]:
                    if here[t] < item:
                        move(t, item)
                continue
            score = 0.0
            for t in order:
                if here[t] != item:
                    break
                score += self.impacts[t][at[t]]
                move(t, item + 1)
            if score >= least:
                out.append((item, score))

    def live(self, where: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(passage, block, first pair, end) of the blocks whose maxima sum to the threshold. Pairs are sorted by passage."""
        if not len(where):
            return
        heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        ends = np.append(heads[1:], len(where))
        most = max(1, (4 << 20) // max(1, self.blocks))
        a = 0
        while a < len(heads):
            b = max(a + 1, int(np.searchsorted(ends, heads[a] + most, side="right")))
            sums = np.add.reduceat(self.block_max[term[heads[a] : ends[b - 1]]], heads[a:b] - heads[a], axis=0)
            for i, block in np.argwhere(sums >= threshold - 1e-6).tolist():
                yield int(where[heads[a + i]]), block, int(heads[a + i]), int(ends[a + i])
            a = b

    def verify(self, item: int, passage: list[int], overlap: float) -> tuple[float, float] | None:
        q, a = self.question[item], self.answer[item]
        found: dict[int, set] = {}

        def share(wanted: set) -> float:
            if not wanted:
                return 1.0
            n = len(next(iter(wanted)))
            if n not in found:
                found[n] = grams(passage, n) if len(passage) >= n else set()
            return len(wanted & found[n]) / len(wanted)

        both = share(q), share(a)
        return both if min(both) >= overlap else None

    def leaks(self, code: np.ndarray, n: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, int, float, float]]:
        """(row, item, score, first word, question overlap, answer overlap); the best passage of each row and item.

        ``code``: the words of all rows, -1 for those that no item has.
        """
        step = max(SHORTEST_PASSAGE, self.longest)
        at = starts(n)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(code)) - at[row]
        known = np.flatnonzero(code >= 0)
        # passage p of a row has the words from p * step to (p + 2) * step
        per_row = np.maximum(1, -(-n // step) - 1)
        first = starts(per_row)
        p = place[known] // step
        late = np.minimum(p, per_row[row[known]] - 1)
        early = np.maximum(p - 1, 0)
        where = np.concatenate([first[row[known]] + late, (first[row[known]] + early)[early < late]])
        term = np.concatenate([code[known], code[known][early < late]])
        pairs = np.unique(where * len(self.bound) + term) if len(self.bound) else np.zeros(0, np.int64)
        where, term = pairs // max(1, len(self.bound)), pairs % max(1, len(self.bound))
        best: dict[tuple[int, int], tuple] = {}
        for k, block, a, b in self.live(where, term, threshold):
            hits = self.search(term[a:b].tolist(), threshold, block)
            if hits:
                r = int(np.searchsorted(first, k, side="right")) - 1
                begin = int((k - first[r]) * step)
                passage = code[at[r] + begin : min(at[r + 1], at[r] + begin + 2 * step)].tolist()
                for item, score in hits:
                    both = self.verify(item, passage, overlap)
                    if both and score > best.get((r, item), (0.0,))[0]:
                        best[r, item] = (float(score), begin, *both)
        return [(r, item, *x) for (r, item), x in sorted(best.items())]


def shards(benchmark: DataFrame) -> Iterator[tuple[list[tuple], tuple | None]]:
    """The items in lists of about SHARD_CHARS characters at most, each with what it must know of all items."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, -(-chars // SHARD_CHARS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    own = lambda k: [tuple(r) for r in rows.where(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
    if n == 1:
        yield own(0), None
        return

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, count = words_of(batch.column(0))
                at = starts(count)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(count), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), found)], ["shard", "n", "words"])

    items = cut(rows.select("text", "shard").mapInArrow(split, "shard long, n long, words array<string>").where("n > 0"), "items")
    total, mean, longest = items.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    each = items.select("shard", F.explode(F.array_distinct("words")).alias("word"))
    holders = each.groupBy("word").agg(F.count("*").alias("have"))
    known = cut(each.distinct().join(holders, "word"), "holders")
    for k in range(n):
        yield own(k), (total or 0, mean or 1.0, longest or 0, dict(known.where(F.col("shard") == k).select("word", "have").collect()))  # words of one shard


def _searched(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float) -> Iterator[Callable]:
    """For every TOGETHER shards, a function that gives a function from a batch, texts last, to its leaks (row, item id,
    and what ``leaks`` says besides); to be called on executors."""
    parts = list(shards(benchmark))
    for a in range(0, len(parts), TOGETHER):
        shared = docs.sparkSession.sparkContext.broadcast(parts[a : a + TOGETHER])  # about TOGETHER * SHARD_CHARS characters

        def searcher(shared=shared) -> Callable[[pa.RecordBatch], list]:
            indexes = [Index(*part) for part in shared.value]

            def search(batch: pa.RecordBatch) -> list:
                words, n = words_of(batch.column(batch.num_columns - 1))
                out = []
                for index in indexes:
                    code = np.asarray(pc.fill_null(pc.index_in(words, value_set=index.vocabulary), -1), dtype=np.int64)
                    out += [(h[0], index.ids[h[1]], *h[2:]) for h in index.leaks(code, n, threshold, overlap)]
                return out

            return search

        yield searcher


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id of each leaking row with item_id, score, first_word, question_overlap and answer_overlap."""
    kinds = [docs.schema["doc_id"], benchmark.schema["item_id"]]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])
    item_type = to_arrow_type(kinds[1].dataType)
    out = None
    for searcher in _searched(docs, benchmark, threshold, overlap):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            search = searcher()
            for batch in slices(batches, most=4 << 20):
                if hits := search(batch):
                    rest = ((2, pa.float64()), (3, pa.int64()), (4, pa.float64()), (5, pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], item_type), *(pa.array([h[k] for h in hits], t) for k, t in rest)],
                        ["doc_id", "item_id", "score", "first_word", "question_overlap", "answer_overlap"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, unchanged, that leak no item."""
    out = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    for searcher in _searched(docs, benchmark, threshold, overlap):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            search = searcher()
            for batch in slices(batches, most=4 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in search(batch)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.select("doc.*")
