"""LM scoring with a hierarchical Pitman-Yor model of words after words.

A text is a run of words and an end token; each token is drawn from the restaurant of the word before it (of the end
token, for the first). These context restaurants share one parent, the restaurant of all words, whose base gives the V
training words and all unknown words together 1 / (V + 1) each. Every table of a context restaurant is a customer of
the parent. So a token's probability is, averaged over samples::

    p(w | u) = (c_uw - d t_uw + (s + d T_u) p(w)) / (s + c_u)      p(w) = (t_w - e r_w + (s' + e R) / (V + 1)) / (s' + T)

with c customers, t tables of the context restaurants, and r tables of the parent.

Seating is sampled by Gibbs, one dish of a restaurant at a time: all its customers leave, sit down again one by one as
the Chinese restaurant process has it, given all other tables, and a Metropolis-Hastings step compares the new seating
with the old one, so that the posterior is unchanged. No customer is left out. From ``EXACT`` customers of one dish
on, runs of a 64th of those seated so far are seated at once. Levels are sampled in turn, as their seatings are
independent given the parent's; while contexts are sampled, the parent is held at the words' relative frequencies, kept
in a table of ``CELLS`` cells. (Words that share a cell count as one there; that matters to rare words only, whose
chance to open a table is next to nothing either way. Scores use the parent's own sampled seating.)

How it is spread: the corpus is cut into blocks. Each sends its distinct word pairs, with counts, packed as one array
for each range of contexts; the task of a range seats its restaurants and answers each block with what its pairs are
worth, in the order in which they came. What it needs of the parent, tables by word, goes to ranges of words in the
same way; these answer the blocks too, which then add up their texts. So pairs are shuffled once and aggregated before,
and nothing that grows with the corpus comes to one task or the driver. A context with more than 1/8 of a range's share
of all tokens (and ``SPLIT`` at least) is dealt out over several ranges by the word that follows; each of them sees an
even share of its tables, and their exact sum is what scores use.

Words are 64-bit hashes. Random numbers are seeded by range, so reruns with as many ranges agree.

Defined results: a null text is empty and has the end token alone. Rows whose training flag is null train. Held-out
rows teach nothing. Without training rows every token has probability 1. Very long texts are scored whole. Repeated
rows count and are scored each by itself; equal counts need no order. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import coded, cut, dealt, gathered, lean, mixed, partitions, slices, split_words, starts

BURN_IN, SAMPLES = 2, 2
#: Strength and discount of the contexts' restaurants and of their parent.
STRENGTH, DISCOUNT = 0.5, 0.75
PARENT_STRENGTH, PARENT_DISCOUNT = 1.0, 0.6
BLOCK_BYTES = 6 << 20
CELLS, SPLIT, EXACT = 1 << 22, 1 << 16, 4096
_END = np.uint64(xxhash.xxh3_64_intdigest(b""))


def pack(x: np.ndarray) -> bytes:
    """The numbers' bytes, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes(), 1)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


class Seating:
    """Tables of dishes, sampled side by side. ``customers``: one or more each; ``group``: the dish's restaurant;
    ``parent``: the dish's probability in the parent restaurant; ``scale``: by restaurant, its tables for each one seen here."""

    def __init__(self, customers: np.ndarray, group: np.ndarray, parent: np.ndarray, scale: np.ndarray, strength: float, discount: float, seed: int):
        self.rng, self.strength, self.discount = np.random.default_rng(seed), strength, discount
        self.group, self.scale = group, scale
        self.tables = np.ones(len(customers), np.int64)
        many = np.flatnonzero(customers > 1)
        self.many = many[np.argsort(-customers[many], kind="stable")]
        self.customers, self.parent = customers[self.many], parent[self.many]
        self.births: list[np.ndarray] | None = None

    def steps(self) -> Iterator[tuple[int, int, int]]:
        """(customers seated, customers to seat, dishes that have so many)."""
        seated, falling = 1, -self.customers
        while True:
            live = int(np.searchsorted(falling, -seated, side="left"))
            if not live:
                return
            run = 1 if seated < EXACT else min(seated >> 6, max(1, int(self.customers[live - 1]) - seated))
            yield seated, run, live
            seated += run

    def sweep(self) -> np.ndarray:
        """Seats all customers of all dishes again; the number of tables of each dish."""
        d, n = self.discount, len(self.many)
        rest = (np.bincount(self.group, weights=self.tables, minlength=len(self.scale)) * self.scale)[self.group[self.many]] - self.tables[self.many]
        base, grow = (self.strength + d * rest) * self.parent, d * self.parent
        new, old, ratio, births = np.ones(n), np.ones(n), np.zeros(n), []
        for step, (seated, run, live) in enumerate(self.steps()):
            t = new[:live]
            opening = base[:live] + grow[:live] * t
            whole = opening + (seated - d * t)
            born = (self.rng.random(live) * whole < opening).astype(np.float64) if run == 1 else self.rng.binomial(run, opening / whole).astype(np.float64)
            births.append(born)
            if self.births is not None:
                u = old[:live]
                ratio[:live] += run * np.log(whole / (base[:live] + grow[:live] * u + (seated - d * u)))
                u += self.births[step]
            t += born
        if self.births is None:
            taken, self.births = np.ones(n, bool), births
        else:
            taken = np.log(np.maximum(self.rng.random(n), 1e-300)) < ratio
            for was, now in zip(self.births, births, strict=True):
                np.copyto(was, now, where=taken[: len(now)])
        self.tables[self.many[taken]] = new[taken].astype(np.int64)
        return self.tables.copy()

    def samples(self) -> list[np.ndarray]:
        swept = [self.sweep() for _ in range(BURN_IN + SAMPLES)]
        return swept[BURN_IN:]


def blocks(docs: DataFrame, training: Column) -> DataFrame:
    """block, doc_ids, train (flags), n (tokens of each text), codes (packed places in the list of words), low and high
    (halves of the words' hashes), counts (packed, of training tokens); cut. The last word of a list is the end token."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, column="text", most=BLOCK_BYTES):
            words, n = split_words(pc.ascii_lower(pc.fill_null(batch.column(2), "")))
            code, distinct = coded(words)
            train = np.asarray(batch.column(1))
            order = np.argsort(-np.bincount(code, minlength=len(distinct)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names = distinct.take(pa.array(order)).cast(pa.binary()).to_pylist()
            own = np.append(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names)), _END)
            code = np.insert(place[code], np.cumsum(n), len(names)).astype(np.int32)
            counts = np.bincount(code[np.repeat(train, n + 1)], minlength=len(own))
            whole = pa.array([0, len(n)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(whole, batch.column(0)),
                    pa.ListArray.from_arrays(whole, batch.column(1)),
                    pa.array([(n + 1).tolist()], pa.list_(pa.int64())),
                    pa.array([pack(code)], pa.binary()),
                    pa.array([own.astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([(own >> np.uint64(32)).astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([pack(counts.astype(np.int64))], pa.binary()),
                ],
                ["block", "doc_ids", "train", "n", "codes", "low", "high", "counts"],
            )
            block += 1

    rows = docs.select("doc_id", F.coalesce(training, F.lit(True)).alias("train"), "text")
    return cut(rows.mapInArrow(lean(run), f"block long, doc_ids array<{kind}>, train array<boolean>, n array<long>, codes binary, low binary, high binary, counts binary"), "blocks")


def cell_counts(rows: DataFrame) -> np.ndarray:
    """Training tokens by cell of the words' hashes. CELLS numbers come to the driver, one part of them from each task."""
    ranges = partitions(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for low, n in zip(batch.column(0), batch.column(1), strict=True):
                cell = np.frombuffer(low.as_buffer(), "u4") % np.uint32(CELLS)
                seen += np.bincount(cell, weights=unpack(n.as_py(), "i8"), minlength=CELLS).astype(np.int64)
        cells = np.flatnonzero(seen)
        parts = list(dealt(cells * ranges // CELLS, ranges))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([pack(cells[x].astype("u4")) for _, x in parts], pa.binary()), pa.array([pack(seen[cells[x]]) for _, x in parts], pa.binary())], ["range", "cells", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        if got:
            cells, n = np.concatenate([unpack(x, "u4") for x in got["cells"]]), np.concatenate([unpack(x, "i8") for x in got["n"]])
            distinct, back = np.unique(cells, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([pack(distinct)], pa.binary()), pa.array([pack(np.bincount(back, weights=n).astype(np.int64))], pa.binary())], ["cells", "n"])

    out = np.zeros(CELLS, np.int64)
    summed = rows.select("low", "counts").mapInArrow(lean(count), "range int, cells binary, n binary").repartitionById(ranges, "range").mapInArrow(lean(add), "cells binary, n binary")
    for cells, n in summed.toLocalIterator():
        out[unpack(cells, "u4")] = unpack(n, "i8")
    return out


class Deal:
    """Where pairs of words go. ``low``: the low halves of the words' hashes."""

    def __init__(self, cells: np.ndarray, ranges: int):
        self.cells, self.ranges, self.total, self.least = cells, ranges, max(1, int(cells.sum())), SPLIT

    def parts(self, low: np.ndarray) -> np.ndarray:
        """Over how many ranges the word's restaurant is dealt out."""
        n = self.cells[low % np.uint32(CELLS)]
        return np.where(n < self.least, 1, np.clip(-(-n * 8 * self.ranges // self.total), 1, self.ranges))

    def of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        turn = (mixed(second.astype(np.uint64)) % self.parts(first).astype(np.uint64)).astype(np.int64)
        return self.turn(first, turn)

    def turn(self, first: np.ndarray, turn: np.ndarray) -> np.ndarray:
        home = (mixed(first.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(self.ranges)).astype(np.int64)
        return (home + turn) % self.ranges

    def of_words(self, low: np.ndarray) -> np.ndarray:
        return (low % np.uint32(self.ranges)).astype(np.int64)


def pairs_of(code: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, place of each token's pair) of a block's distinct pairs, in order. ``code``: ends included."""
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1]
    before[starts(n)[:-1]] = words - 1
    pairs, place = np.unique(before * words + code, return_inverse=True)
    return pairs // words, pairs % words, place


def runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and how long they are."""
    heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
    return heads, np.diff(np.append(heads, len(first)))


def seat_contexts(rows: DataFrame, deal: Deal) -> DataFrame:
    """What the context restaurants have to say; cut.

    kind 0, to a ``block`` from a ``range``: x, the customers less discounts of its pairs; y, the tables of their contexts by
    sample. kind 1, to a ``range`` of words: x, hashes; y, tables by sample; z, customers. kind 2: the tables here (y) of a
    context (range) that is dealt out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(deal)  # CELLS numbers
    ranges = deal.ranges

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, train, n = (batch.column(k)[i].as_py() for k in range(3))
                low, high = (np.frombuffer(batch.column(k)[i].as_buffer(), "u4") for k in (4, 5))
                own, n = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), np.array(n, np.int64)
                first, second, place = pairs_of(unpack(batch.column(3)[i].as_py(), "i4"), n, len(low))
                count = np.bincount(place, weights=np.repeat(train, n), minlength=len(first)).astype(np.uint32)
                out = []
                for k, x in dealt(deal.of_pairs(low[first], low[second]), ranges):
                    heads, length = runs(first[x])
                    out.append((k, block, own[first[x][heads]].tobytes(), pack(length.astype("u4")), own[second[x]].tobytes(), pack(count[x])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["range", "block", "contexts", "lengths", "words", "counts"])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, deal = gathered(batches), shared.value
        if not got:
            return
        here = got["range"][0]
        context = [np.frombuffer(x, "u8") for x in got["contexts"]]
        length = [unpack(x, "u4").astype(np.int64) for x in got["lengths"]]
        of_context = starts(np.array([len(x) for x in context]))
        of_pair = starts(np.array([x.sum() for x in length]))
        contexts, group = np.unique(np.concatenate(context), return_inverse=True)
        each = np.repeat(group, np.concatenate(length))
        word = np.concatenate([np.frombuffer(x, "u8") for x in got["words"]])
        words, w = np.unique(word, return_inverse=True)
        _, at, back = np.unique(each * len(words) + w, return_index=True, return_inverse=True)
        c = np.bincount(back, weights=np.concatenate([unpack(x, "u4") for x in got["counts"]]), minlength=len(at)).astype(np.int64)
        known = np.flatnonzero(c)
        low = contexts.astype(np.uint32)
        parts = deal.parts(low)
        split = np.flatnonzero(parts > 1)
        scale = np.ones(len(contexts))
        scale[split] = parts[split] / [max(1, np.count_nonzero(deal.turn(np.full(p, x), np.arange(p)) == here)) for x, p in zip(low[split], parts[split].tolist(), strict=True)]
        share = np.maximum(deal.cells[words.astype(np.uint32) % np.uint32(CELLS)], 1) / deal.total
        seating = Seating(c[known], each[at[known]], share[w[at[known]]], scale, STRENGTH, DISCOUNT, here)
        samples = np.zeros((SAMPLES, len(at)), np.int64)
        samples[:, known] = seating.samples()
        tables = np.stack([np.bincount(each[at], weights=t, minlength=len(contexts)) for t in samples]).astype(np.uint32)
        mass = np.where(c > 0, c - DISCOUNT * samples.mean(axis=0), 0).astype(np.float32)[back]
        tables_here = tables[:, group]
        for i, block in enumerate(got["block"]):
            x, y = mass[of_pair[i] : of_pair[i + 1]], tables_here[:, of_context[i] : of_context[i + 1]]
            yield answer([0], [block], [here], [pack(x)], [pack(y.ravel())], [None])
        of_word = w[at[known]]
        sums = np.stack([np.bincount(of_word, weights=t[known], minlength=len(words)) for t in samples]).astype(np.int64)
        customers = np.bincount(of_word, weights=c[known], minlength=len(words)).astype(np.int64)
        live = np.flatnonzero(customers)
        parts_of = [(k, live[x]) for k, x in dealt(deal.of_words(words[live].astype(np.uint32)), ranges)]
        if parts_of:
            yield answer([1] * len(parts_of), [None] * len(parts_of), [k for k, _ in parts_of], [words[x].tobytes() for _, x in parts_of], [pack(sums[:, x].ravel()) for _, x in parts_of], [pack(customers[x]) for _, x in parts_of])
        if len(split):
            yield answer([2] * len(split), [None] * len(split), low[split].astype(np.int64).tolist(), [None] * len(split), [tables[:, k].astype("u4").tobytes() for k in split], [None] * len(split))

    def answer(*columns: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "block", "range", "x", "y", "z"])

    asked = rows.select("block", "train", "n", "codes", "low", "high").mapInArrow(lean(ask), "range int, block long, contexts binary, lengths binary, words binary, counts binary")
    return cut(asked.repartitionById(ranges, "range").mapInArrow(lean(seat), "kind int, block long, range long, x binary, y binary, z binary"), "contexts")


def seat_parent(found: DataFrame, ranges: int) -> tuple[DataFrame, dict]:
    """(range, words, c, mass): for each range of words its hashes, training tokens and, by sample, customers less
    discounts; cut. And the sums: types, tokens, by sample customers and tables."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        if got:
            n = [len(x) // 8 for x in got["x"]]
            words, back = np.unique(np.concatenate([np.frombuffer(x, "u8") for x in got["x"]]), return_inverse=True)
            each = np.concatenate([unpack(y, "i8").reshape(SAMPLES, k) for y, k in zip(got["y"], n, strict=True)], axis=1)
            tables = np.stack([np.bincount(back, weights=t, minlength=len(words)) for t in each]).astype(np.int64)
            c = np.bincount(back, weights=np.concatenate([unpack(z, "i8") for z in got["z"]]), minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([got["range"][0]], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([pack(c)], pa.binary()), pa.array([pack(tables.ravel())], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([tables.sum(axis=1).tolist()], pa.list_(pa.int64()))],
                ["range", "words", "c", "tables", "types", "tokens", "customers"],
            )

    told = found.where("kind = 1").select(F.col("range").cast("int").alias("range"), "x", "y", "z").repartitionById(ranges, "range")
    merged = cut(told.mapInArrow(lean(merge), "range int, words binary, c binary, tables binary, types long, tokens long, customers array<long>"), "merged")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    types, tokens, *customers = merged.agg(total("types"), total("tokens"), *(total(F.get("customers", F.lit(k))) for k in range(SAMPLES))).first()

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                here, n = one.column(0)[0].as_py(), one.column(4)[0].as_py()
                mass, opened = [], []
                for k, t in enumerate(unpack(one.column(3)[0].as_py(), "i8").reshape(SAMPLES, n)):
                    seating = Seating(t, np.zeros(n, np.int64), np.full(n, 1 / (types + 1)), np.array([types / n]), PARENT_STRENGTH, PARENT_DISCOUNT, here * SAMPLES + k)
                    tables = seating.samples()[-1]
                    mass.append(t - PARENT_DISCOUNT * tables)
                    opened.append(int(tables.sum()))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([pack(np.concatenate(mass).astype(np.float32))], pa.binary()), pa.array([opened], pa.list_(pa.int64()))], ["range", "words", "c", "mass", "opened"])

    seated = cut(merged.mapInArrow(lean(seat), "range int, words binary, c binary, mass binary, opened array<long>"), "parent")
    opened = seated.agg(*(total(F.get("opened", F.lit(k))) for k in range(SAMPLES))).first()
    return seated.drop("opened"), {"types": types, "tokens": tokens, "customers": customers, "opened": list(opened)}


def look_up(rows: DataFrame, parent: DataFrame, deal: Deal) -> DataFrame:
    """(kind 2, block, range, x, y): for each block and range of words their training tokens and, by sample, masses; cut."""
    ranges = deal.ranges

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, high = (np.frombuffer(batch.column(k)[i].as_buffer(), "u4") for k in (1, 2))
                parts = list(dealt((low % np.uint32(ranges)).astype(np.int64), ranges))
                own = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array([own[x].tobytes() for _, x in parts], pa.binary())], ["range", "block", "words"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        words, c, mass = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((SAMPLES, 0), np.float32)
        for i, block in enumerate(got.get("block", [])):
            if block is None:
                words, c = np.frombuffer(got["words"][i], "u8"), unpack(got["c"][i], "i8")
                mass = unpack(got["mass"][i], "f4").reshape(SAMPLES, len(words))
        c, mass = np.append(c, 0), np.append(mass, np.zeros((SAMPLES, 1), np.float32), axis=1)
        for i, block in enumerate(got.get("block", [])):
            if block is not None:
                asked = np.frombuffer(got["words"][i], "u8")
                at = np.searchsorted(words, asked)
                at[np.append(words, np.uint64(0))[at] != asked] = len(words)
                at[at >= len(words)] = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([block], pa.int64()), pa.array([got["range"][i]], pa.int64()), pa.array([pack(c[at])], pa.binary()), pa.array([pack(mass[:, at].ravel())], pa.binary())], ["kind", "block", "range", "x", "y"])

    none = F.lit(None).cast("binary")
    asked = rows.select("block", "low", "high").mapInArrow(lean(ask), "range int, block long, words binary").select("range", "block", "words", none.alias("c"), none.alias("mass"))
    both = asked.union(parent.select("range", F.lit(None).cast("long"), "words", "c", "mass"))
    return cut(both.repartitionById(ranges, "range").mapInArrow(lean(tell), "kind int, block long, range long, x binary, y binary"), "words")


def pair_probabilities(block: dict, told: dict, asked: dict, deal: Deal, sums: dict, split: dict) -> tuple:
    """(first, second, place of each token's pair, p, training tokens of each word, sums) of a block's distinct pairs.

    ``told`` and ``asked``: by range, what came back about the block's pairs and words.
    """
    low, n = np.frombuffer(block["low"], "u4"), np.array(block["n"], np.int64)
    c, mass = np.zeros(len(low), np.int64), np.zeros((SAMPLES, len(low)))
    for k, x in dealt(deal.of_words(low), deal.ranges):
        c[x], mass[:, x] = unpack(asked[k][0], "i8"), unpack(asked[k][1], "f4").reshape(SAMPLES, len(x))
    customers, opened = (np.array(sums[k], float)[:, None] for k in ("customers", "opened"))
    of_word = (mass + (PARENT_STRENGTH + PARENT_DISCOUNT * opened) / (sums["types"] + 1)) / (PARENT_STRENGTH + customers)
    first, second, place = pairs_of(unpack(block["codes"], "i4"), n, len(low))
    own, tables = np.zeros(len(first)), np.zeros((SAMPLES, len(first)))
    for k, x in dealt(deal.of_pairs(low[first], low[second]), deal.ranges):
        _, length = runs(first[x])
        own[x], tables[:, x] = unpack(told[k][0], "f4"), np.repeat(unpack(told[k][1], "u4").reshape(SAMPLES, len(length)), length, axis=1)
    for i in np.flatnonzero(deal.parts(low) > 1).tolist():
        if int(low[i]) in split:
            tables[:, first == i] = split[int(low[i])][:, None]
    p = (own + ((STRENGTH + DISCOUNT * tables) * of_word[:, second]).mean(axis=0)) / (STRENGTH + c[first])
    return first, second, place, p, c, sums


def seated(docs: DataFrame, training: Column) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Blocks, what contexts and what words answer to them, and (deal, sums, tables of contexts that are dealt out)."""
    rows = blocks(docs, training)
    deal = Deal(cell_counts(rows), partitions(docs.sparkSession))
    found = seat_contexts(rows, deal)
    parent, sums = seat_parent(found, deal.ranges)
    words = look_up(rows, parent, deal)
    split: dict[int, np.ndarray] = {}
    for low, tables in found.where("kind = 2").select("range", "y").collect():  # at most 16 for each range
        split[low] = split.get(low, 0) + np.frombuffer(tables, "u4").astype(np.float64)
    return rows, found, words, (deal, sums, split)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    ``base_score`` is that of single words, add-one smoothed; ``score`` is the model's log10 probability of the text.
    """
    spark = docs.sparkSession
    rows, found, words, known = seated(docs, training)
    shared, sums, deal = spark.sparkContext.broadcast(known), known[1], known[0]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add_up(block: dict, told: dict, asked: dict) -> pa.RecordBatch:
        n = np.array(block["n"], np.int64)
        _, second, place, p, c, sums = pair_probabilities(block, told, asked, *shared.value)
        code = second[place]
        doc = np.repeat(np.arange(len(n)), n)
        base = np.log10((c + 1) / (sums["tokens"] + sums["types"] + 1))
        tokens = base[code], np.log10(p)[place], (c > 0).astype(float)[code]
        added = [np.bincount(doc, weights=x, minlength=len(n)) for x in tokens]
        return pa.RecordBatch.from_arrays(
            [pa.array(block["doc_ids"], ids), pa.array(block["train"], pa.bool_()), pa.array(n), pa.array(np.rint(added[2]).astype(np.int64)), pa.array(added[0]), pa.array(added[1])],
            ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(docs.schema["doc_id"].dataType)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a block come in turn: itself, its pairs, its words."""
        block, told, asked = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                at = row["kind"].as_py()
                if at == 0:
                    if block is not None:
                        yield add_up(block, told, asked)
                    block, told, asked = {k: row[k].as_py() for k in ("doc_ids", "train", "n", "codes", "low")}, {}, {}
                else:
                    (told if at == 1 else asked)[row["range"].as_py()] = row["x"].as_py(), row["y"].as_py()
        if block is not None:
            yield add_up(block, told, asked)

    columns = ["doc_ids", "train", "n", "codes", "low"]
    empty = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in columns]
    no = F.lit(None).cast("binary")
    parts = rows.select(F.lit(0).alias("kind"), "block", F.lit(0).cast("long").alias("range"), *columns, no.alias("x"), no.alias("y"))
    parts = parts.union(found.where("kind = 0").select(F.lit(1), "block", "range", *empty, "x", "y")).union(words.select("kind", "block", "range", *empty, "x", "y"))
    order = ["block", "kind", "range"]
    together = parts.repartition(deal.ranges, "block").sortWithinPartitions(*order).select("kind", "range", *columns, "x", "y")
    out = together.mapInArrow(lean(finish), f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
