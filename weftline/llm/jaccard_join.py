"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct word 5-grams. Two sets link at Jaccard similarity ``SIMILAR`` per cent or more. The
join finds every link that connects anything: documents of equal sets form one class first (copies meet in an
aggregation, never in pairs), and what is returned are the components of classes under links.

1. Order. Any two linked sets share an element among the first ``n - ceil(0.8 n) + 1`` of each, their prefixes, in any
   fixed order of elements. The order here is by frequency, then by hash: elements of all texts are counted, and two
   tables of bounded size, ``Frequencies``, tell those found once from the rest, and the frequent ones by the logarithm
   of their count. Few others hold what is in a prefix then, and passages that many documents share are no reason to
   compare them. The tables blur as more elements share a cell, which costs time and loses nothing.
2. Stars. Classes that share one of the first ``KEYS`` elements that are found twice or more are compared with two
   pivots of their group. Most near copies are joined by this, at a number of pairs that grows with the classes, not
   with the square of a group.
3. Tiles. Prefix elements whose holders are all in one component already are dropped. The others' holders meet in
   tiles of (element, band of set sizes); a set meets its own band and the one below. The holders in the element's
   largest component never meet each other, only the rest, so that a group of near copies costs its stragglers times
   its size and not its square. Each side is dealt into parts of ``TILE`` holders.

Bit counts of the signatures bound the overlap from above (each bit that only one set has is an element that the other
lacks): tiles emit the pairs only that may reach the threshold by signatures folded to ``BITS`` bits, and of all pairs
those that may by their full signatures are verified by intersecting sorted arrays. The components come from large-star and small-star steps, each an aggregation and a join.

Elements are 64-bit hashes, classes 128-bit digests. Counts of elements are shuffled as packed arrays, one row for
each task and range of hashes. Texts are stored once beside the hashes, and are joined to candidate pairs only; a bit
table of fixed size tells beforehand which texts no pair needs (some needless ones pass, no needed one is lost).

Defined results: null, empty and all-space texts have no set (size 0) and link with nothing: their component is their
own id. Texts of under 5 words have one element, their whole sequence. Very long texts are whole sets like all others,
with longer signatures. Repeated ids keep their rows; rows of equal text are one class whatever their ids. A component
of rows whose ids are all null has a null id. No rows, no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import among, coded, cut, dealt, gathered, lean, mixed, numbers, partitions, slices, split_words, starts

SHINGLE, SIMILAR = 5, 80
KEYS, BITS, TILE = 6, 1024, 512
#: Pairs that may be broadcast, and links that one task contracts: 24 bytes each.
SMALL, CONTRACTED = 1 << 16, 1 << 20
#: Cells of a byte for elements found LEAST times or more, and of a bit for those found twice or more: so many for each
#: row, between these bounds.
CELLS, LEAST = 1 << 23, 4
BIT_CELLS, LEAST_BITS, MOST_BITS = 512, CELLS, 1 << 30
#: Elements that a task gathers before it deals them out.
HELD = 1 << 21
#: Pairs of signatures compared at once.
CHUNK = 1 << 15
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct elements of all texts, in turn, and how many each text has."""
    words, n = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    code, distinct = coded(words)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[code] if len(code) else np.zeros(0, np.uint64)
    at = starts(n)
    whole = np.zeros(max(0, len(own) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole += own[k : k + len(whole)] * _ODD[k]
    whole = mixed(whole)
    out, size = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n).tolist():
        a, b = at[i], at[i + 1]
        if b - a >= SHINGLE:
            s = np.unique(whole[a : b - SHINGLE + 1])
        else:
            s = mixed((own[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        out.append(s)
        size[i] = len(s)
    return np.concatenate([np.zeros(0, np.uint64), *out]), size


def needed(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The least overlap at which sets of these sizes link: 100 * o >= SIMILAR * (a + b - o)."""
    return -(-SIMILAR * (small + large) // (100 + SIMILAR))


def prefix_length(size: int) -> int:
    return size - -(-SIMILAR * size // 100) + 1


def signature(elements: np.ndarray) -> bytes:
    """Twice as many bits as elements or more, a power of two: fuller signatures would bound little."""
    n = max(BITS, 1 << (2 * max(1, len(elements)) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[(elements >> np.uint64(20)) % np.uint64(n)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes) -> bytes:
    """A signature of BITS bits, each of which stands for several."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, BITS >> 6), axis=0).tobytes()


def alike(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, signatures of a, of b) for rows of equal sizes; the larger signature is folded onto the smaller."""
    sizes = np.stack([np.asarray(pc.binary_length(x), dtype=np.int64) for x in (a, b)], axis=1)
    for la, lb in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        sides = []
        for column, size in ((a, la), (b, lb)):
            raw = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint64)
            sides.append(np.bitwise_or.reduce(raw.reshape(len(rows), size // min(la, lb), min(la, lb) // 8), axis=1))
        yield rows, *sides


def bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """No overlap can be larger than this, by the bits that only one of two signatures has."""
    lacks = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    other = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - lacks, nb - other)


class Frequencies:
    """How often elements are found, roughly: each cell holds the most frequent of the elements that fall into it."""

    def __init__(self, bits: int):
        self.bits = np.zeros(bits >> 3, np.uint8)
        self.levels = np.zeros(CELLS, np.uint8)

    def of(self, elements: np.ndarray) -> np.ndarray:
        """0 for an element found once, 1 if twice or more, and more for frequent ones."""
        at = (elements % np.uint64(len(self.bits) << 3)).astype(np.int64)
        often = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return np.maximum(often, np.where(often, self.levels[(elements % np.uint64(CELLS)).astype(np.int64)], 0))


def frequencies(docs: DataFrame) -> Frequencies:
    """Counts the elements of all texts, by ranges of their hashes. A range's task sends its part of the tables only.

    Elements are told apart by 32 bits of their hashes here: it is only the order that depends on it.
    """
    ranges = partitions(docs.sparkSession)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BIT_CELLS * docs.count() - 1).bit_length()))
    first_of = lambda k: -(-k * (CELLS >> 3) // ranges) << 3  # noqa: E731  a range has whole bytes of the table of bits

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        low, n = np.unique(np.concatenate(held), return_counts=True)
        parts = list(dealt((low.astype(np.int64) % CELLS >> 3) * ranges // (CELLS >> 3), ranges))
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([low[rows].tobytes() for _, rows in parts], pa.binary()), pa.array([n[rows].astype(np.uint32).tobytes() for _, rows in parts], pa.binary())],
            ["range", "e", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, most=4 << 20):
            held.append(shingle_sets(batch.column(0))[0].astype(np.uint32))
            size += len(held[-1])
            if size >= HELD:
                yield deal(held)
                held, size = [], 0
        if size:
            yield deal(held)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        if got:
            k = got["range"][0]
            low, n = numbers(got["e"], "u4"), numbers(got["n"], "u4").astype(np.int64)
            order = np.argsort(low, kind="stable")
            low, heads = np.unique(low[order], return_index=True)
            n = np.add.reduceat(n[order], heads)
            often = n >= LEAST
            first, width = first_of(k), first_of(k + 1) - first_of(k)
            cells = np.zeros(width, np.uint8)
            np.maximum.at(cells, low[often].astype(np.int64) % CELLS - first, np.log2(n[often]).astype(np.uint8))
            # all bits whose cells are of this range
            at = low[n > 1].astype(np.int64) % bits
            twice = np.zeros((bits // CELLS, width), bool)
            twice[at // CELLS, at % CELLS - first] = True
            blob = zstandard.compress(cells.tobytes() + np.packbits(twice, axis=1, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([width], pa.int64()), pa.array([blob], pa.binary())], ["first", "width", "tables"])

    counted = docs.select("text").mapInArrow(lean(count), "range int, e binary, n binary").repartitionById(ranges, "range")
    out = Frequencies(bits)
    table = out.bits.reshape(bits // CELLS, CELLS >> 3)
    for first, width, blob in counted.mapInArrow(lean(level), "first long, width long, tables binary").toLocalIterator():  # the tables' cells
        raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
        out.levels[first : first + width] = raw[:width]
        table[:, first >> 3 : (first + width) >> 3] = raw[width:].reshape(bits // CELLS, width >> 3)
    return out


def prepare(docs: DataFrame, carry: bool = False) -> DataFrame:
    """row, doc_id, n, d1, d2 (digest), keys, prefix, bits, mark (bits, folded) and text of every row, cut; with ``carry``, its further columns too."""
    levels = docs.sparkSession.sparkContext.broadcast(frequencies(docs))  # CELLS bytes and MOST_BITS bits at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, table = TaskContext.get().partitionId() << 40, levels.value
        for batch in slices(batches, most=4 << 20):
            elements, size = shingle_sets(batch.column(1))
            at, full = starts(size), np.flatnonzero(size)
            d = np.zeros((2, len(size)), np.uint64)
            if len(full):
                for k in range(2):
                    d[k, full] = np.add.reduceat(mixed(elements * _ODD[k]), at[full])
            level = table.of(elements)
            keys, prefix, bits = [], [], []
            for i in range(len(size)):
                own = elements[at[i] : at[i + 1]]
                p = prefix_length(int(size[i])) if size[i] else 0
                order = np.argsort(level[at[i] : at[i + 1]], kind="stable")
                prefix.append(own[order[:p]].view(np.int64))
                once = np.count_nonzero(level[at[i] : at[i + 1]] == 0)
                keys.append(own[order[once : once + KEYS]].view(np.int64))
                bits.append(signature(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(size))),
                    batch.column(0),
                    pa.array(size),
                    pa.array(d[0].view(np.int64)),
                    pa.array(d[1].view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(prefix, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                    pa.array(map(folded, bits), pa.binary()),
                    *batch.columns[1:],
                ],
                ["row", "doc_id", "n", "d1", "d2", "keys", "prefix", "bits", "mark", *batch.schema.names[1:]],
            )
            row += len(size)

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if carry and others else []))
    schema = T.StructType(T._parse_datatype_string(f"row long, doc_id {kind}, n long, d1 long, d2 long, keys array<long>, prefix array<long>, bits binary, mark binary").fields + rows.schema.fields[1:])
    return cut(rows.mapInArrow(lean(run), schema), "shingles")


def verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their signatures and exact intersection. ``pairs``: a table of distinct pairs.

    Each pair's two texts meet in one exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stand by pair, its smaller node first; the first of a pair may come at the end of a batch."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks()
            whole = table.num_rows // 2 * 2
            rest = table.slice(whole).combine_chunks().to_batches()[0] if whole < table.num_rows else None
            for part in table.slice(0, whole).combine_chunks().to_batches():
                yield from linked(part)

    sides = lambda own, other: pairs.select(F.col(own).alias("at"), "a", "b", (F.lit(own) == F.lit("b")).alias("second"))  # noqa: E731, ARG005
    both = sides("a", "b").union(sides("b", "a"))
    texts = among(rows.where("n > 0").select("row", "n", "bits", "text"), "row", both.select("at"))
    joined = texts.join(F.broadcast(both) if pairs.count() <= SMALL else both, F.col("row") == F.col("at"))
    joined = joined.select("a", "b", "second", "n", "bits", "text").repartition("a", "b").sortWithinPartitions("a", "b", "second")
    return cut(joined.mapInArrow(lean(run), "a long, b long"), "links")


def linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs that link. ``batch``: a, b, second, n, bits, text; two rows for each pair, in turn."""
    odd, even = pa.array(np.arange(0, batch.num_rows, 2)), pa.array(np.arange(1, batch.num_rows, 2))
    n = np.asarray(batch.column(3))
    small, large = n[::2], n[1::2]
    near = np.zeros(len(small), bool)
    for rows, x, y in alike(batch.column(4).take(odd), batch.column(4).take(even)):
        near[rows] = bound(x, small[rows], y, large[rows]) >= needed(small[rows], large[rows])
    near &= np.minimum(small, large) * 100 >= SIMILAR * np.maximum(small, large)
    for part in slices(iter([batch.filter(pa.array(np.repeat(near, 2)))]), most=2 << 20, each=2):
        first = part.column(5).dictionary_encode()  # a pivot stands in many rows
        place = np.asarray(first.indices)
        elements, size = shingle_sets(first.dictionary)
        at, keep = starts(size), []
        for i, j in zip(place[::2].tolist(), place[1::2].tolist(), strict=True):
            both = len(np.intersect1d(elements[at[i] : at[i + 1]], elements[at[j] : at[j + 1]], assume_unique=True))
            keep.append(100 * both >= SIMILAR * (int(size[i] + size[j]) - both))
        kept = pa.array(np.arange(0, part.num_rows, 2)[np.array(keep, bool)])
        yield pa.RecordBatch.from_arrays([c.take(kept) for c in part.columns[:2]], ["a", "b"])


def stars(groups: DataFrame) -> DataFrame:
    """Pairs of two pivots of each group with each other member, as far as sizes allow a link; cut.

    ``groups``: key, node, n.
    """
    by = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    pivots = groups.groupBy("key").agg(F.array(F.min(by), F.max(by)).alias("two"), F.count("*").alias("m")).where("m > 1")
    pivots = pivots.select(F.col("key").alias("pkey"), F.explode("two").alias("p")).select("pkey", F.col("p.node").alias("a"), F.col("p.n").alias("size"))
    close = F.least("n", "size") * 100 >= SIMILAR * F.greatest("n", "size")
    pairs = groups.join(pivots, F.col("key") == F.col("pkey")).where((F.col("node") != F.col("a")) & close)
    return cut(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")


def open_elements(prefixes: DataFrame) -> DataFrame:
    """(e): the prefix elements whose holders are not all in one component. ``prefixes``: node, comp, prefix."""
    ranges = partitions(prefixes.sparkSession)

    def merged(e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(e, kind="stable")
        e, heads = np.unique(e[order], return_index=True)
        return e, np.minimum.reduceat(lo[order], heads), np.maximum.reduceat(hi[order], heads)

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        comp = np.concatenate([x[1] for x in held])
        found = merged(np.concatenate([x[0] for x in held]), comp, comp)
        parts = list(dealt((found[0].view(np.uint64) % np.uint64(ranges)).astype(np.int64), ranges))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *(pa.array([x[rows].tobytes() for _, rows in parts], pa.binary()) for x in found)], ["range", "e", "lo", "hi"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            e = np.asarray(batch.column(1).flatten(), dtype=np.int64)
            held.append((e, np.repeat(np.asarray(batch.column(0)), np.asarray(pc.list_value_length(batch.column(1)), dtype=np.int64))))
            size += len(e)
            if size >= HELD:
                yield deal(held)
                held, size = [], 0
        if size:
            yield deal(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        if got:
            e, lo, hi = merged(*(numbers(got[k], "i8") for k in ("e", "lo", "hi")))
            yield pa.RecordBatch.from_arrays([pa.array(e[lo < hi])], ["e"])

    counted = prefixes.select("comp", "prefix").mapInArrow(lean(spread), "range int, e binary, lo binary, hi binary").repartitionById(ranges, "range")
    return cut(counted.mapInArrow(lean(gather), "e long"), "open")


def holders(classes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(e, node, comp, n, mark): all holders of the prefix elements that more than one component holds; cut.

    ``prefixes``: node, comp, prefix; ``classes``: node, n, mark.
    """
    wanted = open_elements(prefixes)
    held = among(prefixes.select("node", "comp", F.explode("prefix").alias("e")), "e", wanted)
    held = cut(held.join(wanted.withColumnRenamed("e", "oe"), F.col("e") == F.col("oe")).select("e", "node", "comp"), "held")
    known = among(classes.select("node", "n", "mark"), "node", held.select("node")).withColumnRenamed("node", "v")
    return cut(held.join(known, F.col("node") == F.col("v")).drop("v"), "held")


def tiles(held: DataFrame, every: bool) -> DataFrame:
    """Pairs of classes in different components that share a prefix element and may link by size and signature.

    ``held``: as from ``holders``. Without ``every``, each component's likeliest pair alone: as many as components at most,
    in each task. Such turns join most of them, and leave the last, complete one little to do.
    """
    per_comp = held.groupBy("e", "comp").agg(F.count("*").alias("c"))
    largest = per_comp.groupBy(F.col("e").alias("oe")).agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m")).where("top.c < m")
    sides = lambda c: F.greatest(F.lit(1), F.ceil(c / TILE)).cast("int")
    largest = cut(largest.select("oe", F.col("top.comp").alias("most"), sides(F.col("top.c")).alias("wide"), sides(F.col("m") - F.col("top.c")).alias("narrow")), "largest")  # written, so that a hot element's holders can be split in the join
    rows = held.join(largest, F.col("e") == F.col("oe")).drop("oe")
    inner = F.col("comp") == F.col("most")
    part = F.pmod(F.xxhash64("node"), F.when(inner, F.col("wide")).otherwise(F.col("narrow"))).cast("int")
    # x: a part of the stragglers; y: a part of the largest component, or below 0 another part of the stragglers
    with_rest = F.transform(F.sequence(F.lit(0), F.col("narrow") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("x"), (-1 - F.greatest(i, F.col("part"))).alias("y")))
    with_most = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.struct(F.col("part").alias("x"), j.alias("y")))
    of_most = F.transform(F.sequence(F.lit(0), F.col("narrow") - 1), lambda i: F.struct(i.alias("x"), F.col("part").alias("y")))
    band = F.floor(F.log("n") / float(np.log(100 / SIMILAR)) + 1e-9).cast("int")
    rows = rows.withColumns({"band": band, "inner": inner, "part": part})
    rows = rows.withColumn("at", F.explode(F.when(F.col("inner"), of_most).otherwise(F.concat(with_most, with_rest))))
    rows = rows.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))
    key = ["e", "tile", "x", "y"]
    rows = rows.select("e", "tile", "at.x", "at.y", "inner", (F.col("tile") == F.col("band")).alias("home"), "part", "node", "n", "comp", "mark")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come whole and in turn; the last of a batch may go on in the next."""
        rest: list[pa.RecordBatch] = []
        found: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            pairs = found.pop("pairs")
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def add(table: pa.Table, heads: np.ndarray) -> bool:
            new = pairs_in(table, heads)
            new = new[:, :2] if every else new
            both = np.concatenate([found["pairs"], new]) if "pairs" in found else new
            if every:
                found["pairs"] = np.unique(both, axis=0)
            else:
                both = both[np.lexsort(both.T[[1, 0, 4]])]
                ends = np.concatenate([both[:, 2], both[:, 3]])
                place = np.tile(np.arange(len(both)), 2)[np.argsort(ends, kind="stable")]
                heads = np.unique(np.sort(ends), return_index=True)[1]
                found["pairs"] = both[np.unique(np.minimum.reduceat(place, heads))] if len(both) else both
            return len(found["pairs"]) > HELD >> 2

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            table = pa.Table.from_batches(rest)
            heads = tile_heads(table)
            last = int(heads[-1])
            if last:
                if add(table.slice(0, last), heads):
                    yield emit()
                rest = table.slice(last).combine_chunks().to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            add(table, np.append(tile_heads(table), table.num_rows))
        if found:
            yield emit()

    return cut(rows.mapInArrow(lean(run), "a long, b long").distinct(), "bounded")


def tile_heads(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in range(4):
        c = np.asarray(table.column(k))
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def pairs_in(table: pa.Table, heads: np.ndarray) -> np.ndarray:
    """Pairs within tiles that sizes, components and signatures allow: two nodes, their components, and in thousandths
    what they lack of the highest similarity. ``heads``: where each tile begins, and where the last ends.

    Rows at distance 1, 2, ... are paired for all tiles at once, as long as any is that long; where one side is the
    largest component, its rows stand in large tiles and are paired with the other side's only.
    """
    y, inner, home = (np.asarray(table.column(k)) for k in (3, 4, 5))
    part, node, n, comp = (np.asarray(table.column(k)) for k in (6, 7, 8, 9))
    marks = table.column(10).combine_chunks()
    marks = marks if isinstance(marks, pa.Array) else pa.concat_arrays(marks.chunks)
    _, place = np.unique(node, return_index=True)
    found = [np.zeros((0, 2), np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = (comp[i] != comp[j]) & (home[i] | home[j]) & (np.minimum(n[i], n[j]) * 100 >= SIMILAR * np.maximum(n[i], n[j]))
        ok &= (y[i] < 0) | (inner[i] != inner[j])
        i, j = i[ok], j[ok]
        if len(i):
            found.append(np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0))

    length = np.diff(heads)
    end = np.repeat(heads[1:], length)
    live, k = np.flatnonzero(np.repeat(length <= 64, length)), 0
    while len(live):
        k += 1
        live = live[live + k < end[live]]
        keep(live, live + k)
    for a, b in zip(heads[:-1][length > 64].tolist(), heads[1:][length > 64].tolist(), strict=True):
        own = np.arange(a, b)
        one, other = (own, own) if y[a] < 0 else (own[~inner[a:b]], own[inner[a:b]])
        step = max(1, (1 << 20) // max(1, len(other)))
        for c in range(0, len(one), step):
            i, j = np.repeat(one[c : c + step], len(other)), np.tile(other, len(one[c : c + step]))
            keep(*((i[i < j], j[i < j]) if y[a] < 0 else (i, j)))
    pairs = np.unique(np.concatenate(found), axis=0)
    nodes = node[place]
    most = np.zeros(len(pairs), np.int64)
    i, j = (place[np.searchsorted(nodes, pairs[:, k])] for k in (0, 1))
    for c in range(0, len(pairs), CHUNK):
        one, other = i[c : c + CHUNK], j[c : c + CHUNK]
        for rows, s, t in alike(marks.take(pa.array(one)), marks.take(pa.array(other))):
            most[c + rows] = bound(s, n[one[rows]], t, n[other[rows]])
    good = most >= needed(n[i], n[j])
    i, j, most = i[good], j[good], most[good]
    lacks = 1000 - 1000 * most // np.maximum(1, n[i] + n[j] - most)
    return np.stack([node[i], node[j], np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), lacks], axis=1)


def contract(edges: DataFrame) -> DataFrame:
    """(x, y, task): each partition's links (x, y) replaced by links of its nodes to the least node of their component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["x", "y"])])
        if not table.num_rows:
            return
        nodes, at = np.unique(np.concatenate([np.asarray(table.column(k)) for k in (0, 1)]), return_inverse=True)
        a, b = at[: table.num_rows], at[table.num_rows :]
        least = np.arange(len(nodes))
        while True:
            x, y = least[a], least[b]
            if (x == y).all():
                break
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (least[least] != least).any():
                least = least[least]
        own = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]]), pa.array(np.full(len(own), TaskContext.get().partitionId()))], ["x", "y", "task"])

    return cut(edges.mapInArrow(lean(run), "x long, y long, task long"), "edges")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link; comp is the least node of its component.

    Partitions contract their own links first. If one held them all, that is the result; else large-star and small-star
    steps follow until nothing changes.
    """
    tasks = -(-links.count() // CONTRACTED) or 1
    edges = contract(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").coalesce(tasks))
    mark = None
    while True:
        low, high, *now = edges.agg(F.min("task"), F.max("task"), F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        edges = edges.select("x", "y")
        if low == high or now == mark:
            break
        mark = now
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), F.least("x", "m").alias("m"))
        large = both.join(least, F.col("x") == F.col("u")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x > y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least.select(F.col("x").alias("u"), "m"), F.col("x") == F.col("u")).where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = contract(cut(small.union(least).distinct(), "edges").coalesce(tasks))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("comp")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct())


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with comp."""
    found = components(links).withColumnRenamed("node", "v")
    found = F.broadcast(found) if 2 * links.count() <= CONTRACTED else found  # no more rows than ends of links
    out = classes.drop("comp").join(found, F.col("node") == F.col("v"), "left").drop("v")
    return out.withColumn("comp", F.coalesce("comp", "node"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (null without a set) and component_id of every row."""
    return joined(prepare(docs)).select("doc_id", "n_shingles", "class_id", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each component only the one with the smallest id (nulls last)."""
    rows = prepare(docs, carry=True)
    found = joined(rows).where("class_id is not null")
    firsts = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("first"))
    kept = firsts.union(rows.where("n = 0").select(F.col("row").alias("first")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = rows.select("row", "doc_id", "text", *(["others"] if others else [])).join(kept, F.col("row") == F.col("first"), "left_semi")
    return out.select(*(c if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns))


def joined(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, class_id, comp and component_id for every row of a prepared table."""
    some = rows.where("n > 0")
    classes = cut(some.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.min("n").alias("n"), *(F.min_by(c, "row").alias(c) for c in ("keys", "prefix", "mark"))), "classes")
    links = verify(stars(classes.select("node", "n", F.explode("keys").alias("key"))), rows)
    held = holders(classes, labelled(classes.select("node", "prefix"), links).select("node", "comp", "prefix"))
    for every in (False, True):
        links = links.union(verify(tiles(held, every), rows))
        if not every:
            comps = labelled(classes.select("node"), links).select(F.col("node").alias("v"), "comp")
            held = held.drop("comp").join(comps, F.col("node") == F.col("v")).drop("v")
    comps = labelled(classes.select("node", "d1", "d2", "doc"), links)
    named = comps.groupBy("comp").agg(F.min("doc").alias("component_id"))
    comps = cut(comps.join(named, "comp").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "node", "comp", "component_id"), "comps")
    out = rows.select("row", "doc_id", "n", "d1", "d2").join(comps, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0), "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")
