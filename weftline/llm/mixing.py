"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule, piecewise linear over the course of training (0 to 1). Its integral, scaled to the
source's target, is the source's cumulative token demand. The source's documents stand in a fixed pseudo-random order
(md5 of the id), and go round again once used up; the demand curve is inverted at the offset of each document's first
word, which gives the document's training position. Copies are then range-sorted by position over all sources.

Targets: all sources share ``epochs`` times all words by weight; none gets more than ``most`` times its own words, and
the excess is shared again by weight until none is above. That is water-filling, solved in closed form over the
sources sorted by cap / weight.

A source is never gathered in one task: its documents fall into buckets by hash, offsets within a bucket come from a
window over (source, bucket), and those of the buckets from a window over the small table of bucket totals, whose
rows also carry the target, so that one exchange of (id, size) serves join and window.

Defined results: a null text has size 0 and is never taken; documents of size 0 are not placed. A null source is a
source of its own and ranks last. Documents whose id and size are equal may change places, which changes no result.
Ids are taken to be nearly unique: rows of one id stand in one bucket.
Without words every target is 0. Very long texts are counted whole. Empty tables give empty ones. Columns other than doc_id, text and source pass
through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, n_words, partitions

WEIGHTS = (5, 2, 1)
EPOCHS, MOST = 1.5, 2
#: Documents of a bucket, about.
BUCKET_ROWS = 2_000
#: Bins of training positions for each partition of the result.
FINE = 64

#: By rank of the source: (time, weight) knots from 0 to 1. The first kind fades, the second stays, the third rises.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.0)))


def inverse_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the schedule's integral reaches ``share`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, out, before = sum(areas), None, 0.0
    pieces = []
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        need, slope = share * whole - before, (b[1] - a[1]) / (b[0] - a[0])
        # a[1] * x + slope / 2 * x * x = need, in the form that also holds for a slope of 0
        x = 2 * need / (a[1] + F.sqrt(F.greatest(F.lit(0.0), a[1] * a[1] + 2 * slope * need)))
        before += area
        pieces.append((before / whole, a[0] + F.coalesce(x, F.lit(0.0))))
    out = F.least(pieces[-1][1], F.lit(1.0))
    for upper, time in reversed(pieces[:-1]):
        out = F.when(share < upper, time).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """(source, source_size) with rank and target. One row for each source passes through one task."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = ranked.withColumns(
        {
            "left": epochs * F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio) - F.col("cap")),
            "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.col("left") / F.col("open")
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    filled = filled.withColumn("level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _placed(base: DataFrame, weights: tuple[int, ...], epochs: float, most: int, schedules) -> DataFrame:
    """``base`` (doc_id, source, size, key and others; a table) with source_size, target, copies and positions."""
    buckets = max(1, -(-base.count() // BUCKET_ROWS))
    spread = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    base = base.withColumn("bucket", F.floor(spread * F.lit(buckets) / F.lit(16**12)).cast("long"))

    totals = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = totals.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    per_source = targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs, most)
    per_bucket = before.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "rank", "source_size", "target")

    placed = base.join(per_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    placed = placed.withColumn("offset", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rank, positions = F.col("rank"), []
    for epoch in range(most):
        at = F.col("offset") + epoch * F.col("source_size")
        share = at / F.col("target")
        time = inverse_demand(share, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            time = F.when((rank - 1) % len(schedules) == i, inverse_demand(share, knots)).otherwise(time)
        positions.append(F.when((F.col("size") > 0) & (at < F.col("target")), time))
    positions = F.filter(F.array(*positions), lambda x: x.isNotNull())
    return placed.withColumn("positions", positions).withColumn("copies", F.size("positions"))


def assign(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST, schedules=SCHEDULES, size: Callable[[Column], Column] = n_words) -> DataFrame:
    """For each row doc_id, source, size, source_size, target, taken, copies and positions (one for each copy, ascending)."""
    base = cut(docs.select("doc_id", "source", size(F.col("text")).alias("size"), _key().alias("key")), "sizes")
    placed = _placed(base, weights, epochs, most, schedules)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "positions")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST, schedules=SCHEDULES, size: Callable[[Column], Column] = n_words) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    Rows are numbered and positions found without their texts. The boundaries of the final ranges come from the words
    at each position, so texts meet their positions in one exchange and are sorted by the next, without sampling.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size(F.col("text")).alias("size"), _key().alias("key"), F.monotonically_increasing_id().alias("number")), "rows")
    placed = _placed(rows.drop("row"), weights, epochs, most, schedules)
    placed = cut(placed.select("number", "size", F.explode("positions").alias("position")), "positions")
    parts = partitions(spark)
    bins = FINE * parts
    placed = placed.withColumn("bin", F.least(F.floor(F.col("position") * bins), F.lit(bins - 1)).cast("int"))
    words = sorted(placed.groupBy("bin").agg(F.sum("size")).collect())  # FINE rows for each partition at most
    total, seen, dealt = sum(n for _, n in words) or 1, 0, []
    for k, n in words:
        dealt.append((k, min(parts - 1, seen * parts // total)))
        seen += n
    ranges = spark.createDataFrame(dealt, "b int, part int")
    placed = placed.join(F.broadcast(ranges), F.col("bin") == F.col("b")).select("number", "position", "part")
    found = placed.join(rows.select(F.col("number").alias("m"), "row"), F.col("number") == F.col("m")).select("row", "position", "number", "part")
    return found.repartitionById(parts, "part").sortWithinPartitions("position", "row.doc_id", "number").select("row.*")
