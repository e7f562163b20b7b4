"""What the corpus operators share: word splitting, bounded batches, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made up only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The rows then no longer depend on the tasks that made them: a lost executor costs a reread, and values that
    were drawn or numbered while writing stay as they were.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _written:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``cut`` writes meanwhile, for ``drop``."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written[:] = [x for x in _written if x is not paths]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lean(run: Callable) -> Callable:
    """A batch function that hands memory back to the system when it ends: workers live on, next to the executor's heap."""

    @functools.wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return freed


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20, each: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds about ``most`` bytes; a longer text stands alone, whole.

    A run has a multiple of ``each`` rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        start, held = 0, 0
        for i, s in enumerate(size.tolist()):
            if held and held + s > most and i % each == 0:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += s
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has. A null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts), dtype=np.int64))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(row[np.asarray(full)], minlength=len(texts))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the distinct words, and those."""
    d = words.dictionary_encode()
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


#: Bits of the table by which ``marked`` tells which rows may be wanted.
WANTED = 1 << 23


def marked(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag ``name``: whether ``column`` may be in ``wanted``'s only column. It holds for all that are, and
    for some that are not, more of them as the table of fixed size fills up."""
    at = F.pmod(F.xxhash64(wanted.columns[0]), F.lit(WANTED))
    bits = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("_slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_bits"))
    own = F.pmod(F.xxhash64(column), F.lit(WANTED))
    placed = rows.withColumns({"_of": F.shiftright(own, 6), "_bit": (own % 64).cast("int")})
    near = placed.join(F.broadcast(bits), F.col("_of") == F.col("_slot"), "left")  # WANTED / 64 rows at most
    return near.select(*rows.columns, F.expr("coalesce(shiftrightunsigned(_bits, _bit) & 1L, 0L) = 1").alias(name))


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in ``wanted``'s only column: those that are, and some that are not."""
    return marked(rows, column, wanted, "_near").where("_near").drop("_near")


def dealt(place: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows) of each part that has rows. ``place``: the part of each row, below ``n``; rows keep their order."""
    order = np.argsort(place.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=n))
    for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield k, order[ends[k - 1] if k else 0 : ends[k]]


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    """All rows of a partition, by column."""
    out: dict[str, list] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            out.setdefault(name, []).extend(column.to_pylist())
    return out


def numbers(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)
