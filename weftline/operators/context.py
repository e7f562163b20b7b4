"""What tools share: the session, run parameters, warnings, and what is known about the order of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import Scope
from weftline.functions.compiler import quoted


class ToolError(ValueError):
    pass


@dataclass
class Context:
    """``rewrite(expression, schema)`` may give Spark SQL for an expression that can't be compiled.
    ``options``: null_to_false, count_all, case_sensitive, zero_based, swap_diff, first_letter_only, seed, compat_union."""

    spark: SparkSession
    variables: dict = field(default_factory=dict)
    sources: dict = field(default_factory=dict)
    allow_stubs: bool = False
    write_outputs: bool = False
    options: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    rewrite: Callable | None = None
    _orders: dict[int, tuple[DataFrame, list[tuple[str, bool]]]] = field(default_factory=dict)

    def warn(self, said: str) -> None:
        self.warnings.append(said)

    def scope(self, df: DataFrame, **more) -> Scope:
        names = ("case_sensitive", "zero_based", "swap_diff", "first_letter_only")
        return Scope(df.schema, self.variables, rewrite=self.rewrite, **{k: self.options[k] for k in names if k in self.options}, **more)

    def ordered(self, df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
        """Note that the rows of ``df`` stand in the order of ``keys`` (name, ascending)."""
        self._orders[id(df)] = (df, keys)
        return df

    def passed_on(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``new`` keeps the order of ``old`` as far as its columns are still there."""
        if id(old) in self._orders:
            keys = []
            for name, up in self._orders[id(old)][1]:
                if name not in new.columns:
                    break
                keys.append((name, up))
            if keys:
                self.ordered(new, keys)
        return new

    def order(self, df: DataFrame, tool: str) -> list[tuple[str, bool]]:
        if id(df) in self._orders:
            return self._orders[id(df)][1]
        self.warn(f"{tool}: the order of rows is unknown; all columns are used as sort keys")
        return [(f.name, True) for f in df.schema if not isinstance(f.dataType, T.MapType)]


def sorting(keys: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    return [quoted(n).asc_nulls_first() if up != reverse else quoted(n).desc_nulls_last() for n, up in keys]


def listed(x) -> list:
    """Configurations hold one item as itself, more as a list, none as null or an empty text."""
    if x is None or x == "":
        return []
    return x if isinstance(x, list) else [x]


def value_of(x, default: str = "") -> str:
    """The text of a leaf, or its ``value`` attribute, or the text beside attributes."""
    if isinstance(x, dict):
        return str(x.get("value", x.get("_text", default)))
    return default if x in (None, "") else str(x)


def truth(x, default: bool = False) -> bool:
    said = value_of(x, str(default)).strip().lower()
    return said in ("true", "1", "yes")


# Types of the document format and Spark's.
TYPES = {
    "bool": T.BooleanType(), "byte": T.ShortType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "wstring": T.StringType(), "v_string": T.StringType(),
    "v_wstring": T.StringType(), "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampNTZType(), "blob": T.BinaryType(),
}


def type_of(name: str | None, size: str | None = None) -> T.DataType | None:
    if not name:
        return None
    if name.lower() == "fixeddecimal":
        p, _, s = str(size or "19.6").partition(".")
        return T.DecimalType(min(38, int(p or 19)), int(s or 0))
    return TYPES.get(name.lower())


def cast(col: Column, kind: str, to: T.DataType | None) -> Column:
    """To the declared type; what does not fit is null."""
    if to is None:
        return col
    if isinstance(to, T.StringType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss") if kind == "ts" else col.cast("string")
    if isinstance(to, T.IntegralType) and kind == "str":
        col = col.try_cast("double")
    return col.try_cast(to)


def _ranged(df: DataFrame, keys: list[tuple[str, bool]]) -> tuple[DataFrame, list[Column]]:
    """Rows range-sorted over partitions, each with its partition's number; persisted, so that all who use them see the
    same partitions. Other columns break ties, so that only equal rows could change places if a part is computed again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = {k.lower() for k, _ in keys}
    ties = [(f.name, True) for f in df.schema if f.name.lower() not in known and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    by = sorting([*keys, *ties])
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()), by


def running(df: DataFrame, keys: list[tuple[str, bool]], amount: str, name: str) -> DataFrame:
    """A column with the sum of ``amount`` over all rows up to and with each, in the order of ``keys``.

    The window goes over the rows of one range of keys; ranges are added up by their sums, one row each.
    """
    parts, by = _ranged(df, keys)
    parts = parts.persist()
    sums = parts.groupBy(F.col("__part").alias("__p")).agg(F.sum(amount).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))  # one row for each partition
    own = F.sum(amount).over(Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("__own", own).join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.coalesce("__own", F.lit(0)) + F.col("__before")).drop("__part", "__own", "__p", "__before")


def numbered(df: DataFrame, keys: list[tuple[str, bool]], name: str, start: int = 0) -> DataFrame:
    """A column of running numbers in the order of ``keys``, without a window over all rows in one task.

    Rows are range-sorted and numbered within partitions; counts of partitions, one row each, give the offsets.
    """
    parts, _ = _ranged(df, keys)
    parts = parts.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")
    offsets = counts.select(F.col("__part").alias("__p"), "__n").select("__p", before.alias("__before"))  # one row for each partition
    out = parts.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__before") + F.col("__at") + start).drop("__part", "__at", "__p", "__before")
