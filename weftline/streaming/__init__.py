"""Tools on streams. Those that look at one row at a time take streaming DataFrames as they are; the others must not."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.operators import MACROS, TOOLS, Context, ToolError

#: Tools whose result for a row depends on that row alone.
PER_ROW = ("select", "filter", "formula", "multi_field_formula", "find_replace", "reg_ex", "text_to_columns")


def apply(kind: str, stream: DataFrame, config: dict, ctx: Context) -> dict[str, DataFrame]:
    """A per-row tool on a stream."""
    if kind not in PER_ROW and kind != "Cleanse":
        raise ToolError(f"{kind} needs all rows or their order, which a stream does not have")
    tool = MACROS["Cleanse"] if kind == "Cleanse" else TOOLS[kind]
    return tool({"Input": stream}, config, ctx)


def windowed(stream: DataFrame, time: str, length: str, keys: list[str], aggregates: list, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates over time windows, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(*aggregates)
