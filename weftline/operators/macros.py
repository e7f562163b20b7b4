"""Standard macros: cleansing, statistics, record selection and small transforms.

A macro's configuration is a list of values by name. Names here are ours where the document has only numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.compiler import find, quoted
from weftline.operators.context import Context, ToolError, listed, numbered, running, truth, value_of
from weftline.operators.rows import Frames, only, put


def values(config: dict) -> dict[str, str]:
    """``Value`` elements by name."""
    out = {}
    for v in listed(config.get("Value")):
        if isinstance(v, dict) and v.get("name"):
            out[v["name"]] = value_of(v.get("_text", v.get("value", "")))
    return out | {k: value_of(v) for k, v in config.items() if k != "Value"}


def _fields(said: str) -> list[str]:
    """Names in a list box: ``a=True,b=False``, or separated by commas."""
    out = []
    for part in filter(None, (p.strip() for p in re.split(r"[,\n]", said or ""))):
        name, _, on = part.partition("=")
        if on.strip().lower() in ("", "true", "1"):
            out.append(name.strip().strip('"'))
    return out


def _pick(v: dict, *names: str, default: str = "") -> str:
    for n in names:
        if v.get(n) not in (None, ""):
            return v[n]
    return default


def count_records(inputs: Frames, config: dict, ctx: Context) -> Frames:
    return {"Output": only(inputs).agg(F.count(F.lit(1)).alias("Count"))}


def date_time_now(inputs: Frames, config: dict, ctx: Context) -> Frames:
    now = F.date_format(F.current_timestamp(), "EEEE, dd MMMM, yyyy")
    return {"Output": ctx.spark.range(1).select(now.alias("DateTimeNow"))}


def random_records(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """A number or a per cent share of rows, at random; with ``Deterministic`` and a seed the same rows each time."""
    df, v = only(inputs), values(config)
    seed = int(_pick(v, "Seed", default=str(ctx.options.get("seed", 7))))
    share = _pick(v, "Percent", "NPercent")
    if truth(v.get("Deterministic")):
        key = F.md5(F.concat_ws("|", *(quoted(c).cast("string") for c in df.columns), F.lit(str(seed))).cast("binary"))
    else:
        key = F.rand(seed)
    if share:
        return {"Output": df.where(F.rand(seed) < float(share) / 100) if not truth(v.get("Deterministic")) else df.where(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32 < float(share) / 100)}
    n = int(float(_pick(v, "Number", "N", "NRecords", "Numeric Up Down (1)", default="100")))
    return {"Output": df.orderBy(key).limit(n)}


def weighted_avg(inputs: Frames, config: dict, ctx: Context) -> Frames:
    df, v = only(inputs), values(config)
    value, weight = (quoted(find(df.schema, _pick(v, n, n + "Field", n.lower())).name) for n in ("Value", "Weight"))
    groups = [quoted(find(df.schema, g).name) for g in _fields(_pick(v, "GroupFields", "Groups", "GroupBy"))]
    name = _pick(v, "OutputFieldName", "Name", default="WeightedAverage")
    result = F.try_divide(F.sum(value.cast("double") * weight), F.sum(weight.cast("double"))).alias(name)
    return {"Output": df.groupBy(*groups).agg(result) if groups else df.agg(result)}


def select_records(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Ranges of row numbers: ``5``, ``-2`` (the first two), ``17-20``, ``50+``; one a line, or separated by commas."""
    df, v = only(inputs), values(config)
    n, keep = F.col("__n"), F.lit(False)
    for part in filter(None, (p.strip() for p in re.split(r"[\s,]+", _pick(v, "Ranges", "Range", "Text Box (1)")))):
        m = re.fullmatch(r"(\d*)-(\d+)|(\d+)\+|(\d+)", part)
        if not m:
            raise ToolError(f"select records: {part!r} is no range")
        if m[2]:
            keep = keep | n.between(int(m[1] or 1), int(m[2]))
        elif m[3]:
            keep = keep | (n >= int(m[3]))
        else:
            keep = keep | (n == int(m[4]))
    return {"Output": ctx.passed_on(df, numbered(df, ctx.order(df, "select records"), "__n", 1).where(keep).drop("__n"))}


def cleanse(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Nulls, white space, unwanted characters and case, in text fields; nulls also in numbers.

    Which columns hold nulls only (``drop_null_columns``) is looked up when the tool is compiled: one job, one row.
    """
    df, v = only(inputs), values(config)
    on = lambda *names, default=False: truth(_pick(v, *names, default=str(default)))
    # Numbers of the check boxes in documents.
    flags = {"drop_null_rows": "135", "drop_null_columns": "136", "null_to_blank": "84", "null_to_zero": "117", "trim": "15", "tabs": "109", "all_space": "122", "letters": "53", "digits": "58", "punctuation": "70", "case": "77"}
    default_on = ("null_to_blank", "null_to_zero", "trim")
    is_on = {k: on(k, f"Check Box ({n})", default=k in default_on) for k, n in flags.items()}
    wanted = {c.lower() for c in _fields(_pick(v, "fields", "List Box (11)"))}
    style = _pick(v, "case_style", "Drop Down (81)", default="lower").lower()
    out = df
    if is_on["drop_null_rows"]:
        some = F.lit(False)
        for c in out.columns:
            some = some | quoted(c).isNotNull()
        out = out.where(some)
    if is_on["drop_null_columns"]:
        counts = out.agg(*(F.count(quoted(c)) for c in out.columns)).first()  # one row
        out = out.select(*(quoted(c) for c, n in zip(out.columns, counts, strict=True) if n))
    columns = []
    for f in out.schema:
        c = quoted(f.name)
        if wanted and f.name.lower() not in wanted:
            columns.append(c)
            continue
        if isinstance(f.dataType, T.StringType):
            if is_on["null_to_blank"]:
                c = F.coalesce(c, F.lit(""))
            for flag, pattern, new in (("tabs", r"\s+", " "), ("all_space", r"\s+", ""), ("letters", r"\p{L}+", ""), ("digits", "[0-9０-９]+", ""), ("punctuation", r"[\p{P}\p{S}]+", "")):
                if is_on[flag]:
                    c = F.regexp_replace(c, pattern, new)
            if is_on["trim"]:
                c = F.regexp_replace(c, r"^\s+|\s+$", "")
            if is_on["case"]:
                c = {"upper": F.upper, "title": F.initcap}.get(style, F.lower)(c)
        elif isinstance(f.dataType, T.NumericType) and is_on["null_to_zero"]:
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        columns.append(c.alias(f.name))
    return {"Output": ctx.passed_on(df, out.select(*columns))}


def _pair(df: DataFrame, v: dict) -> tuple[Column, Column, list[Column]]:
    a, b = (quoted(find(df.schema, _pick(v, n, n.replace(" ", ""))).name).cast("double") for n in ("Variable 1", "Variable 2"))
    return a, b, [quoted(find(df.schema, g).name) for g in _fields(_pick(v, "Group", "GroupFields"))]


def pearson(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Correlation; null where a variable does not vary."""
    df = only(inputs)
    a, b, groups = _pair(df, values(config))
    both = df.where(a.isNotNull() & b.isNotNull())
    result = F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b)).alias("Result")
    return {"Output": both.groupBy(*groups).agg(result) if groups else both.agg(result)}


def spearman(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Correlation of ranks, tied values having their mean rank."""
    df = only(inputs)
    a, b, groups = _pair(df, values(config))
    names = [f"__g{i}" for i in range(len(groups))]
    both = df.where(a.isNotNull() & b.isNotNull()).select(*(g.alias(n) for g, n in zip(groups, names, strict=True)), a.alias("__a"), b.alias("__b"))
    # ranks of distinct values from their counts: the counts, not the rows, go through a window
    for c in ("__a", "__b"):
        counts = both.groupBy(*names, c).count()
        if names:
            counts = counts.withColumn("__after", F.sum("count").over(Window.partitionBy(*names).orderBy(F.desc(c))))
        else:
            counts = running(counts, [(c, False)], "count", "__after")
        after = F.col("__after")
        ranks = counts.select(*(F.col(n).alias(f"{n}_") for n in names), F.col(c).alias("__v"), (after - (F.col("count") - 1) / 2).alias(f"{c}_rank"))
        test = F.col(c) == F.col("__v")
        for n in names:
            test = test & F.col(n).eqNullSafe(F.col(f"{n}_"))
        both = both.join(ranks, test).drop("__v", *(f"{n}_" for n in names))
    result = F.when((F.var_pop("__a_rank") > 0) & (F.var_pop("__b_rank") > 0), F.corr("__a_rank", "__b_rank")).alias("Result")
    out = both.groupBy(*names).agg(result) if names else both.agg(result)
    labels = [g for g in _fields(_pick(values(config), "Group", "GroupFields"))]
    for n, label in zip(names, labels, strict=True):
        out = out.withColumnRenamed(n, find(df.schema, label).name)
    return {"Output": out}


def imputation(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Nulls, or a given value, become the mean, median, mode or another value of the field."""
    df, v = only(inputs), values(config)
    fields = [find(df.schema, c) for c in _fields(_pick(v, "Fields", "listbox Select Incoming Fields"))]
    method = _pick(v, "Method", default="mean").lower()
    old = _pick(v, "ReplaceValue")
    makers = {"mean": lambda c: F.avg(c), "median": lambda c: F.median(c), "mode": lambda c: F.mode(c, True)}
    if method not in makers and method not in ("value", "user"):
        raise ToolError(f"imputation: unknown method {method!r}")
    is_old = lambda c: (c == float(old)) if old else c.isNull()
    if method in makers:
        stats = df.agg(*(makers[method](F.when(~is_old(quoted(f.name)), quoted(f.name))).alias(f"__{i}") for i, f in enumerate(fields)))
        out = df.join(F.broadcast(stats))  # one row
        new = [F.col(f"__{i}") for i in range(len(fields))]
    else:
        out, new = df, [F.lit(float(_pick(v, "Value", default="0")))] * len(fields)
    indicator, separate = truth(v.get("Indicator")), truth(v.get("ImputedValue"))
    columns = [quoted(c) for c in df.columns]
    for f, value in zip(fields, new, strict=True):
        c, missing = quoted(f.name), F.coalesce(is_old(quoted(f.name)), F.lit(False))
        done = F.when(missing, value).otherwise(c)
        if separate:
            columns.append(done.alias(f"{f.name}_ImputedValue"))
        else:
            columns[df.columns.index(f.name)] = done.alias(f.name)
        if indicator:
            columns.append(missing.cast("short").alias(f"{f.name}_Indicator"))
    return {"Output": ctx.passed_on(df, out.select(*columns))}


def binning(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """``{Name}_Tile_Num``: bins of equal numbers of rows (equal values share one) or of equal width."""
    df, v = only(inputs), values(config)
    n = int(_pick(v, "NumTiles", "Bins", default="4"))
    fields = [find(df.schema, c).name for c in _fields(_pick(v, "Fields"))]
    equal_records = _pick(v, "Method", default="EqualRecords").lower().replace(" ", "") in ("equalrecords", "records")
    out = df
    for name in fields:
        c = quoted(name).cast("double")
        if equal_records:
            # from the counts of distinct values, whose window has fewer rows than the data
            counts = df.where(c.isNotNull()).groupBy(c.alias("__v")).count()
            total = F.col("__all")
            counts = running(counts, [("__v", True)], "count", "__upto").join(F.broadcast(df.agg(F.count(c).alias("__all"))))  # one row
            before = F.col("__upto") - F.col("count")
            tiles = counts.select("__v", (F.floor(before * n / total) + 1).cast("int").alias(f"{name}_Tile_Num"))
            out = out.join(tiles, c == F.col("__v"), "left").drop("__v")
        else:
            span = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
            at = F.floor(F.try_divide(n * (c - F.col("__lo")), F.col("__hi") - F.col("__lo")))
            tile = F.when(at < n, at + 1).otherwise(at).cast("int")
            out = out.join(F.broadcast(span)).withColumn(f"{name}_Tile_Num", F.when(F.col("__hi") == F.col("__lo"), F.lit(1)).otherwise(tile)).drop("__lo", "__hi")
    return {"Output": out}


def date_filter(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Days from start to end, both included; or so many periods from the start, or up to the end."""
    df, v = only(inputs), values(config)
    day = F.left(quoted(find(df.schema, _pick(v, "Field", "DateField")).name).cast("string"), F.lit(10)).try_cast("date")
    start, end = (F.lit(_pick(v, k) or None).try_cast("date") for k in ("StartDate", "EndDate"))
    n, unit = _pick(v, "Periods"), _pick(v, "PeriodType", default="days").lower().rstrip("s")
    if n:
        step = {"day": f"interval {n} days", "week": f"interval {7 * int(n)} days", "month": f"interval {n} months", "quarter": f"interval {3 * int(n)} months", "year": f"interval {n} years"}[unit]
        if _pick(v, "StartDate"):
            end = F.date_sub((start + F.expr(step)).cast("date"), 1)
        else:
            start = F.date_add((end - F.expr(step)).cast("date"), 1)
    return {"Output": ctx.passed_on(df, df.where(day.between(start, end)))}


def base64_encoder(inputs: Frames, config: dict, ctx: Context) -> Frames:
    df, v = only(inputs), values(config)
    c = quoted(find(df.schema, _pick(v, "Field", "Drop Down (1)")).name).cast("string")
    return {"Output": ctx.passed_on(df, put(df, "Base64_encoded", F.replace(F.base64(F.encode(c, "utf-8")), F.lit("\r\n"), F.lit(""))))}


def pipe_to_table(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Each row's ``out`` split at pipes, into columns 1, 2, ..., in the order of rows; other columns go.

    There are as many columns as the longest row has parts, which is looked up when the tool is compiled (one job, one
    row); a setting ``Columns`` saves that. Missing parts are null. A null ``out`` gives a row of nulls.
    """
    df, v = only(inputs), values(config)
    name = find(df.schema, _pick(v, "Field", default="out")).name
    parts = F.split(quoted(name), r"\|", -1)
    n = int(_pick(v, "Columns", default="0")) or max(1, df.agg(F.max(F.size(parts))).first()[0] or 0)
    return {"Output": ctx.passed_on(df, df.select(*(F.try_element_at(parts, F.lit(i)).alias(str(i)) for i in range(1, n + 1))))}


def stub(what: str):
    def run(inputs: Frames, config: dict, ctx: Context) -> Frames:
        if not ctx.allow_stubs:
            raise ToolError(f"{what} can't run here; set allow_stubs to pass rows on")
        ctx.warn(f"{what} is a stub: rows are passed on")
        return {"Output": only(inputs)} if inputs else {"Output": ctx.spark.range(0).select(F.lit(1).alias("_stub"))}

    return run


# File names of standard macros, without the ending.
MACROS = {
    "CountRecords": count_records, "DateTimeNow": date_time_now, "RandomRecords": random_records, "WeightedAvg": weighted_avg,
    "SelectRecords": select_records, "Cleanse": cleanse, "PearsonCorrCoeff": pearson, "SpearmanCorrCoeff": spearman,
    "Imputation": imputation, "Imputation_v2": imputation, "Imputation_v3": imputation, "MultiFieldBinning": binning,
    "MultiFieldBinning_v2": binning, "Date_Filter": date_filter, "Base64_Encoder": base64_encoder, "Pipe_to_Table": pipe_to_table,
    **{name: stub(name) for name in ("HeatMap", "PieWedgeTradeArea", "HeaderMacro", "FooterMacro", "Legend_Builder", "Legend_Splitter", "Google_Analytics", "Google_Analytics_v5", "Google_Analytics_v6")},
}
