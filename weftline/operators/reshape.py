"""Tools that turn columns into rows and back, make rows, and choose or name columns by what is in the data.

Tools whose columns depend on the data look at it when they are compiled: cross tab at the distinct headers, dynamic
rename at one row or at the rows with names. All else is lazy.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import compile_expression, parse
from weftline.functions.compiler import Compiler, find, kind_of, quoted
from weftline.functions.parser import walk
from weftline.operators.context import Context, ToolError, cast, listed, sorting, truth, type_of, value_of
from weftline.operators.rows import Frames, _evaluate, names_of, only

#: Columns that a cross tab may make.
MOST_HEADERS = 10_000


def _field(config: dict, key: str) -> str:
    said = config.get(key)
    return (said.get("field") or said.get("name") or value_of(said)) if isinstance(said, dict) else value_of(said)


def _chosen(config: dict, key: str) -> list[str]:
    part = config.get(key)
    fields = listed(part.get("Field") if isinstance(part, dict) else part)
    return names_of([f for f in fields if not isinstance(f, dict) or truth(f.get("selected"), True)])


def cross_tab(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """One row for each group, one column for each header value (in order; what is no letter, digit or underscore becomes
    an underscore), holding an aggregate of the data field. A null header makes the column ``Null``."""
    df = only(inputs)
    groups = [find(df.schema, g).name for g in _chosen(config, "GroupFields")]
    header, data = (find(df.schema, _field(config, k)).name for k in ("HeaderField", "DataField"))
    methods = config.get("Methods") if isinstance(config.get("Methods"), dict) else {}
    wanted = [(m.get("method") or value_of(m)) if isinstance(m, dict) else m for m in listed(methods.get("Method"))] or ["Sum"]
    between = value_of(methods.get("Separator"), ",")
    label = F.coalesce(quoted(header).cast("string"), F.lit("Null"))
    found = sorted(r[0] for r in df.select(label).distinct().limit(MOST_HEADERS + 1).collect())
    if len(found) > MOST_HEADERS:
        raise ToolError(f"cross tab: more than {MOST_HEADERS} headers")
    if all(re.fullmatch(r"-?\d{1,18}", x) for x in found):
        found.sort(key=int)
    names: dict[str, str] = {}
    for x in found:
        name = re.sub(r"\W", "_", x)
        while name.lower() in {n.lower() for n in [*names.values(), *groups]}:
            name += "_"
        names[x] = name
    order = ctx._orders.get(id(df), (None, None))[1]
    value, number = quoted(data), quoted(data).cast("double")

    def concat(on: Column) -> Column:
        text = value.cast("string")
        if not order:
            return F.array_join(F.array_sort(F.collect_list(F.when(on, text))), between)
        parts = F.sort_array(F.collect_list(F.when(on & text.isNotNull(), F.struct(*(quoted(k).alias(f"k{i}") for i, (k, _) in enumerate(order)), text.alias("x")))))
        return F.array_join(F.transform(parts, lambda p: p["x"]), between)

    makers = {
        "sum": lambda on: F.sum(F.when(on, number)), "avg": lambda on: F.avg(F.when(on, number)), "count": lambda on: F.count_if(on), "min": lambda on: F.min(F.when(on, value)),
        "max": lambda on: F.max(F.when(on, value)), "first": lambda on: F.min(F.when(on, value)), "last": lambda on: F.max(F.when(on, value)), "concat": lambda on: F.when(F.count_if(on & value.isNotNull()) > 0, concat(on)),
    }
    columns = []
    for m in wanted:
        if m.lower() not in makers:
            raise ToolError(f"cross tab: unknown method {m!r}")
        if m.lower() in ("first", "last"):
            ctx.warn(f"cross tab: {m} is taken as {'min' if m.lower() == 'first' else 'max'}")
        columns += [makers[m.lower()](label == x).alias(n if len(wanted) == 1 else f"{m}_{n}") for x, n in names.items()]
    if not columns:
        return {"Output": df.select(*map(quoted, groups)).distinct() if groups else df.select().limit(0)}
    made = df.groupBy(*map(quoted, groups)).agg(*columns) if groups else df.agg(*columns)
    return {"Output": ctx.ordered(made, [(g, True) for g in groups]) if groups else made}


def transpose(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """For each row and data field a row: the key fields, Name and Value (a number if all data fields are, else text)."""
    df = only(inputs)
    keys = [find(df.schema, k).name for k in _chosen(config, "KeyFields")]
    said = _chosen(config, "DataFields")
    told = [f.get("field") or f.get("name") for f in listed((config.get("DataFields") or {}).get("Field") if isinstance(config.get("DataFields"), dict) else None) if isinstance(f, dict)]
    data = [find(df.schema, n).name for n in said if n != "*Unknown" and n.lower() in {c.lower() for c in df.columns} and n.lower() not in {k.lower() for k in keys}]
    if "*Unknown" in said or not said:
        known = {x.lower() for x in [*told, *keys, *data] if x}
        data += [c for c in df.columns if c.lower() not in known]
    if not data:
        raise ToolError("transpose: no data fields")
    numeric = all(kind_of(find(df.schema, c).dataType) == "num" for c in data)
    value = lambda c: quoted(c).cast("double") if numeric else cast(quoted(c), kind_of(find(df.schema, c).dataType), T.StringType())
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("Name"), value(c).alias("Value")) for c in data))).alias("__cell")
    return {"Output": ctx.passed_on(df, df.select(*map(quoted, keys), rows).select(*map(quoted, keys), "__cell.Name", "__cell.Value"))}


def generate_rows(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Each row as often as a counter runs: from an initial value, while a condition holds, by a loop expression.

    Counting by a constant up or down to a bound is a sequence; other loops run row by row in Python.
    """
    df = only(inputs) if inputs else ctx.spark.range(1).select()
    update = truth(config.get("UpdateField"))
    name = value_of(config.get("UpdateField_Name")) if update else value_of(config.get("CreateField_Name"), "RowCount")
    if update:
        name = find(df.schema, name).name
    to = type_of(value_of(config.get("CreateField_Type")) or None, value_of(config.get("CreateField_Size")) or None) or (find(df.schema, name).dataType if update else T.LongType())
    bare = re.compile(rf"(?<![\[\w]){re.escape(name)}(?![\]\w])")
    init, test, loop = (value_of(config.get(f"Expression_{k}")) for k in ("Init", "Cond", "Loop"))
    test, loop = parse(bare.sub(f"[{name}]", test)), parse(bare.sub(f"[{name}]", loop))
    is_own = lambda n: n[0] == "col" and n[1].lower() == name.lower()
    mentions = lambda n: any(is_own(x) for x in walk(n))
    first = cast(*compile_expression(init, ctx.scope(df)), to)
    kept = [quoted(c) for c in df.columns if c.lower() != name.lower()]
    step = None
    if loop[0] == "bin" and loop[1] in "+-" and is_own(loop[2]) and loop[3][0] == "lit" and isinstance(loop[3][1], (int, float)):
        step = loop[3][1] if loop[1] == "+" else -loop[3][1]
    if step and isinstance(to, T.IntegralType) and float(step).is_integer() and test[0] == "bin" and is_own(test[2]) and not mentions(test[3]) and test[1] in (("<", "<=") if step > 0 else (">", ">=")):
        bound = Compiler(ctx.scope(df)).compile(test[3])[0].cast("double")
        last = (F.ceil(bound) - 1 if test[1] == "<" else F.floor(bound)) if step > 0 else (F.floor(bound) + 1 if test[1] == ">" else F.ceil(bound))
        start = first.cast("long")
        runs = start <= last if step > 0 else start >= last
        each = F.explode(F.when(runs, F.sequence(start, last, F.lit(int(step)))).otherwise(F.array().cast("array<long>")))
        rows = df.select(*kept, each.alias(name))
        return {"Output": ctx.passed_on(df, rows.select(*kept, quoted(name).cast(to).alias(name)))}
    schema = T.StructType([*(f for f in df.schema if f.name.lower() != name.lower()), T.StructField(name, to)])
    variables, wide = dict(ctx.variables), df.select(*df.columns if not update else kept, first.alias("__first"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                at = row.pop("__first")
                while at is not None and at == at and _evaluate(test, {**row, name: at}, "", None, {}, variables):
                    out.append({**row, name: at})
                    at = _evaluate(loop, {**row, name: at}, "", None, {}, variables)
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=schema.names)
                        out = []
            yield pd.DataFrame(out, columns=schema.names)

    return {"Output": ctx.passed_on(df, wide.mapInPandas(run, schema))}


# Names of types in the document format, by Spark's.
_TYPE_NAMES = {"boolean": "Bool", "byte": "Byte", "tinyint": "Byte", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float", "double": "Double", "date": "Date", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "binary": "Blob"}


def field_info(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """A row for each column: Name, Type, Size, Scale, Source, Description."""
    rows = []
    for f in only(inputs).schema:
        kind = f.dataType
        if isinstance(kind, T.DecimalType):
            rows.append((f.name, "FixedDecimal", kind.precision, kind.scale, "", ""))
        else:
            size = {"Bool": 1, "Byte": 1, "Int16": 2, "Int32": 4, "Int64": 8, "Float": 4, "Double": 8, "Date": 10, "DateTime": 19}.get(_TYPE_NAMES.get(kind.simpleString(), ""))
            rows.append((f.name, _TYPE_NAMES.get(kind.simpleString(), "V_WString"), size, None, "", ""))
    return {"Output": ctx.spark.createDataFrame(rows, "Name string, Type string, Size int, Scale int, Source string, Description string")}


def dynamic_select(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """The columns of the given types, or those for which a formula over [Name], [Type], [Size] ... holds."""
    df = only(inputs)
    info = field_info(inputs, {}, ctx)["Output"]
    if value_of(config.get("Mode"), "Formula").lower() == "formula":
        test = compile_expression(value_of(config.get("Expression")), ctx.scope(info))[0]
        wanted = {r.Name for r in info.where(test).collect()}  # a row for each column
    else:
        types = {t.lower() for t in re.split(r"[,\s]+", value_of(config.get("FieldTypes"))) if t}
        wanted = {r.Name for r in info.collect() if r.Type.lower() in types}
    return {"Output": ctx.passed_on(df, df.select(*(quoted(c) for c in df.columns if c in wanted)))}


def _renamed(df: DataFrame, names: dict[str, str], ctx: Context) -> DataFrame:
    used: set[str] = set()
    columns = []
    for c in df.columns:
        name = names.get(c, c) or c
        while name.lower() in used:
            name += "2"
        used.add(name.lower())
        columns.append(quoted(c).alias(name))
    out = df.select(*columns)
    if id(df) in ctx._orders:
        ctx.ordered(out, [(out.columns[df.columns.index(k)], up) for k, up in ctx._orders[id(df)][1] if k in df.columns])
    return out


def dynamic_rename(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """New names from the first row (which goes), a formula over the old name, a prefix or suffix to add or remove, or
    from the right input: rows with old and new names, or its column names."""
    left = inputs.get("Input", inputs.get("Left")) if len(inputs) > 1 and ("Input" in inputs or "Left" in inputs) else only(inputs)
    right = next((f for f in inputs.values() if f is not left), None)
    mode = value_of(config.get("RenameMode"), "Formula").lower()
    said = _chosen(config, "Fields")
    known = {c.lower(): c for c in left.columns}
    fields = [known[n.lower()] for n in said if n.lower() in known]
    if "*Unknown" in said or not said:
        fields += [c for c in left.columns if c.lower() not in {n.lower() for n in said}]
    affix = config.get("AddPrefixSuffix") if isinstance(config.get("AddPrefixSuffix"), dict) else config
    text = value_of(affix.get("Text") or affix.get("Value") or affix.get("Prefix") or affix.get("Suffix"))
    at_end = value_of(affix.get("Type"), "Suffix" if affix.get("Suffix") else "Prefix").lower() == "suffix"
    if mode == "firstrow":
        keys = ctx.order(left, "dynamic rename")
        row = left.orderBy(*sorting(keys)).first()
        if row is None:
            return {"Output": left}
        same = F.lit(True)
        for c in left.columns:
            same = same & quoted(c).eqNullSafe(F.lit(row[c]))
        names = {c: str(row[c]) for c in fields if row[c] not in (None, "")}
        equal = left.where(same).count() - 1
        rest = left.where(~same)
        if equal:  # rows like the first stay, but for one
            rest = rest.unionAll(left.where(same).limit(equal))
            rest = rest.orderBy(*sorting(keys))
        return {"Output": _renamed(ctx.ordered(rest, keys), names, ctx)}
    if mode == "formula":
        expression = value_of(config.get("Expression"))
        one = ctx.spark.range(1).select(*(F.lit(c).alias(f"c{k}") for k, c in enumerate(fields)))
        found = one.select(*(compile_expression(expression, ctx.scope(one, current=(c, f"c{k}")))[0].cast("string").alias(f"n{k}") for k, c in enumerate(fields))).first()
        return {"Output": _renamed(left, dict(zip(fields, found, strict=True)), ctx)}
    if mode in ("add", "addprefixsuffix"):
        return {"Output": _renamed(left, {c: c + text if at_end else text + c for c in fields}, ctx)}
    if mode in ("remove", "removeprefixsuffix"):
        return {"Output": _renamed(left, {c: (c.removesuffix(text) if at_end else c.removeprefix(text)) for c in fields}, ctx)}
    if right is None:
        raise ToolError("dynamic rename: the right input is missing")
    if mode == "rightinputrows":
        told = config.get("NamesFromRows") if isinstance(config.get("NamesFromRows"), dict) else {}
        new = find(right.schema, value_of(told.get("NewName")) or _field(told, "NewNameField") or right.columns[-1]).name
        old = value_of(told.get("OldName")) or _field(told, "OldNameField")
        rows = right.select(*([quoted(find(right.schema, old).name)] if old else []), quoted(new)).limit(MOST_HEADERS).collect()
        pairs = {str(r[0]).lower(): r[1] for r in rows} if old else {c.lower(): r[0] for c, r in zip(fields, rows, strict=False)}
        return {"Output": _renamed(left, {c: str(pairs[c.lower()]) for c in fields if pairs.get(c.lower())}, ctx)}
    if mode in ("rightinputmetadata", "rightinput"):
        return {"Output": _renamed(left, dict(zip(fields, right.columns, strict=False)), ctx)}
    raise ToolError(f"dynamic rename: unknown mode {mode!r}")
