"""Tools on rows and columns: projection, predicates, joins, sets, aggregates and sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import compile_expression, parse
from weftline.functions.compiler import Compiler, find, kind_of, quoted
from weftline.functions.parser import ExpressionError, walk
from weftline.operators.context import Context, ToolError, cast, listed, numbered, sorting, truth, type_of, value_of

Frames = dict[str, DataFrame]


def only(inputs: Frames) -> DataFrame:
    if not inputs:
        raise ToolError("the tool has no input")
    return next(iter(inputs.values()))


def names_of(fields) -> list[str]:
    return [f if isinstance(f, str) else f.get("field") or f.get("name") or value_of(f) for f in listed(fields)]


def _select_list(df: DataFrame, fields: list[dict], ctx: Context, tool: str) -> list[Column]:
    known = {f.name.lower(): f for f in df.schema}
    told = {(f.get("field") or f.get("name") or "").lower(): f for f in fields}
    rest_wanted = not fields or truth(told.get("*unknown", {}).get("selected"), "*unknown" in told)
    out: list[Column] = []
    used: set[str] = set()

    def add(f: T.StructField, spec: dict) -> None:
        name = spec.get("rename") or f.name
        if name.lower() in used:
            ctx.warn(f"{tool}: a second column [{name}] is left out")
            return
        used.add(name.lower())
        col = cast(quoted(f.name), kind_of(f.dataType), type_of(spec.get("type"), spec.get("size"))) if spec.get("type") else quoted(f.name)
        out.append(col.alias(name))

    for spec in fields:
        name = (spec.get("field") or spec.get("name") or "").lower()
        if name == "*unknown":
            if rest_wanted:
                for f in df.schema:
                    if f.name.lower() not in told and f.name.lower() not in used:
                        add(f, {})
        elif truth(spec.get("selected"), True):
            if name in known:
                add(known[name], spec)
            else:
                ctx.warn(f"{tool}: no column [{spec.get('field') or spec.get('name')}]")
    return out


def select(inputs: Frames, config: dict, ctx: Context) -> Frames:
    df = only(inputs)
    fields = listed((config.get("SelectFields") or {}).get("SelectField"))
    columns = _select_list(df, fields, ctx, "select")
    if not columns:
        if fields:
            ctx.warn("select: no column is left; all are passed on")
        return {"Output": df}
    return {"Output": ctx.passed_on(df, df.select(*columns))}


# Operators of simple filters that are comparisons, and their symbols.
_COMPARE = {"=": "=", "==": "=", "equals": "=", "!=": "!=", "<>": "!=", "notequals": "!=", "<": "<", "lessthan": "<", ">": ">", "greaterthan": ">", "<=": "<=", "lessthanorequal": "<=", ">=": ">=", "greaterthanorequal": ">="}


def simple_condition(df: DataFrame, simple: dict, ctx: Context) -> Column:
    f = find(df.schema, value_of(simple.get("Field")))
    op = value_of(simple.get("Operator"), "=").lower()
    operands = simple.get("Operands") if isinstance(simple.get("Operands"), dict) else {}
    compiler = Compiler(ctx.scope(df))
    left = (quoted(f.name), kind_of(f.dataType))

    def literal(key: str) -> tuple[Column, str]:
        said = value_of(operands.get(key, simple.get(key)))
        return (F.lit(float(said)), "num") if re.fullmatch(r"[+-]?\d+(\.\d+)?", said) and left[1] != "str" else (F.lit(said), "str")

    if op in ("isnull", "isnotnull"):
        return left[0].isNull() if op == "isnull" else left[0].isNotNull()
    if op in ("isempty", "isnotempty"):
        empty = left[0].isNull() | F.coalesce(left[0].cast("string") == "", F.lit(False))
        return empty if op == "isempty" else ~empty
    if op == "between":
        low, high = (compiler.comparable(left, literal(k)) for k in ("StartDate", "EndDate"))
        return (low[0] >= low[1]) & (high[0] <= high[1])
    if op in ("contains", "doesnotcontain", "startswith", "endswith"):
        x, y = left[0].cast("string"), F.lit(value_of(operands.get("Operand", simple.get("Operand"))))
        if not ctx.options.get("case_sensitive", True):
            x, y = F.lower(x), F.lower(y)
        found = {"startswith": x.startswith, "endswith": x.endswith}.get(op, x.contains)(y)
        return ~found if op == "doesnotcontain" else found
    if op not in _COMPARE:
        raise ToolError(f"filter: unknown operator {op!r}")
    a, b = compiler.comparable(left, literal("Operand"))
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[_COMPARE[op]]


def filter_rows(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Anchors True and False. A null condition is in neither, unless option ``null_to_false`` is set."""
    df = only(inputs)
    if value_of(config.get("Mode"), "Custom").lower() == "simple":
        test = simple_condition(df, config.get("Simple") or config, ctx)
    else:
        expression = value_of(config.get("Expression"))
        if not expression:
            raise ToolError("filter: no expression")
        try:
            test = Compiler(ctx.scope(df)).compile(("un", "NOT", ("un", "NOT", parse(expression))))[0]
        except ExpressionError:
            test = compile_expression(expression, ctx.scope(df))[0]
    against = ~F.coalesce(test, F.lit(False)) if ctx.options.get("null_to_false") else ~test
    return {a: ctx.passed_on(df, df.filter(c)) for a, c in (("True", test), ("False", against))}


def put(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Overwrite the column of that name, in any case, where it stands, or append one."""
    for c in df.columns:
        if c.lower() == name.lower():
            return df.select(*(col.alias(c) if x == c else quoted(x) for x in df.columns))
    return df.select("*", col.alias(name))


def formula(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Fields in turn; each sees those before it."""
    df = first = only(inputs)
    for spec in listed((config.get("FormulaFields") or {}).get("FormulaField")):
        col, kind = compile_expression(spec["expression"], ctx.scope(df))
        to = type_of(spec.get("type"), spec.get("size"))
        df = put(df, spec["field"], cast(col, kind, to) if to is not None else col)
    return {"Output": ctx.passed_on(first, df)}


def multi_field_formula(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """One expression over many fields: [_CurrentField_] is the field, [_CurrentFieldName_] its name."""
    df = first = only(inputs)
    wanted = [n.lower() for n in names_of((config.get("Fields") or {}).get("Field") if isinstance(config.get("Fields"), dict) else config.get("Fields"))]
    every = "*unknown" in wanted
    prefix, suffix = value_of(config.get("NewFieldAddOn")), value_of(config.get("NewFieldAddOnPos"), "Prefix")
    copies = truth(config.get("CopyOutput"))
    to = type_of(value_of((config.get("OutputFieldType") or {}).get("type")) if isinstance(config.get("OutputFieldType"), dict) else None)
    expression = value_of(config.get("Expression"))
    for f in first.schema:
        if not every and f.name.lower() not in wanted:
            continue
        col, kind = compile_expression(expression, ctx.scope(first, current=(f.name, f.name)))
        if to is not None:
            col = cast(col, kind, to)
        name = (prefix + f.name if suffix.lower() == "prefix" else f.name + prefix) if copies else f.name
        df = put(df, name, col)
    return {"Output": ctx.passed_on(first, df)}


def multi_row_formula(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """A field from other rows of the group, [Row-1:x] and so on.

    An expression that refers to its own result is recursive. Two forms are running sums: ``[Row-1:x] + f`` and
    ``IIF(same as before, [Row-1:x], [Row-1:x] + f)``. Other recursive forms go row by row, group by group, in Python.
    """
    df = only(inputs)
    name = value_of(config.get("UpdateField_Name")) if truth(config.get("UpdateField")) else value_of(config.get("CreateField_Name"))
    to = type_of(value_of(config.get("CreateField_Type")) or None, value_of(config.get("CreateField_Size")) or None)
    others = value_of(config.get("OtherRows"), "Null").lower()
    groups = names_of((config.get("GroupByFields") or {}).get("Field") if isinstance(config.get("GroupByFields"), dict) else None)
    tree = parse(value_of(config.get("Expression")))
    keys = ctx.order(df, "multi-row formula")
    if not groups:
        return {"Output": ctx.passed_on(df, _in_runs(df, name, tree, keys, to, others, truth(config.get("UpdateField")), ctx))}
    window = Window.partitionBy(*map(quoted, groups)).orderBy(*sorting(keys))
    existing = {c.lower() for c in df.columns}
    own = [n for n in walk(tree) if n[0] == "row" and n[2].lower() == name.lower()]
    if own and (not truth(config.get("UpdateField")) or any(n[1] < 0 for n in own)):
        return {"Output": ctx.passed_on(df, _recursive(df, name, tree, groups, keys, window, to, others, ctx))}

    def other(offset: int, column: str) -> Column:
        kind = kind_of(find(df.schema, column).dataType)
        shift = F.lag if offset < 0 else F.lead
        value = shift(quoted(column), abs(offset)).over(window)
        if others == "empty":
            empty = {"num": F.lit(0), "str": F.lit("")}.get(kind)
            return value if empty is None else F.when(_beyond(offset, window), empty).otherwise(value)
        if others == "closest":
            edge = Window.partitionBy(*map(quoted, groups)).orderBy(*sorting(keys)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.when(_beyond(offset, window), (F.first if offset < 0 else F.last)(quoted(column)).over(edge)).otherwise(value)
        return value

    col, kind = Compiler(ctx.scope(df, row=other)).compile(tree)
    out = put(df, name, cast(col, kind, to) if to is not None and name.lower() not in existing else col)
    return {"Output": ctx.passed_on(df, out)}


#: Rows of a run of rows that stands for a group where there are no groups.
RUN = 1 << 16


def _in_runs(df: DataFrame, name: str, tree, keys, to, others: str, update: bool, ctx: Context) -> DataFrame:
    """A multi-row formula over all rows: rows are numbered and windows go over runs of RUN rows.

    Each run has copies of the rows around it that the formula reaches. Running sums add up the sums of the runs
    before. Other recursive forms have to go through all rows in turn, in one task.
    """
    reach = max([abs(n[1]) for n in walk(tree) if n[0] == "row"], default=1)
    refers = [n for n in walk(tree) if n[0] == "row" and n[2].lower() == name.lower()]
    recursive = bool(refers) and (not update or any(n[1] < 0 for n in refers))
    added = _added(tree, name) if recursive else None
    if recursive and added is None:
        ctx.warn("multi-row formula: without groups, a recursion that is no running sum goes through all rows in one task")
        return _recursive(df, name, tree, [], keys, Window.partitionBy().orderBy(*sorting(keys)), to, others, ctx)
    at, width = F.col("__i"), F.lit(max(RUN, reach))
    run = lambda i: F.floor(i / width).cast("long")
    rows = numbered(df, keys, "__i")
    rows = rows.withColumn("__run", F.explode(F.sequence(run(F.greatest(at - reach, F.lit(0))), run(at + reach))))
    window = Window.partitionBy("__run").orderBy("__i")
    existing = {c.lower() for c in df.columns}

    def other(offset: int, column: str) -> Column:
        kind = kind_of(find(df.schema, column).dataType)
        value = (F.lag if offset < 0 else F.lead)(quoted(column), abs(offset)).over(window)
        if others == "empty":
            empty = {"num": F.lit(0), "str": F.lit("")}.get(kind)
            return value if empty is None else F.when(_beyond(offset, window), empty).otherwise(value)
        if others == "closest":
            edge = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.when(_beyond(offset, window), (F.first if offset < 0 else F.last)(quoted(column)).over(edge)).otherwise(value)
        return value

    col, kind = Compiler(ctx.scope(df, row=other)).compile(added if recursive else tree)
    new = F.coalesce(col.cast("double"), F.lit(0.0)) if recursive else cast(col, kind, to) if to is not None and name.lower() not in existing else col
    rows = rows.withColumn("__new", new).where(F.col("__run") == run(at))
    if recursive:
        sums = rows.groupBy(F.col("__run").alias("__r")).agg(F.sum("__new").alias("__n"))
        before = F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sums.select("__r", F.coalesce(before, F.lit(0.0)).alias("__before"))  # a row for each RUN rows
        rows = rows.join(offsets, F.col("__run") == F.col("__r"))
        total = F.sum("__new").over(Window.partitionBy("__run").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
        rows = rows.withColumn("__new", total.try_cast(to) if to is not None else total)
    kept = put(rows.select(*map(quoted, df.columns), "__new"), name, F.col("__new"))
    return kept.drop("__new")


def _beyond(offset: int, window) -> Column:
    return (F.lag if offset < 0 else F.lead)(F.lit(True), abs(offset)).over(window).isNull()


def _added(tree, name: str):
    """The tree of what a recursive formula adds to the row before, or None if that is not all it does."""
    is_before = lambda n: n[0] == "row" and n[1] == -1 and n[2].lower() == name.lower()
    mentions = lambda n: any(x[0] == "row" and x[2].lower() == name.lower() for x in walk(n))

    def step(node):
        if is_before(node):
            return ("lit", 0)
        if node[0] == "bin" and node[1] in "+-" and is_before(node[2]) and not mentions(node[3]):
            return node[3] if node[1] == "+" else ("un", "-", node[3])
        if node[0] == "bin" and node[1] == "+" and is_before(node[3]) and not mentions(node[2]):
            return node[2]
        if node[0] == "call" and node[1] == "IIF" and not mentions(node[2][0]):
            parts = [step(x) for x in node[2][1:]]
            return None if None in parts else ("call", "IIF", [node[2][0], *parts])
        if node[0] == "if" and not any(mentions(c) for c, _ in node[1]):
            parts, last = [(c, step(v)) for c, v in node[1]], step(node[2])
            return None if last is None or any(v is None for _, v in parts) else ("if", parts, last)
        return None

    return step(tree)


def _recursive(df: DataFrame, name: str, tree, groups: list[str], keys, window, to, others: str, ctx: Context) -> DataFrame:
    so_far = Window.partitionBy(*map(quoted, groups)).orderBy(*sorting(keys)).rowsBetween(Window.unboundedPreceding, 0)

    def lagged(offset: int, column: str) -> Column:
        return (F.lag if offset < 0 else F.lead)(quoted(column), abs(offset)).over(window)

    added = _added(tree, name)
    if added is not None:
        col, _ = Compiler(ctx.scope(df, row=lagged)).compile(added)
        marked = df.withColumn("__step", F.coalesce(col.cast("double"), F.lit(0.0)))
        total = F.sum("__step").over(so_far)
        out = put(marked, name, total.try_cast(to) if to is not None else total).drop("__step")
        return out
    # row by row: the values of the other columns that the expression names come along as columns
    flat, used = {}, []

    def stand_in(offset: int, column: str) -> Column:
        key = f"__r{len(used)}"
        used.append(lagged(offset, column).alias(key))
        flat[(offset, column.lower())] = key
        return F.lit(None)

    refs = {(n[1], n[2]) for n in walk(tree) if n[0] == "row" and n[2].lower() != name.lower()}
    for offset, column in sorted(refs):
        stand_in(offset, find(df.schema, column).name)
    wide = df.select("*", *used)
    target = to or T.DoubleType()
    schema = T.StructType([*(f for f in wide.schema if f.name.lower() != name.lower()), T.StructField(name, target)])
    variables = dict(ctx.variables)

    def run(pdf):
        pdf = pdf.sort_values([k for k, _ in keys], ascending=[u for _, u in keys], kind="stable", na_position="first")
        last, out = 0 if others == "empty" else None, []
        for row in pdf.to_dict("records"):
            last = _evaluate(tree, row, name, last, flat, variables)
            out.append(last)
        return pdf.drop(columns=[c for c in pdf.columns if c.lower() == name.lower()]).assign(**{name: out})[schema.names]

    grouped = wide.groupBy(*map(quoted, groups)) if groups else wide.groupBy()
    out = grouped.applyInPandas(run, schema)
    return out.drop(*flat.values())


def _evaluate(node, row: dict, name: str, last, flat: dict, variables: dict):
    """An expression on one row, for recursive formulas: arithmetic, comparisons, logic, IF, IIF, MIN, MAX, ABS."""
    ev = lambda n: _evaluate(n, row, name, last, flat, variables)
    kind = node[0]
    if kind == "lit":
        return node[1]
    if kind == "col":
        value = next(v for k, v in row.items() if k.lower() == node[1].lower())
        return None if value != value else value
    if kind == "var":
        return variables.get(node[1])
    if kind == "row":
        if node[2].lower() == name.lower():
            if node[1] != -1:
                raise ToolError("recursion reaches back one row only")
            return last
        value = row[flat[(node[1], node[2].lower())]]
        return None if value != value else value
    if kind == "un":
        x = ev(node[2])
        return None if x is None else (not x if node[1] == "NOT" else -x if node[1] == "-" else x)
    if kind == "bin":
        a, b = ev(node[2]), ev(node[3])
        if node[1] == "AND":
            return bool(a) and bool(b)
        if node[1] == "OR":
            return bool(a) or bool(b)
        if a is None or b is None:
            return None
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if b else None, "%": lambda: a % b if b else None, "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[node[1]]()
    if kind == "if":
        for c, v in node[1]:
            if ev(c):
                return ev(v)
        return ev(node[2])
    if kind == "call":
        args = node[2]
        if node[1] == "IIF":
            return ev(args[1]) if ev(args[0]) else ev(args[2])
        if node[1] == "ISNULL":
            return ev(args[0]) is None
        values = [ev(a) for a in args]
        simple = {"MIN": min, "MAX": max, "ABS": abs}
        if node[1] in simple and None not in values:
            return simple[node[1]](*values) if len(values) > 1 else (abs(values[0]) if node[1] == "ABS" else values[0])
    raise ToolError(f"a recursive multi-row formula can't hold {node[1]}")


def _sides(inputs: Frames, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    if left in inputs and right in inputs:
        return inputs[left], inputs[right]
    if len(inputs) < 2:
        raise ToolError("the tool needs two inputs")
    a, b = list(inputs.values())[:2]
    return a, b


def _prefixed(left: DataFrame, right: DataFrame, prefix: str) -> list[tuple[str, str]]:
    """Columns of the right side with the names they get."""
    taken, out = {c.lower() for c in left.columns}, []
    for c in right.columns:
        name = c
        while name.lower() in taken:
            name = prefix + name
        taken.add(name.lower())
        out.append((c, name))
    return out


def join(inputs: Frames, config: dict, ctx: Context, how: str = "inner") -> Frames:
    """Anchors Join, Left and Right (unmatched rows). ``how`` is set by the planner where outputs meet in one union."""
    left, right = _sides(inputs, "Left", "Right")
    keys: dict[str, list[str]] = {}
    for info in listed(config.get("JoinInfo")):
        side = info.get("connection") or info.get("side") or info.get("Side")
        keys[side] = names_of(info.get("Field"))
    if truth(config.get("joinByRecordPos")):
        left = numbered(left, ctx.order(left, "join"), "__pos")
        right = numbered(right, ctx.order(right, "join"), "__pos")
        pairs = [("__pos", "__pos")]
    else:
        pairs = list(zip(keys.get("Left", []), keys.get("Right", []), strict=False))
        if not pairs:
            raise ToolError("join: no keys")
    pairs = [(find(left.schema, a).name, find(right.schema, b).name) for a, b in pairs]
    l, r = left.alias("l"), right.alias("r")
    col = lambda side, name: F.col(f"{side}.`{name.replace('`', '``')}`")
    test = None
    for a, b in pairs:
        one = col("l", a) == col("r", b)
        test = one if test is None else test & one
    prefix = value_of(config.get("RenameRightInput"), "Right_")
    columns = [col("l", c).alias(c) for c in left.columns if c != "__pos"]
    columns += [col("r", c).alias(n) for c, n in _prefixed(left, right, prefix) if c != "__pos"]
    joined = l.join(r, test, how).select(*columns)
    for part in listed((config.get("SelectConfiguration") or {}).get("Configuration")):
        if part.get("outputConnection") == "Join":
            fields = listed((part.get("SelectFields") or {}).get("SelectField"))
            chosen = _select_list(joined, fields, ctx, "join") if fields else []
            joined = joined.select(*chosen) if chosen else joined
    return {"Join": joined, "Left": l.join(r, test, "left_anti").drop("__pos"), "Right": r.join(l, test, "left_anti").drop("__pos")}


def join_multiple(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Two or more inputs on one list of keys (the same names in all): full outer, or inner with JoinType Inner."""
    keys = names_of((config.get("JoinInfo") or {}).get("Field"))
    how = "inner" if value_of(config.get("JoinType"), "Outer").lower() == "inner" else "full"
    frames = [df for _, df in sorted(inputs.items())]
    out = frames[0]
    for k, df in enumerate(frames[1:], 2):
        l, r = out.alias("l"), df.alias("r")
        test = None
        for key in keys:
            one = F.col(f"l.`{key}`") == F.col(f"r.`{key}`")
            test = one if test is None else test & one
        columns = [(F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")) if c in keys else F.col(f"l.`{c}`")).alias(c) for c in out.columns]
        columns += [F.col(f"r.`{c}`").alias(n) for c, n in _prefixed(out, df, f"Input_#{k}_") if c not in keys]
        out = l.join(r, test, how).select(*columns)
    return {"Output": out, "Join": out}


def append_fields(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Every target row with every source row. A product is what the tool is for; a small source is broadcast by Spark itself."""
    targets, source = _sides(inputs, "Targets", "Source")
    ctx.warn("append fields: the result has targets x source rows")
    l, r = targets.alias("l"), source.alias("r")
    columns = [F.col(f"l.`{c}`").alias(c) for c in targets.columns]
    columns += [F.col(f"r.`{c}`").alias(n) for c, n in _prefixed(targets, source, value_of(config.get("RenameSource"), "Source_"))]
    return {"Output": l.crossJoin(r).select(*columns)}


def union(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """By name or by position as configured; by default by name if the numbers of columns differ, else by position."""
    frames = list(inputs.values())
    if not frames:
        raise ToolError("the tool has no input")
    mode = value_of(config.get("Mode")).lower()
    by_name = mode in ("byname", "name") or (mode not in ("bypos", "position", "manual") and len({len(f.columns) for f in frames}) > 1)
    common = value_of(config.get("ByName_OutputMode"), "All").lower() == "common"
    if by_name and common:
        shared = [c for c in frames[0].columns if all(c.lower() in {x.lower() for x in f.columns} for f in frames)]
        frames = [f.select(*(quoted(find(f.schema, c).name).alias(c) for c in shared)) for f in frames]
    elif by_name:  # names that differ in case only are one column
        first: dict[str, str] = {}
        for f in frames:
            for c in f.columns:
                first.setdefault(c.lower(), c)
        frames = [f.select(*(quoted(c).alias(first[c.lower()]) for c in f.columns)) for f in frames]
    else:  # the further columns of longer inputs stay, null for the others
        longest = max(frames, key=lambda f: len(f.columns))
        if any(len(f.columns) < len(longest.columns) for f in frames):
            ctx.warn("union: inputs differ in their number of columns; missing ones are null")
        names = [c for c in frames[0].columns]
        for f in longest.schema[len(names) :]:
            names.append(f.name if f.name.lower() not in {n.lower() for n in names} else f"{f.name}_{len(names) + 1}")
        kinds = [f.dataType for f in longest.schema]
        frames = [f.select(*(quoted(c).alias(n) for c, n in zip(f.columns, names, strict=False)), *(F.lit(None).cast(k).alias(n) for k, n in list(zip(kinds, names, strict=True))[len(f.columns) :])) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True) if by_name else out.union(f)
    return {"Output": out}


def summarize(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Columns in the order of the configuration, groups and aggregates mixed."""
    df = only(inputs)
    order, mixed = None, False
    keys, aggregates, columns = [], [], []
    for spec in listed((config.get("SummarizeFields") or {}).get("SummarizeField")):
        action = (spec.get("action") or "GroupBy").lower()
        f = find(df.schema, spec["field"])
        c, name = quoted(f.name), spec.get("rename") or (f.name if action == "groupby" else f"{spec.get('action')}_{f.name}")
        between = value_of(spec.get("Separator") or spec.get("separator"), ", " if action.startswith("concat") else "")
        text = F.coalesce(c.cast("string"), F.lit(""))
        if action == "groupby":
            keys.append(c.alias(name))
            columns.append(quoted(name))
            continue
        if action in ("first", "last"):
            if order is None:
                order = ctx._orders.get(id(df), (None, None))[1] or []
            if order:
                by = F.struct(*(quoted(k) for k, _ in order))
                ups = {up for _, up in order}
                if len(ups) > 1:  # some keys ascending, some descending: by running numbers
                    by, ups, mixed = F.col("__i"), {True}, True
                pick = F.min_by if (action == "first") == ups.copy().pop() else F.max_by
                aggregates.append(pick(c, by).alias(name))
                columns.append(quoted(name))
                continue
            ctx.warn(f"summarize: the order of rows is unknown; {action} is taken as {'min' if action == 'first' else 'max'}")
        made = {
            "sum": lambda: F.sum(c),
            "count": lambda: F.count(F.lit(1)) if ctx.options.get("count_all") else F.count(c),
            "countnonnull": lambda: F.count(c),
            "countdistinct": lambda: F.count_distinct(c),
            "countnull": lambda: F.count_if(c.isNull()),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
            "avg": lambda: F.avg(c.cast("double")),
            "first": lambda: F.min(c),
            "last": lambda: F.max(c),
            "median": lambda: F.median(c),
            "mode": lambda: F.mode(c, True),
            "stddev": lambda: F.stddev_samp(c),
            "variance": lambda: F.var_samp(c),
            "concat": lambda: F.array_join(F.array_sort(F.collect_list(text)), between),
            "concatdistinct": lambda: F.array_join(F.array_sort(F.collect_set(text)), between),
        }.get(action)
        if made is None:
            ctx.warn(f"summarize: action {spec.get('action')} is not supported and left out")
            continue
        aggregates.append(made().alias(name))
        columns.append(quoted(name))
    if not columns:
        ctx.warn("summarize: nothing to do; rows are passed on")
        return {"Output": df}
    if mixed:
        df = numbered(df, order, "__i")
    if not aggregates:
        return {"Output": df.select(*keys).distinct().select(*columns)}
    return {"Output": (df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)).select(*columns)}


def unique(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """The first row of each key in stream order, and the others. Without keys: distinct rows."""
    df = only(inputs)
    fields = config.get("UniqueFields")
    keys = names_of(fields.get("Field") if isinstance(fields, dict) else fields)
    if not keys:  # all rows but one of each
        again = F.explode(F.sequence(F.lit(2), F.col("__n").cast("int")))
        return {"Unique": df.distinct(), "Duplicates": df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("__n", again).drop("__n")}
    by = [quoted(find(df.schema, k).name) for k in keys]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*sorting(ctx.order(df, "unique"))))
    marked = df.withColumn("__n", n)
    return {"Unique": ctx.passed_on(df, marked.where("__n = 1").drop("__n")), "Duplicates": ctx.passed_on(df, marked.where("__n > 1").drop("__n"))}


def sort(inputs: Frames, config: dict, ctx: Context) -> Frames:
    df = only(inputs)
    info = config.get("SortInfo")
    keys = []
    for f in listed(info.get("Field") if isinstance(info, dict) else None):
        keys.append((find(df.schema, f["field"]).name, not f.get("order", "Ascending").lower().startswith("desc")))
    if not keys:
        ctx.warn("sort: no fields; rows are passed on")
        return {"Output": df}
    return {"Output": ctx.ordered(df.orderBy(*sorting(keys)), keys)}


def sample(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """First, Last, Random (seeded), Skip and every-Nth rows, over all rows or in groups."""
    df = only(inputs)
    mode = value_of(config.get("Mode"), "First").lower()
    said = value_of(config.get("SampleSize")) or value_of(config.get("N"), "")
    try:
        n = int(float(said))
    except ValueError:
        ctx.warn(f"sample: size {said!r} is no number; 100 is taken")
        n = 100
    fields = config.get("GroupFields")
    groups = [quoted(find(df.schema, g).name) for g in names_of(fields.get("Field") if isinstance(fields, dict) else fields) if g]
    if mode == "random":
        seed = ctx.options.get("seed", 7)
        if not groups:
            return {"Output": df.orderBy(F.rand(seed)).limit(n)}
        at = F.row_number().over(Window.partitionBy(*groups).orderBy(F.rand(seed)))
        return {"Output": df.withColumn("__at", at).where(F.col("__at") <= n).drop("__at")}
    keys = ctx.order(df, "sample")
    if not groups and mode not in ("skip", "sample"):
        last = mode == "last"
        out = df.orderBy(*sorting(keys, reverse=last)).limit(n)
        return {"Output": ctx.ordered(out.orderBy(*sorting(keys)) if last else out, keys)}
    if groups:
        at = F.row_number().over(Window.partitionBy(*groups).orderBy(*sorting(keys, reverse=mode == "last")))
        marked = df.withColumn("__at", at)
    else:
        marked = numbered(df, keys, "__at", 1)
    keep = {"skip": F.col("__at") > n, "sample": F.col("__at") % n == 0}.get(mode, F.col("__at") <= n)
    return {"Output": ctx.passed_on(df, marked.where(keep).drop("__at"))}


def record_id(inputs: Frames, config: dict, ctx: Context) -> Frames:
    df = only(inputs)
    name = value_of(config.get("FieldName"), "RecordID")
    start = int(value_of(config.get("StartValue"), "1"))
    to = type_of(value_of(config.get("FieldType")) or None) or T.LongType()
    keys = ctx.order(df, "record id")
    out = numbered(df, keys, "__id", start)
    col = F.lpad(F.col("__id").cast("string"), int(value_of(config.get("FieldSize"), "6")), "0") if isinstance(to, T.StringType) else F.col("__id").cast(to)
    columns = [quoted(c) for c in df.columns]
    columns = [col.alias(name), *columns] if value_of(config.get("Position")) == "0" else [*columns, col.alias(name)]
    out = out.select(*columns)
    return {"Output": ctx.ordered(out, [(name, True)])}


def tile(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Tile_Num and Tile_SequenceNum: EqualRecords cuts rows, sorted by a field, into tiles of equal numbers of rows."""
    df = only(inputs)
    n = int(value_of(config.get("NumTiles"), "4"))
    fields = config.get("GroupFields")
    groups = [quoted(g) for g in names_of(fields.get("Field") if isinstance(fields, dict) else fields)]
    f = value_of(config.get("Field")) or value_of(config.get("EqualRecordsGroupField"))
    keys = [(find(df.schema, f).name, True)] if f else ctx.order(df, "tile")
    if groups:
        tiles = df.withColumn("Tile_Num", F.ntile(n).over(Window.partitionBy(*groups).orderBy(*sorting(keys))))
        return {"Output": tiles.withColumn("Tile_SequenceNum", F.row_number().over(Window.partitionBy(*groups, "Tile_Num").orderBy(*sorting(keys))))}
    # by running numbers: the first tiles have one row more where rows don't divide evenly
    rows = numbered(df, keys, "__i").join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all"))))  # one row
    i, size, more = F.col("__i"), F.floor(F.col("__all") / n), F.col("__all") % n
    wide = i < more * (size + 1)
    number = F.when(wide, F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    within = F.when(wide, i % (size + 1)).otherwise((i - more * (size + 1)) % F.greatest(size, F.lit(1)))
    return {"Output": rows.select(*map(quoted, df.columns), (number + 1).cast("int").alias("Tile_Num"), (within + 1).cast("int").alias("Tile_SequenceNum"))}
