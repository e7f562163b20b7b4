"""Tools on texts: find and replace, regular expressions, text to columns or rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.compiler import find, java_pattern, quoted
from weftline.operators.context import Context, ToolError, cast, listed, truth, type_of, value_of
from weftline.operators.rows import Frames, only, put


def find_replace(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Replace parts of fields, in place and in turn; literal, or by regular expression with isRegEx."""
    df = first = only(inputs)
    fields = listed((config.get("FindReplaceFields") or {}).get("FindReplaceField"))
    if not fields:
        ctx.warn("find replace: no fields; rows are passed on")
    for spec in fields:
        name = find(df.schema, spec["field"]).name
        old, new, exact = spec.get("find", ""), spec.get("replace", ""), truth(spec.get("matchCase"), True)
        col = quoted(name).cast("string")
        if truth(spec.get("isRegEx")):
            col = F.regexp_replace(col, java_pattern(old, not exact), new)
        elif exact:
            col = F.replace(col, F.lit(old), F.lit(new))
        else:
            col = F.regexp_replace(col, "(?iu)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))
        df = put(df, name, col)
    return {"Output": ctx.passed_on(first, df)}


def regex(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Methods Replace, Match, Parse (ParseComplex: a column for each group) and Token (ParseSimple: columns or rows)."""
    df = only(inputs)
    name = find(df.schema, value_of(config.get("Field"))).name
    method = value_of(config.get("Method"), "Replace").lower()
    raw = value_of(config.get("RegExExpression"))
    ignore = truth(config.get("CaseInsensitve", config.get("CaseInsensitive")), True)
    pattern, col = java_pattern(raw, ignore), quoted(name).cast("string")
    if method == "replace":
        part = config.get("Replace") if isinstance(config.get("Replace"), dict) else {}
        new = part.get("expression", value_of(config.get("ReplaceExpression")))
        done = F.regexp_replace(col, pattern, new)
        if "CopyUnmatched" in part and not truth(part["CopyUnmatched"], True):
            done = F.when(col.rlike(pattern), done)
        return {"Output": ctx.passed_on(df, put(df, name, done))}
    if method == "match":
        target = value_of((config.get("Match") or {}).get("Field") if isinstance(config.get("Match"), dict) else None) or f"{name}_Matched"
        return {"Output": ctx.passed_on(df, put(df, target, col.rlike(java_pattern(f"^(?:{raw})$", ignore))))}
    if method in ("parse", "parsecomplex"):
        part = config.get("ParseComplex") or config.get("Parse") or {}
        fields = listed(part.get("Field"))
        groups = re.compile(re.sub(r"\[:\w+:\]", "a", raw)).groups
        out = df
        for k in range(1, groups + 1):
            spec = fields[k - 1] if k <= len(fields) else {}
            value = F.when(col.rlike(pattern), F.regexp_extract(col, pattern, k))
            to = type_of(spec.get("type"), spec.get("size"))
            out = put(out, spec.get("field") or spec.get("name") or f"RegExOut{k}", cast(value, "str", to) if to is not None else value)
        return {"Output": ctx.passed_on(df, out)}
    if method in ("token", "tokenize", "parsesimple"):
        part = config.get("ParseSimple") or config.get("Token") or {}
        group = 1 if re.compile(re.sub(r"\[:\w+:\]", "a", raw)).groups else 0
        found = F.regexp_extract_all(col, F.lit(pattern), F.lit(group))
        if truth(part.get("SplitToRows")):
            return {"Output": put(df.withColumn("__t", F.explode_outer(found)), name, F.col("__t")).drop("__t")}
        return {"Output": ctx.passed_on(df, _spread(df, found, part.get("RootName") or name, int(value_of(part.get("NumFields"), "1"))))}
    raise ToolError(f"regex: unknown method {method!r}")


def _spread(df: DataFrame, parts: Column, root: str, n: int) -> DataFrame:
    out = df.withColumn("__parts", parts)
    for i in range(1, n + 1):
        out = put(out, f"{root}{i}", F.try_element_at("__parts", F.lit(i)))
    return out.drop("__parts")


def text_to_columns(inputs: Frames, config: dict, ctx: Context) -> Frames:
    """Split a field into columns Root1, Root2, ..., the last with the remainder; or into rows."""
    df = only(inputs)
    name = find(df.schema, value_of(config.get("Field"))).name
    delimiter = value_of(config.get("Delimeters", config.get("Delimiters")))
    n = int(value_of(config.get("NumFields"), "1") or 1)
    root = value_of(config.get("RootName"))
    delimiter = {"\\t": "\t", "\\n": "\n", "\\s": " "}.get(delimiter, delimiter)
    if not delimiter:
        raise ToolError("text to columns: no delimiter")
    if len(delimiter) > 1:
        ctx.warn("text to columns: the delimiter of several characters is taken as one")
    col, literal = quoted(name).cast("string"), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if not root and n == 1:
        return {"Output": put(df.withColumn("__t", F.explode_outer(F.split(col, literal, -1))), name, F.col("__t")).drop("__t")}
    return {"Output": ctx.passed_on(df, _spread(df, F.split(col, literal, n), root or name, n))}
