"""Syntax trees to Spark columns.

Every tree compiles to a column and a kind (str, num, bool, date, ts, null, any), taken from the input's schema and
from what functions return. Kinds direct ``+`` (concatenation when either side is text), comparisons of text with
numbers, and dates inside texts. Lenient functions of the language map to ``try_`` functions: bad values give null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.parser import ExpressionError, Node, parse

Typed = tuple[Column, str]


class UnsupportedFunction(ExpressionError):
    pass


@dataclass
class Scope:
    """What an expression can see. ``row`` resolves [Row-1:x] references; ``rewrite`` is asked for Spark SQL where an
    expression can't be compiled."""

    schema: T.StructType
    variables: dict = field(default_factory=dict)
    row: Callable[[int, str], Column] | None = None
    current: tuple[str, str] | None = None
    case_sensitive: bool = True
    zero_based: bool = False
    swap_diff: bool = False
    first_letter_only: bool = False
    rewrite: Callable[[str, T.StructType], str | None] | None = None


def kind_of(t: T.DataType) -> str:
    for base, kind in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.NumericType, "num"), (T.DateType, "date"), (T.TimestampType, "ts"), (T.TimestampNTZType, "ts"), (T.NullType, "null")):
        if isinstance(t, base):
            return kind
    return "any"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def find(schema: T.StructType, name: str) -> T.StructField:
    """The column of that name: as written, else ignoring case."""
    for f in schema:
        if f.name == name:
            return f
    for f in schema:
        if f.name.lower() == name.lower():
            return f
    raise ExpressionError(f"no column [{name}]; there are {', '.join(schema.names)}")


def text(x: Typed) -> Column:
    """As text, dates in the form of the language."""
    col, kind = x
    if kind == "ts":
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col if kind == "str" else col.cast("string")


def number(x: Typed) -> Column:
    col, kind = x
    if kind in ("num", "any"):
        return col
    if kind == "bool":
        return col.cast("int")
    return col.try_cast("double")


def moment(x: Typed) -> Column:
    col, kind = x
    return col if kind == "ts" else col.try_cast("timestamp_ntz")


def day(x: Typed) -> Column:
    return x[0] if x[1] == "date" else x[0].try_cast("date")


def condition(x: Typed) -> Column:
    return x[0] if x[1] in ("bool", "any", "null") else (number(x) != 0)


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def compile(self, node: Node) -> Typed:
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _lit(self, value) -> Typed:
        kinds = {bool: "bool", int: "num", float: "num", str: "str", type(None): "null"}
        return F.lit(value), kinds[type(value)]

    def _col(self, name: str) -> Typed:
        if name in ("_CurrentField_", "_CurrentFieldName_") and self.scope.current:
            if name == "_CurrentFieldName_":
                return F.lit(self.scope.current[0]), "str"
            name = self.scope.current[1]
        f = find(self.scope.schema, name)
        return quoted(f.name), kind_of(f.dataType)

    def _var(self, name: str) -> Typed:
        for k, v in self.scope.variables.items():
            if re.sub(r"\W", "_", k).lower() == name.lower():
                return self._lit(v)
        raise ExpressionError(f"no value for [Engine.{name}]")

    def _row(self, offset: int, name: str) -> Typed:
        if self.scope.row is None:
            raise ExpressionError(f"[Row{offset:+d}:{name}] only has a meaning in a multi-row formula")
        f = find(self.scope.schema, name)
        return self.scope.row(offset, f.name), kind_of(f.dataType)

    def _un(self, op: str, x: Node) -> Typed:
        value = self.compile(x)
        if op == "NOT":
            return ~condition(value), "bool"
        return (-number(value) if op == "-" else number(value)), "num"

    def _bin(self, op: str, left: Node, right: Node) -> Typed:
        a, b = self.compile(left), self.compile(right)
        if op in ("AND", "OR"):
            return (condition(a) & condition(b) if op == "AND" else condition(a) | condition(b)), "bool"
        if op in ("=", "!=", "<", "<=", ">", ">="):
            x, y = self.comparable(a, b)
            return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool"
        if op == "+" and "str" in (a[1], b[1]):
            return F.concat(text(a), text(b)), "str"
        x, y = number(a), number(b)
        if op == "/":
            return F.try_divide(x.cast("double"), y.cast("double")), "num"
        if op == "%":
            return F.try_mod(x, y), "num"
        return {"+": x + y, "-": x - y, "*": x * y}[op], "num"

    def comparable(self, a: Typed, b: Typed) -> tuple[Column, Column]:
        kinds = {a[1], b[1]} - {"null", "any"}
        if len(kinds) < 2:
            if kinds == {"str"} and not self.scope.case_sensitive:
                return F.lower(a[0]), F.lower(b[0])
            return a[0], b[0]
        if "ts" in kinds:
            return moment(a), moment(b)
        if "date" in kinds:
            return day(a), day(b)
        return number(a), number(b)

    def _in(self, x: Node, items: list[Node], negated: bool) -> Typed:
        value, out = self.compile(x), None
        for item in items:
            a, b = self.comparable(value, self.compile(item))
            out = a == b if out is None else out | (a == b)
        out = F.lit(False) if out is None else out
        return (~out if negated else out), "bool"

    def _if(self, cases: list[tuple[Node, Node]], otherwise: Node) -> Typed:
        values = [self.compile(v) for _, v in cases] + [self.compile(otherwise)]
        values, kind = self.alike(values)
        out = None
        for (test, _), value in zip(cases, values, strict=False):
            c = condition(self.compile(test))
            out = F.when(c, value) if out is None else out.when(c, value)
        return out.otherwise(values[-1]), kind

    def alike(self, values: list[Typed]) -> tuple[list[Column], str]:
        """Branches of one kind: that of all, or text if they differ (a date among timestamps becomes one)."""
        kinds = {k for _, k in values} - {"null"}
        if len(kinds) <= 1:
            return [c for c, _ in values], next(iter(kinds), "null")
        if kinds == {"date", "ts"}:
            return [moment(v) if v[1] != "null" else v[0] for v in values], "ts"
        if kinds == {"num", "bool"}:
            return [number(v) if v[1] != "null" else v[0] for v in values], "num"
        return [text(v) if v[1] != "null" else v[0] for v in values], "str"

    def _call(self, name: str, args: list[Node]) -> Typed:
        if name not in FUNCTIONS:
            raise UnsupportedFunction(f"function {name} is not supported")
        fn, low, high = FUNCTIONS[name]
        if not low <= len(args) <= high:
            raise ExpressionError(f"{name} takes {low} to {high} arguments, not {len(args)}")
        return fn(self, *args)


FUNCTIONS: dict[str, tuple[Callable, int, float]] = {}


def function(*names: str, args: tuple[int, float]):
    def add(fn):
        for n in names:
            FUNCTIONS[n] = (fn, *args)
        return fn

    return add


def register_function(name: str, fn: Callable[..., Column], kind: str = "any") -> None:
    """Add a scalar function of the user: columns in, column out."""
    FUNCTIONS[name.upper()] = (lambda c, *a: (fn(*(c.compile(x)[0] for x in a)), kind), 0, math.inf)


def compile_expression(source: str, scope: Scope) -> Typed:
    try:
        return Compiler(scope).compile(parse(source))
    except ExpressionError:
        sql = scope.rewrite(source, scope.schema) if scope.rewrite else None
        if not sql:
            raise
        return F.expr(sql), "any"


def _literal(node: Node):
    if node[0] == "un" and node[1] == "-" and node[2][0] == "lit":
        return -node[2][1]
    return node[1] if node[0] == "lit" else None


# Functions of one argument that stay what Spark has: name, how the argument is taken, result.
for _name, _take, _fn, _kind in (
    ("LENGTH", text, F.length, "num"),
    ("UPPERCASE", text, F.upper, "str"),
    ("LOWERCASE", text, F.lower, "str"),
    ("TRIM", text, lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "str"),
    ("TRIMLEFT", text, lambda c: F.regexp_replace(c, r"^\s+", ""), "str"),
    ("TRIMRIGHT", text, lambda c: F.regexp_replace(c, r"\s+$", ""), "str"),
    ("REVERSESTRING", text, F.reverse, "str"),
    ("TONUMBER", text, lambda c: c.try_cast("double"), "num"),
    ("TOINTEGER", text, lambda c: c.try_cast("double").try_cast("int"), "num"),
    ("TOSTRING", text, lambda c: c, "str"),
    ("ISINTEGER", text, lambda c: c.try_cast("int").isNotNull(), "bool"),
    ("ISNUMERIC", text, lambda c: c.try_cast("double").isNotNull(), "bool"),
    ("ISNUMBER", text, lambda c: c.try_cast("double").isNotNull(), "bool"),
    ("ABS", number, F.abs, "num"),
    ("CEILING", number, F.ceil, "num"),
    ("CEIL", number, F.ceil, "num"),
    ("FLOOR", number, F.floor, "num"),
    ("SQRT", number, lambda c: F.when(c >= 0, F.sqrt(c)), "num"),
    ("EXP", number, F.exp, "num"),
    ("LOG", number, F.ln, "num"),
    ("LOG10", number, F.log10, "num"),
    ("SIN", number, F.sin, "num"),
    ("COS", number, F.cos, "num"),
    ("TAN", number, F.tan, "num"),
    ("ASIN", number, F.asin, "num"),
    ("ACOS", number, F.acos, "num"),
    ("ATAN", number, F.atan, "num"),
    ("CHARTOINT", text, F.ascii, "num"),
    ("CHARFROMINT", number, lambda c: F.char(c.cast("int")), "str"),
    ("INTTOBIN", number, lambda c: F.bin(c.cast("long")), "str"),
    ("INTTOHEX", number, lambda c: F.hex(c.cast("long")), "str"),
    ("HEXTONUMBER", text, lambda c: F.conv(c, 16, 10).cast("long"), "num"),
    ("BINTOINT", text, lambda c: F.conv(c, 2, 10).cast("long"), "num"),
    ("MD5_ASCII", text, lambda c: F.md5(c.cast("binary")), "str"),
    ("MD5_UTF8", text, lambda c: F.md5(c.cast("binary")), "str"),
    ("TODATE", lambda x: x, day, "date"),
    ("TODATETIME", lambda x: x, moment, "ts"),
    ("DATE", lambda x: x, day, "date"),
    ("DATETIMEYEAR", moment, F.year, "num"),
    ("DATETIMEMONTH", moment, F.month, "num"),
    ("DATETIMEDAY", moment, F.dayofmonth, "num"),
    ("DATETIMEHOUR", moment, F.hour, "num"),
    ("DATETIMEMINUTES", moment, F.minute, "num"),
    ("DATETIMESECONDS", moment, lambda c: F.second(c), "num"),
    ("ESCAPEXMLMETACHARACTERS", text, lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")), "str"),
):
    FUNCTIONS[_name] = ((lambda take, fn, kind: lambda c, x: (fn(take(c.compile(x))), kind))(_take, _fn, _kind), 1, 1)


@function("NULL", args=(0, 0))
def _null(c):
    return F.lit(None), "null"


@function("ISNULL", args=(1, 1))
def _isnull(c, x):
    return c.compile(x)[0].isNull(), "bool"


@function("ISNOTNULL", args=(1, 1))
def _isnotnull(c, x):
    return c.compile(x)[0].isNotNull(), "bool"


@function("ISEMPTY", args=(1, 1))
def _isempty(c, x):
    value = c.compile(x)
    return value[0].isNull() | F.coalesce(text(value) == "", F.lit(False)), "bool"


@function("COALESCE", args=(1, math.inf))
def _coalesce(c, *xs):
    values, kind = c.alike([c.compile(x) for x in xs])
    return F.coalesce(*values), kind


@function("IIF", args=(3, 3))
def _iif(c, test, yes, no):
    return c._if([(test, yes)], no)


@function("SWITCH", args=(2, math.inf))
def _switch(c, value, default, *pairs):
    if len(pairs) % 2:
        raise ExpressionError("SWITCH takes a value, a default and pairs")
    if not pairs:
        return c.compile(default)
    return c._if([(("bin", "=", value, pairs[i]), pairs[i + 1]) for i in range(0, len(pairs), 2)], default)


def _search(c, a, b) -> tuple[Column, Column]:
    x, y = text(c.compile(a)), text(c.compile(b))
    return (x, y) if c.scope.case_sensitive else (F.lower(x), F.lower(y))


@function("CONTAINS", args=(2, 2))
def _contains(c, a, b):
    x, y = _search(c, a, b)
    return x.contains(y), "bool"


@function("STARTSWITH", args=(2, 2))
def _startswith(c, a, b):
    x, y = _search(c, a, b)
    return x.startswith(y), "bool"


@function("ENDSWITH", args=(2, 2))
def _endswith(c, a, b):
    x, y = _search(c, a, b)
    return x.endswith(y), "bool"


@function("TITLECASE", args=(1, 1))
def _titlecase(c, x):
    value = text(c.compile(x))
    if c.scope.first_letter_only:
        return F.concat(F.upper(F.left(value, F.lit(1))), F.lower(F.substr(value, F.lit(2)))), "str"
    return F.initcap(value), "str"


@function("LEFT", args=(2, 2))
def _left(c, x, n):
    return F.left(text(c.compile(x)), number(c.compile(n)).cast("int")), "str"


@function("RIGHT", args=(2, 2))
def _right(c, x, n):
    return F.right(text(c.compile(x)), number(c.compile(n)).cast("int")), "str"


@function("SUBSTRING", args=(2, 3))
def _substring(c, x, start, length=None):
    at = number(c.compile(start)).cast("int") + (1 if c.scope.zero_based else 0)
    more = [] if length is None else [number(c.compile(length)).cast("int")]
    return F.substr(text(c.compile(x)), at, *more), "str"


@function("REPLACE", args=(3, 3))
def _replace(c, x, old, new):
    return F.replace(*(text(c.compile(a)) for a in (x, old, new))), "str"


@function("REPLACECHAR", args=(3, 3))
def _replacechar(c, x, old, new):
    """Each of the characters of the second text becomes the first character of the third."""
    chars, one = _literal(old), _literal(new)
    if not isinstance(chars, str) or not isinstance(one, str):
        raise ExpressionError("REPLACECHAR takes literal characters")
    return F.translate(text(c.compile(x)), chars, one[:1] * len(chars)), "str"


@function("FINDSTRING", args=(2, 3))
def _findstring(c, x, part, start=None):
    at = F.lit(1) if start is None else number(c.compile(start)).cast("int")
    found = F.position(text(c.compile(part)), text(c.compile(x)), at)
    return (found - 1 if c.scope.zero_based else found), "num"


@function("PADLEFT", args=(3, 3))
def _padleft(c, x, n, pad):
    value, size = text(c.compile(x)), number(c.compile(n)).cast("int")
    return F.lpad(value, F.greatest(size, F.length(value)), text(c.compile(pad))), "str"


@function("PADRIGHT", args=(3, 3))
def _padright(c, x, n, pad):
    value, size = text(c.compile(x)), number(c.compile(n)).cast("int")
    return F.rpad(value, F.greatest(size, F.length(value)), text(c.compile(pad))), "str"


@function("POW", args=(2, 2))
def _pow(c, x, y):
    return F.pow(number(c.compile(x)), number(c.compile(y))), "num"


@function("MOD", args=(2, 2))
def _mod(c, x, y):
    return F.try_mod(number(c.compile(x)), number(c.compile(y))), "num"


@function("ATAN2", args=(2, 2))
def _atan2(c, y, x):
    return F.atan2(number(c.compile(y)), number(c.compile(x))), "num"


@function("PI", args=(0, 0))
def _pi(c):
    return F.lit(math.pi), "num"


@function("RAND", args=(0, 0))
def _rand(c):
    return F.rand(), "num"


@function("MIN", args=(1, math.inf))
def _min(c, *xs):
    values = [number(c.compile(x)) for x in xs]
    return (F.least(*values) if len(values) > 1 else values[0]), "num"


@function("MAX", args=(1, math.inf))
def _max(c, *xs):
    values = [number(c.compile(x)) for x in xs]
    return (F.greatest(*values) if len(values) > 1 else values[0]), "num"


@function("ROUND", args=(1, 2))
def _round(c, x, multiple=None):
    """To a multiple. For powers of ten that is rounding to decimal places."""
    value = number(c.compile(x))
    m = 1 if multiple is None else _literal(multiple)
    if isinstance(m, (int, float)) and not isinstance(m, bool):
        if m <= 0:
            return value, "num"
        places = round(-math.log10(m))
        if math.isclose(10.0**-places, m, rel_tol=1e-9):
            return F.round(value, places), "num"
        return F.round(value / m) * m, "num"
    by = number(c.compile(multiple))
    return F.when(by > 0, F.round(F.try_divide(value, by)) * by).otherwise(value), "num"


# Names of units, and their names in timestamp functions.
UNITS = {
    "year": "YEAR", "years": "YEAR", "yy": "YEAR", "yyyy": "YEAR", "quarter": "QUARTER", "quarters": "QUARTER",
    "month": "MONTH", "months": "MONTH", "mm": "MONTH", "week": "WEEK", "weeks": "WEEK", "day": "DAY", "days": "DAY", "dd": "DAY",
    "hour": "HOUR", "hours": "HOUR", "hh": "HOUR", "minute": "MINUTE", "minutes": "MINUTE", "mi": "MINUTE",
    "second": "SECOND", "seconds": "SECOND", "ss": "SECOND", "millisecond": "MILLISECOND", "milliseconds": "MILLISECOND", "ms": "MILLISECOND",
}


def _unit(node: Node) -> str | None:
    value = _literal(node)
    return UNITS.get(value.lower()) if isinstance(value, str) else None


@function("DATETIMEADD", args=(3, 3))
def _datetimeadd(c, *xs):
    unit = _unit(xs[0])
    n, when = (xs[1], xs[2]) if unit else (xs[1], xs[0])
    unit = unit or _unit(xs[2])
    if unit is None:
        raise ExpressionError("DATETIMEADD needs a literal unit")
    return F.timestamp_add(unit, number(c.compile(n)).cast("int"), moment(c.compile(when))).cast("timestamp_ntz"), "ts"


@function("DATETIMEDIFF", args=(3, 3))
def _datetimediff(c, *xs):
    """How many unit boundaries lie between the moments; positive if the second is later."""
    unit = _unit(xs[0])
    a, b = (xs[1], xs[2]) if unit else (xs[0], xs[1])
    unit = unit or _unit(xs[2])
    if unit is None:
        raise ExpressionError("DATETIMEDIFF needs a literal unit")
    if c.scope.swap_diff:
        a, b = b, a
    x, y = (F.date_trunc(unit, moment(c.compile(v))).cast("timestamp_ntz") for v in (a, b))
    return F.timestamp_diff(unit, x, y), "num"


@function("DATETIMENOW", args=(0, 0))
def _now(c):
    return F.localtimestamp(), "ts"


@function("DATETIMETODAY", args=(0, 0))
def _today(c):
    return F.current_date(), "date"


@function("DATETIMEFIRSTOFMONTH", args=(0, 0))
def _firstofmonth(c):
    return F.trunc(F.current_date(), "month"), "date"


@function("DATETIMETRIM", args=(2, 2))
def _datetimetrim(c, x, unit):
    value, name = moment(c.compile(x)), str(_literal(unit)).lower()
    if name == "firstofmonth":
        return F.date_trunc("month", value).cast("timestamp_ntz"), "ts"
    if name == "lastofmonth":
        return (F.date_trunc("month", value) + F.expr("interval 1 month") - F.expr("interval 1 second")).cast("timestamp_ntz"), "ts"
    if name not in UNITS:
        raise ExpressionError(f"DATETIMETRIM has no unit {name!r}")
    return F.date_trunc(UNITS[name], value).cast("timestamp_ntz"), "ts"


# Date specifiers of the language and what they are in Spark.
SPECIFIERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "%": "%"}


def pattern_of(fmt: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)", fmt, re.S):
        if m[1]:
            if m[1] not in SPECIFIERS:
                raise ExpressionError(f"date specifier %{m[1]} is not supported")
            out += SPECIFIERS[m[1]]
        else:
            out += re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2])
    return out


@function("DATETIMEFORMAT", args=(2, 2))
def _datetimeformat(c, x, fmt):
    return F.date_format(moment(c.compile(x)), pattern_of(str(_literal(fmt)))), "str"


@function("DATETIMEPARSE", args=(2, 2))
def _datetimeparse(c, x, fmt):
    return F.try_to_timestamp(text(c.compile(x)), F.lit(pattern_of(str(_literal(fmt))))).cast("timestamp_ntz"), "ts"


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """POSIX classes in brackets become Java's; the language ignores case unless told otherwise."""
    # Names of character classes.
    names = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "punct": r"\p{P}\p{S}", "space": r"\s", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "word": r"\w"}
    for name, java in names.items():
        pattern = pattern.replace(f"[:{name}:]", java)
    return ("(?i)" if ignore_case else "") + pattern


def _flag(node: Node | None) -> bool:
    return node is None or bool(_literal(node))


@function("REGEX_MATCH", args=(2, 3))
def _regex_match(c, x, pattern, ignore=None):
    """Whether the whole text matches."""
    return text(c.compile(x)).rlike(java_pattern(f"^(?:{_literal(pattern)})$", _flag(ignore))), "bool"


@function("REGEX_REPLACE", args=(3, 4))
def _regex_replace(c, x, pattern, new, ignore=None):
    return F.regexp_replace(text(c.compile(x)), java_pattern(str(_literal(pattern)), _flag(ignore)), str(_literal(new))), "str"


@function("REGEX_COUNTMATCHES", args=(2, 3))
def _regex_count(c, x, pattern, ignore=None):
    return F.regexp_count(text(c.compile(x)), F.lit(java_pattern(str(_literal(pattern)), _flag(ignore)))), "num"


@function("GETENVIRONMENTVARIABLE", args=(1, 1))
def _environment(c, x):
    """What the run's variables hold under that name: a cluster's environments are not the workflow's."""
    value = c.scope.variables.get(str(_literal(x)))
    return F.lit(None if value is None else str(value)), "str"


@function("ERROR", args=(1, 1))
def _error(c, x):
    return F.raise_error(text(c.compile(x))), "null"
