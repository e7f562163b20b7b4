import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import ExpressionError, Scope, UnsupportedFunction, compile_expression, parse, register_function

ROW = "select 3 x, 2.5D y, 'abc def' s, cast(null as string) n, timestamp_ntz'2020-01-31 10:30:00' t, date'2020-02-29' d, true b, 'k' `odd name-1`"


@pytest.fixture(scope="module")
def one(spark):
    df = spark.sql(ROW).cache()

    def value(text, **how):
        return df.select(compile_expression(text, Scope(df.schema, **how))[0].alias("v")).first().v

    return value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-[x] + 5", 2), ("7 / 2", 3.5), ("1 / 0", None), ("7 % 4", 3), ("2 - 3 - 4", -5),
        ("'a' + 1", "a1"), ("[s] + '!'", "abc def!"), ("[n] + 'x'", None), ('"it\'s"', "it's"), ("[X]", 3), ("[odd name-1]", "k"),
        ("[x] == 3 && ![b]", False), ("[x] = 3 || False", True), ("NOT [x] = 4", True), ("[x] != 3", False), ("[x] <> 4", True), ("'5' > 4", True),
        ("[x] IN (1, 2, 3)", True), ("[s] NOT IN ('a', 'b')", True), ("[Null]", None), ("Null()", None), ("IsNull([n])", True), ("IsEmpty([n])", True), ("IsEmpty('')", True),
        ("IF [x] > 5 THEN 'big' ELSEIF [x] > 2 THEN 'mid' ELSE 'low' ENDIF", "mid"), ("IF [x] > 5 THEN 1 ELSE 2 ENDIF + 1", 3), ("IF [x] > 5 THEN 1 ENDIF", None),
        ("IIF([b], IIF([x] > 1, 'p', 'q'), 'r')", "p"), ("SWITCH([x], 'none', 1, 'one', 3, 'three')", "three"), ("SWITCH([x], 'none', 1, 'one')", "none"),
        ("'True'", "True"), ("Contains([s], 'c d')", True), ("StartsWith([s], 'ab')", True), ("EndsWith([s], '%')", False),
        ("FindString([s], 'd')", 5), ("FindString([s], 'zz')", 0), ("FindString([s], 'd', 6)", 0), ("TitleCase([s])", "Abc Def"), ("Left([s], 2) + Right([s], 1)", "abf"),
        ("PadLeft('7', 3, '0')", "007"), ("PadLeft('12345', 3, '0')", "12345"), ("Length('ab ')", 3), ("Trim('  a b ')", "a b"), ("ReplaceChar('a-b_c', '-_', '.')", "a.b.c"),
        ("Round(2.345, 0.01)", 2.35), ("Round(1234, 10)", 1230), ("Round(7, 5)", 5.0), ("Round(2.5, 1)", 3.0), ("Round(2.5, 0)", 2.5), ("Round(7.3, [y])", 7.5),
        ("ToNumber('x')", None), ("ToNumber(' 1.5')", 1.5), ("ToInteger('12.7')", 12), ("IsInteger('1.5')", False), ("IsInteger('15')", True), ("IsNumeric('1e3')", True),
        ("DateTimeAdd([t], 1, 'months')", dt.datetime(2020, 2, 29, 10, 30)), ("DateTimeAdd('days', -1, '2020-01-01')", dt.datetime(2019, 12, 31)), ("DateTimeDiff('month', [t], [d])", 1), ("DateTimeDiff([t], [d], 'year')", 0),
        ("DateTimeDiff('day', '2020-01-01 23:00:00', '2020-01-02 01:00:00')", 1), ("DateTimeFormat([t], '%Y/%m/%d %H')", "2020/01/31 10"), ("DateTimeTrim([t], 'lastofmonth')", dt.datetime(2020, 1, 31, 23, 59, 59)),
        ("'at ' + [t]", "at 2020-01-31 10:30:00"), ("ToDate('2020-13-01')", None), ("DateTimeYear([t])", 2020), ("[t] > '2020-01-01'", True),
        ("REGEX_Match('ABC', '[a-c]+')", True), ("REGEX_Match('ABCx', '[a-c]+')", False), ("REGEX_Replace('a1b2', '[[:digit:]]', '#')", "a#b#"), ("REGEX_CountMatches('banana', 'an')", 2),
        ("1 // half\n + 1", 2), ("1 /* no */ + 1", 2), ("Min(3, 1, 2) + Max(4, 5)", 6), ("HexToNumber('ff')", 255), ("Abs(-2) + Ceil(1.2) + Floor(1.8)", 5),
    ],
)
def test_values(one, text, want):
    got = one(text)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_options(one):
    assert one("FindString([s], 'd')", zero_based=True) == 4
    assert one("Substring([s], 0, 2)", zero_based=True) == "ab"
    assert one("Contains([s], 'ABC')", case_sensitive=False) is True
    assert one("TitleCase([s])", first_letter_only=True) == "Abc def"
    assert one("DateTimeDiff('day', '2020-01-02', '2020-01-01')", swap_diff=True) == 1
    assert one("'in ' + [Engine.Some.Name]", variables={"Some_Name": "x"}) == "in x"


@pytest.mark.parametrize("text", ["1 +", "IF 1 THEN 2", "(1", "[a] ~ 2", "SWITCH(1, 2, 3)", "Left('a')", "[Row-1:x]", "[nothing]", "[Engine.None]"])
def test_errors(one, text):
    with pytest.raises(ExpressionError):
        one(text)


def test_unknown_function(one):
    with pytest.raises(UnsupportedFunction):
        one("GetSelectedField('x')")
    register_function("Twice", lambda c: c * 2, "num")
    assert one("Twice([x]) + 1") == 7
    assert F is not None


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=12))
def test_arithmetic_parses_as_in_python(text):
    def value(n):
        if n[0] == "lit":
            return n[1]
        a, b = value(n[2]), value(n[3])
        return {"+": a + b, "-": a - b, "*": a * b}[n[1]]

    assert value(parse(text)) == eval(text)
