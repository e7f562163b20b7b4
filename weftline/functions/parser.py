"""Expressions to syntax trees: a tokenizer and a Pratt parser.

Trees are tuples whose first item names the node: ("lit", value), ("col", name), ("var", name), ("row", offset, name),
("un", op, x), ("bin", op, a, b), ("in", x, [items], negated), ("if", [(cond, value)], otherwise), ("call", NAME, [args]).
"""

from __future__ import annotations

import re

Node = tuple


class ExpressionError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<str>"[^"]*"|'[^']*')
    |\[(?P<col>[^\]]+)\]
    |(?P<op>==|!=|<>|<=|>=|&&|\|\||[-+*/%=<>!(),])
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)""",
    re.X | re.S,
)
_BINDING = {"OR": 1, "AND": 2, "=": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "IN": 4, "NOT": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_SAME = {"==": "=", "<>": "!=", "&&": "AND", "||": "OR", "!": "NOT"}
_ROW = re.compile(r"row([+-]\d+)\s*:(.+)", re.I | re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at} in {text!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "str":
            out.append(("str", m["str"][1:-1]))
        elif kind == "op":
            out.append(("op", _SAME.get(m["op"], m["op"])))
        elif kind == "word" and m["word"].upper() in ("AND", "OR", "NOT", "IN"):
            out.append(("op", m["word"].upper()))
        elif kind:
            out.append((kind, m[kind]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.text, self.list, self.at = text, tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.list[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.list[self.at - 1]

    def is_word(self, *words: str) -> bool:
        kind, value = self.peek()
        return kind == "word" and value.upper() in words

    def expect(self, value: str) -> None:
        kind, got = self.next()
        if got.upper() != value:
            raise ExpressionError(f"expected {value}, got {got or 'the end'} in {self.text!r}")

    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while self.peek()[0] == "op" and _BINDING.get(self.peek()[1], 0) > least:
            op = self.next()[1]
            if op == "NOT":
                if self.next() != ("op", "IN"):
                    raise ExpressionError(f"expected IN after NOT in {self.text!r}")
                left = ("in", left, self.arguments(), True)
            elif op == "IN":
                left = ("in", left, self.arguments(), False)
            else:
                left = ("bin", op, left, self.expression(_BINDING[op]))
        return left

    def arguments(self) -> list[Node]:
        self.expect("(")
        out: list[Node] = []
        if self.peek() == ("op", ")"):
            self.next()
            return out
        while True:
            out.append(self.expression())
            kind, value = self.next()
            if value == ")":
                return out
            if value != ",":
                raise ExpressionError(f"expected , or ) but got {value or 'the end'} in {self.text!r}")

    def prefix(self) -> Node:
        kind, value = self.next()
        if kind == "num":
            return ("lit", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return ("lit", value)
        if kind == "col":
            name = value.strip()
            if name.lower() == "null":
                return ("lit", None)
            if name.lower().startswith("engine."):
                return ("var", re.sub(r"\W", "_", name[7:]))
            if m := _ROW.fullmatch(name):
                return ("row", int(m[1]), m[2])
            return ("col", value)
        if kind == "op" and value == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        if kind == "op" and value in ("-", "+"):
            return ("un", value, self.expression(6))
        if kind == "op" and value == "NOT":
            return ("un", "NOT", self.expression(3))
        if kind == "word":
            word = value.upper()
            if word == "IF":
                return self.branches()
            if self.peek() == ("op", "("):
                return ("call", word, self.arguments())
            if word in ("TRUE", "FALSE"):
                return ("lit", word == "TRUE")
            if word == "NULL":
                return ("lit", None)
            return ("col", value)
        raise ExpressionError(f"unexpected {value or 'end'} in {self.text!r}")

    def branches(self) -> Node:
        cases, otherwise = [], ("lit", None)
        while True:
            condition = self.expression()
            self.expect("THEN")
            cases.append((condition, self.expression()))
            if self.is_word("ELSEIF"):
                self.next()
                continue
            if self.is_word("ELSE"):
                self.next()
                otherwise = self.expression()
            self.expect("ENDIF")
            return ("if", cases, otherwise)


def parse(text: str) -> Node:
    parser = _Parser(text)
    out = parser.expression()
    if parser.peek()[0] != "end":
        raise ExpressionError(f"unexpected {parser.peek()[1]!r} in {text!r}")
    return out


def walk(node: Node):
    """All nodes of a tree."""
    yield node
    for part in node[1:]:
        for x in part if isinstance(part, list) else [part]:
            if isinstance(x, tuple):
                for y in x if x and isinstance(x[0], tuple) else [x]:
                    yield from walk(y)
