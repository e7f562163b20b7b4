"""The same graphs, built in Python."""

from __future__ import annotations

from weftline.plans.model import Connection, Tool, Workflow


class Flow:
    """``flow.add(kind, config, Input=tool)``: tools in turn; an input is a tool's number or (number, anchor)."""

    def __init__(self, name: str = ""):
        self.name, self.tools, self.connections = name, [], []

    def add(self, kind: str, config: dict | None = None, *inputs, macro: str | None = None, **anchors) -> int:
        number = len(self.tools) + 1
        self.tools.append(Tool(number, kind, config or {}, macro=macro))
        ends = [("Input", x) for x in inputs] + [(a, x) for a, x in anchors.items()]
        for k, (anchor, x) in enumerate(ends, 1):
            origin, out = x if isinstance(x, tuple) else (x, "Output")
            self.connections.append(Connection(origin, number, out, anchor, order=k))
        return number

    def workflow(self) -> Workflow:
        return Workflow(tuple(self.tools), tuple(self.connections), self.name)
