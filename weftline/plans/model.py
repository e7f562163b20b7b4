"""Workflows as graphs of tools."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

#: Tools that do nothing to rows.
SILENT = ("tool_container", "comment", "browse", "browse_v2", "text_box")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Tool:
    id: int
    kind: str
    config: dict = field(default_factory=dict, hash=False)
    plugin: str = ""
    annotation: str = ""
    position: tuple[float, float] = (0, 0)
    fields: tuple[Field, ...] = ()
    macro: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Connection:
    origin: int
    destination: int
    origin_anchor: str = "Output"
    destination_anchor: str = "Input"
    wireless: bool = False
    order: int | None = None


@dataclass(frozen=True)
class Workflow:
    tools: tuple[Tool, ...]
    connections: tuple[Connection, ...]
    name: str = ""

    def graph(self) -> Graph:
        return Graph(self)


class Graph:
    """Tools and edges without the silent tools; unknown ids and cycles are errors."""

    def __init__(self, workflow: Workflow):
        known = {t.id: t for t in workflow.tools}
        self.tools = {i: t for i, t in known.items() if t.kind not in SILENT}
        self.into: dict[int, list[Connection]] = defaultdict(list)
        self.out_of: dict[int, list[Connection]] = defaultdict(list)
        for c in workflow.connections:
            for end in (c.origin, c.destination):
                if end not in known:
                    raise ValueError(f"a connection names tool {end}, which is not in the workflow")
            if c.origin in self.tools and c.destination in self.tools:
                self.into[c.destination].append(c)
                self.out_of[c.origin].append(c)
        for edges in self.into.values():
            edges.sort(key=lambda c: (c.order if c.order is not None else 1 << 30))
        try:
            self.order = list(TopologicalSorter({i: sorted({c.origin for c in self.into[i]}) for i in sorted(self.tools)}).static_order())
        except CycleError as e:
            raise ValueError(f"the workflow has a cycle: {e.args[1]}") from e

    @property
    def sources(self) -> list[int]:
        return [i for i in self.order if not self.into[i]]

    @property
    def sinks(self) -> list[int]:
        return [i for i in self.order if not self.out_of[i]]

    def chains(self) -> list[list[int]]:
        """Runs of tools with one input and one consumer, for reports; Catalyst merges them by itself."""
        out: list[list[int]] = []
        at: dict[int, int] = {}
        for i in self.order:
            before = self.into[i]
            if len(before) == 1 and len(self.out_of[before[0].origin]) == 1 and before[0].origin_anchor in ("Output", "True"):
                at[i] = at[before[0].origin]
                out[at[i]].append(i)
            else:
                at[i] = len(out)
                out.append([i])
        return out
