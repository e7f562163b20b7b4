"""A readable account of a workflow and its run."""

from __future__ import annotations

from collections.abc import Callable

from weftline.plans.model import Workflow
from weftline.plans.planner import Run


def overview(workflow: Workflow) -> str:
    """What a dry run tells: tools in order, and chains."""
    graph = workflow.graph()
    lines = [f"{workflow.name or 'workflow'}: {len(graph.tools)} tools, {sum(map(len, graph.into.values()))} connections, {len(graph.chains())} chains"]
    for k, chain in enumerate(graph.chains(), 1):
        lines.append(f"  {k}. " + " -> ".join(f"{graph.tools[i].kind} ({i})" for i in chain))
    return "\n".join(lines)


def markdown(run: Run, narrative: str | Callable[[Run], str] = "") -> str:
    """``narrative``: a text, or what gives one for a run."""
    narrative = narrative(run) if callable(narrative) else narrative
    graph, out = run.graph, [f"# {run.workflow.name or 'Workflow'}", ""]
    if narrative:
        out += [narrative, ""]
    out += [f"{len(graph.tools)} tools, {len(graph.sources)} sources, {len(graph.sinks)} sinks, {len(run.stubs)} stubs.", "", "## Tools", "", "| Tool | Kind | Note | From | Columns |", "|---|---|---|---|---|"]
    for i in graph.order:
        tool = graph.tools[i]
        before = ", ".join(f"{c.origin} {c.origin_anchor}" for c in graph.into[i])
        columns = "; ".join(f"{a}: {', '.join(df.columns)}" for (t, a), df in run.frames.items() if t == i)
        note = (tool.annotation or tool.source or "").replace("|", "\\|").replace("\n", " ")
        out.append(f"| {i} | {tool.kind} | {note} | {before} | {columns.replace('|', chr(92) + '|')} |")
    for title, items in (("Rewrites", run.rewrites), ("Warnings", run.warnings), ("Stubs", [f"tool {i}" for i in run.stubs])):
        if items:
            out += ["", f"## {title}", "", *(f"- {x}" for x in items)]
    return "\n".join(out) + "\n"
