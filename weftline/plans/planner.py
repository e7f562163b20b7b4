"""Workflows to lazy DataFrames, one for each output anchor.

Some rewrites are made on the graph, as Catalyst can't see them: a join whose matched and unmatched outputs meet in
one union becomes an outer join; record ids given right before a unique tool are given after it; random and clock
tools with several consumers are persisted, so all see the same rows. All else is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath, PureWindowsPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.parser import ExpressionError
from weftline.operators import MACROS, TOOLS, Context, ToolError
from weftline.operators.context import listed
from weftline.operators.rows import names_of
from weftline.plans.document import parse_file
from weftline.plans.model import Connection, Graph, Tool, Workflow
from weftline.plans.registry import HANDLERS, Registry
from weftline.sources import db_input, db_output, text_input

MACRO_DEPTH = 3
_LEAVES = {"Left": "left", "Right": "right"}


@dataclass
class Run:
    """A compiled workflow. ``frames`` has the output of every anchor, not computed yet. (A few tools, whose columns depend
    on the data, have looked at it: see ``operators.reshape``, Cleanse and Pipe_to_Table.)"""

    workflow: Workflow
    graph: Graph
    frames: dict[tuple[int, str], DataFrame]
    warnings: list[str] = field(default_factory=list)
    stubs: list[int] = field(default_factory=list)
    joins: dict[int, str] = field(default_factory=dict)
    rewrites: list[str] = field(default_factory=list)

    def output(self, tool: int, anchor: str | None = None) -> DataFrame:
        if anchor is None:
            anchor = next(a for a in ("Output", "Join", "True", "Unique") if (tool, a) in self.frames)
        return self.frames[tool, anchor]

    def sinks(self) -> dict[int, DataFrame]:
        return {i: self.output(i) for i in self.graph.sinks}


def outer_joins(graph: Graph) -> tuple[dict[int, str], set[Connection]]:
    """Joins whose Join output goes to one union together with Left, Right or both; and the edges that this makes void."""
    how, void = {}, set()
    for i, tool in graph.tools.items():
        if tool.kind != "join":
            continue
        out: dict[str, list[Connection]] = {}
        for c in graph.out_of[i]:
            out.setdefault(c.origin_anchor, []).append(c)
        target = {c.destination for c in out.get("Join", [])}
        if len(out.get("Join", [])) != 1 or graph.tools[next(iter(target))].kind != "union":
            continue
        met = [a for a in _LEAVES if len(out.get(a, [])) == 1 and {c.destination for c in out[a]} == target]
        if met:
            how[i] = "full" if len(met) == 2 else _LEAVES[met[0]]
            void |= {out[a][0] for a in met}
    return how, void


def late_ids(graph: Graph) -> dict[int, int]:
    """Unique tools by the record-id tool right before them, where the id is given after all: its only consumer, and not the only key."""
    found = {}
    for i, tool in graph.tools.items():
        before = graph.into[i]
        if tool.kind == "unique" and len(before) == 1 and graph.tools[before[0].origin].kind == "record_id":
            origin = before[0].origin
            name = graph.tools[origin].config.get("FieldName") or "RecordID"
            fields = tool.config.get("UniqueFields")
            keys = names_of(fields.get("Field") if isinstance(fields, dict) else fields)
            if len(graph.out_of[origin]) == 1 and [k for k in keys if k != name] and not any(c.origin_anchor.startswith("Dup") for c in graph.out_of[i]):
                found[i] = origin
    return found


def uncertain(tool: Tool) -> bool:
    """Whether rows may differ each time they are computed."""
    text = str(tool.config).upper()
    return (tool.kind == "sample" and "RANDOM" in text) or "RAND()" in text or "DATETIMENOW" in text or bool(tool.macro and ("Random" in tool.macro or "DateTimeNow" in tool.macro))


def compile_workflow(spark: SparkSession, workflow: Workflow, *, context: Context | None = None, registry: Registry | None = None, macro_dirs: list[str | Path] = (), repair_columns: bool = False, fallback: Callable | None = None, _bound: dict[str, DataFrame] | None = None, _depth: int = 0) -> Run:
    """``fallback(tool, inputs, ctx)`` is asked for tools that nothing else knows; ``repair_columns`` puts back columns
    that a select dropped though a later tool names them."""
    ctx = context or Context(spark)
    graph = workflow.graph()
    if repair_columns:
        workflow = repair(spark, workflow, ctx, registry, macro_dirs)
        graph = workflow.graph()
    how, void = outer_joins(graph)
    if ctx.options.get("literal_unions"):
        how, void = {}, set()
    moved = late_ids(graph)
    run = Run(workflow, graph, {}, ctx.warnings, joins=how)
    run.rewrites += [f"join {i}: {h} join instead of a union with unmatched rows" for i, h in how.items()]
    run.rewrites += [f"record id {o} is given after unique {u}" for u, o in moved.items()]
    for i in graph.order:
        tool = graph.tools[i]
        inputs = _inputs(graph, i, run.frames, void)
        try:
            if i in moved.values():
                made = {"Output": next(iter(inputs.values()))}
            else:
                made = _compile(tool, inputs, ctx, how.get(i), registry, macro_dirs, fallback, _bound, _depth, run)
                if i in moved:
                    given = graph.tools[moved[i]]
                    made = {a: TOOLS["record_id"]({"Input": df}, given.config, ctx)["Output"] for a, df in made.items() if a == "Unique"}
        except (ToolError, ExpressionError) as e:
            raise type(e)(f"tool {i} ({tool.kind}): {e}") from e
        if uncertain(tool) and len(graph.out_of[i]) > 1:
            made = {a: df.persist() for a, df in made.items()}
        run.frames.update({(i, a): df for a, df in made.items()})
    return run


def _inputs(graph: Graph, i: int, frames: dict, void: set[Connection]) -> dict[str, DataFrame]:
    """By anchor; what comes to one anchor more than once is numbered in order."""
    out: dict[str, DataFrame] = {}
    for c in graph.into[i]:
        if c in void:
            continue
        df = frames.get((c.origin, c.origin_anchor))
        if df is None:
            alias = {"Output": ("Join", "True", "Unique"), "Duplicate": ("Duplicates",), "Duplicates": ("Duplicate",)}.get(c.origin_anchor, ("Output",))
            df = next((frames[c.origin, a] for a in alias if (c.origin, a) in frames), None)
        if df is None:
            raise ToolError(f"tool {c.origin} has no output {c.origin_anchor}")
        name, k = c.destination_anchor, 2
        while name in out:
            name, k = f"{c.destination_anchor}#{k}", k + 1
        out[name] = df
    return out


def _compile(tool: Tool, inputs: dict, ctx: Context, how, registry, macro_dirs, fallback, bound, depth, run: Run) -> dict[str, DataFrame]:
    if tool.plugin in HANDLERS or tool.kind in HANDLERS:
        return HANDLERS[tool.plugin if tool.plugin in HANDLERS else tool.kind](inputs, tool.config, ctx)
    if tool.kind in ("db_file_input", "odbc_input"):
        return {"Output": db_input(tool.config, ctx, [f.name for f in tool.fields])}
    if tool.kind == "text_input":
        return {"Output": text_input(tool.config, ctx)}
    if tool.kind in ("db_file_output", "odbc_output"):
        return {"Output": db_output(next(iter(inputs.values())), tool.config, ctx)}
    if tool.kind == "macro_input":
        name = tool.config.get("Name") or "Input"
        if bound is None or name not in bound:
            raise ToolError(f"nothing is bound to macro input {name}")
        return {"Output": bound[name]}
    if tool.kind == "macro_output":
        return {"Output": next(iter(inputs.values()))}
    if tool.kind == "macro" or tool.macro:
        return _macro(tool, inputs, ctx, registry, macro_dirs, fallback, depth, run)
    if tool.kind == "join":
        return TOOLS["join"](inputs, tool.config, ctx, how or "inner")
    if tool.kind in TOOLS:
        return TOOLS[tool.kind](inputs, tool.config, ctx)
    entry = registry.get(tool.plugin or tool.kind) if registry else None
    if entry:
        registry.used(tool.plugin or tool.kind)
        frames = dict(zip((f"input{k}" for k in range(len(inputs))), inputs.values(), strict=False))
        return {"Output": ctx.spark.sql(entry.sql, **frames)}
    if fallback:
        made = fallback(tool, inputs, ctx)
        if made:
            return made
    if not ctx.allow_stubs:
        raise ToolError(f"no handler for {tool.plugin or tool.kind}")
    ctx.warn(f"tool {tool.id} ({tool.plugin or tool.kind}) is a stub: rows are passed on")
    run.stubs.append(tool.id)
    return {"Output": next(iter(inputs.values())) if inputs else ctx.spark.range(0).select(F.lit(1).alias("_stub"))}


def _macro(tool: Tool, inputs: dict, ctx: Context, registry, macro_dirs, fallback, depth: int, run: Run) -> dict[str, DataFrame]:
    path = tool.macro or ""
    stem = PureWindowsPath(path).stem if "\\" in path else PurePosixPath(path).stem
    for folder in macro_dirs:
        for candidate in (Path(folder) / path, Path(folder) / f"{stem}.yxmc"):
            if candidate.is_file():
                if depth >= MACRO_DEPTH:
                    raise ToolError(f"macro {path}: more than {MACRO_DEPTH} macros inside one another")
                inner = parse_file(candidate)
                names = [t.config.get("Name") or "Input" for t in inner.tools if t.kind == "macro_input"]
                given = list(inputs.items())
                bound = {n: inputs.get(n, given[min(k, len(given) - 1)][1]) for k, n in enumerate(names)} if given else {}
                made = compile_workflow(ctx.spark, inner, context=ctx, registry=registry, macro_dirs=[candidate.parent, *macro_dirs], fallback=fallback, _bound=bound, _depth=depth + 1)
                outs = [t for t in inner.tools if t.kind == "macro_output"]
                found = {t.config.get("Name") or f"Output{t.id}": made.output(t.id) for t in outs}
                return found | ({"Output": next(iter(found.values()))} if found else {})
    if stem in MACROS:
        return MACROS[stem](inputs, tool.config, ctx)
    if fallback and (made := fallback(tool, inputs, ctx)):
        return made
    if not ctx.allow_stubs:
        raise ToolError(f"macro {path} is not known and not found in the macro folders")
    ctx.warn(f"macro {path} is a stub: rows are passed on")
    run.stubs.append(tool.id)
    return {"Output": next(iter(inputs.values()))} if inputs else {"Output": ctx.spark.range(0).select(F.lit(1).alias("_stub"))}


def repair(spark: SparkSession, workflow: Workflow, ctx: Context, registry, macro_dirs) -> Workflow:
    """Selects keep what a later tool turns out to need. Each try finds one column; there are as many as columns dropped."""
    import re
    from dataclasses import replace

    tools = list(workflow.tools)
    for _ in range(50):
        trial = Workflow(tuple(tools), workflow.connections, workflow.name)
        try:
            compile_workflow(spark, trial, context=Context(spark, ctx.variables, ctx.sources, ctx.allow_stubs, False, ctx.options), registry=registry, macro_dirs=macro_dirs)
            return trial
        except (ExpressionError, AnalysisException) as e:
            m = re.search(r"no column \[([^\]]+)\]|with name `([^`]+)`", str(e))
            name = (m[1] or m[2]).lower() if m else None
            if name is None:
                raise
            changed = False
            for k, t in enumerate(tools):
                if t.kind != "select":
                    continue
                fields = listed((t.config.get("SelectFields") or {}).get("SelectField"))
                new = [{**f, "selected": "True"} if (f.get("field") or f.get("name") or "").lower() == name else f for f in fields]
                if not any((f.get("field") or f.get("name") or "").lower() in (name, "*unknown") for f in fields):
                    new = [*new, {"field": m[1] or m[2], "selected": "True"}]
                if new != fields:
                    tools[k] = replace(t, config={**t.config, "SelectFields": {"SelectField": new}})
                    changed = True
            if not changed:
                raise
            ctx.warn(f"column [{m[1] or m[2]}] is kept by the selects before, as a later tool needs it")
    raise ToolError("columns can't be repaired")
