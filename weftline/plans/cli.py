"""Command line: run workflow documents."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description="Run workflow documents on Spark.")
    p.add_argument("path", nargs="?", help="a document, or a folder of documents")
    p.add_argument("--output-dir", help="where sinks are written as Parquet, and reports as Markdown")
    p.add_argument("--dry-run", action="store_true", help="only tell what the workflow holds")
    p.add_argument("--no-docs", action="store_true", help="write no report")
    p.add_argument("--allow-stubs", action="store_true", help="pass rows on where a tool is not known")
    p.add_argument("--repair-columns", action="store_true")
    p.add_argument("--macro-dir", action="append", default=[])
    p.add_argument("--source", action="append", default=[], metavar="NAME=PATH", help="a Parquet table to read under that name")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an engine variable")
    p.add_argument("--hooks", metavar="MODULE", help="a module with any of fallback(tool, inputs, ctx), rewrite(expression, schema), narrate(run)")
    p.add_argument("--registry")
    p.add_argument("--no-registry", action="store_true")
    p.add_argument("--show-registry", action="store_true")
    p.add_argument("--clear-registry", action="store_true")
    a = p.parse_args(argv)

    from weftline.plans.registry import Registry

    registry = None if a.no_registry else Registry(a.registry)
    if a.show_registry:
        for e in Registry(a.registry).all():
            print(f"{e.plugin}\t{e.config_hash}\t{e.uses} uses\t{e.created}")
        return 0
    if a.clear_registry:
        print(f"{Registry(a.registry).clear()} entries removed")
        return 0
    if not a.path:
        p.error("a document or folder is needed")
    path = Path(a.path)
    if not path.exists():
        print(f"{path} does not exist", file=sys.stderr)
        return 2
    documents = sorted(path.glob("*.yxmd")) if path.is_dir() else [path]

    from weftline.plans.document import parse_file
    from weftline.plans.report import markdown, overview

    if a.dry_run:
        for d in documents:
            print(overview(parse_file(d)))
        return 0

    from pyspark.sql import SparkSession

    from weftline.operators import Context
    from weftline.plans.planner import compile_workflow

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    for item in a.source:
        name, _, where = item.partition("=")
        spark.read.parquet(where).createOrReplaceTempView(name)
    hooks = importlib.import_module(a.hooks) if a.hooks else None
    variables = dict(x.partition("=")[::2] for x in a.set)
    failed = 0
    for d in documents:
        try:
            ctx = Context(spark, variables, allow_stubs=a.allow_stubs, write_outputs=a.output_dir is None, rewrite=getattr(hooks, "rewrite", None))
            run = compile_workflow(spark, parse_file(d), context=ctx, registry=registry, macro_dirs=[d.parent, *a.macro_dir], repair_columns=a.repair_columns, fallback=getattr(hooks, "fallback", None))
            out = Path(a.output_dir) / d.stem if a.output_dir else None
            for i, df in run.sinks().items():
                if out:
                    df.write.mode("overwrite").parquet(str(out / f"tool_{i}"))
            if not a.no_docs:
                target = (out or d.parent / d.stem).with_name(f"{d.stem}_docs.md")
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(markdown(run, getattr(hooks, "narrate", "")), encoding="utf-8")
            print(f"{d.name}: {len(run.graph.tools)} tools, {len(run.warnings)} warnings, {len(run.stubs)} stubs")
        except Exception as e:  # one document must not keep the others from running
            failed += 1
            print(f"{d.name}: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
