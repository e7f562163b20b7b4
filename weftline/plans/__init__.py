"""Workflow documents and graphs, and how they become DataFrames."""

from weftline.plans.builder import Flow
from weftline.plans.document import parse_file, parse_text
from weftline.plans.model import Connection, Tool, Workflow
from weftline.plans.planner import Run, compile_workflow
from weftline.plans.registry import Registry, register_tool

__all__ = ["Connection", "Flow", "Registry", "Run", "Tool", "Workflow", "compile_workflow", "parse_file", "parse_text", "register_tool"]
