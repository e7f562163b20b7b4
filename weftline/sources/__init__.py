"""Inputs and outputs of workflows."""

from weftline.sources.io import classify, db_input, db_output, text_input

__all__ = ["classify", "db_input", "db_output", "text_input"]
