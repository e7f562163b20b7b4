"""The expression language of workflow tools: lexer, parser and compiler to Spark columns."""

from weftline.functions.compiler import Scope, UnsupportedFunction, compile_expression, register_function
from weftline.functions.parser import ExpressionError, parse

__all__ = ["ExpressionError", "Scope", "UnsupportedFunction", "compile_expression", "parse", "register_function"]
