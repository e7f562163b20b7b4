"""Workflow tools as functions: (inputs by anchor, configuration, context) to outputs by anchor, all lazy."""

from weftline.operators import macros, reshape, rows, text
from weftline.operators.context import Context, ToolError

#: Tool type to function.
TOOLS = {
    "select": rows.select,
    "filter": rows.filter_rows,
    "formula": rows.formula,
    "multi_field_formula": rows.multi_field_formula,
    "multi_row_formula": rows.multi_row_formula,
    "multirow_formula": rows.multi_row_formula,
    "join": rows.join,
    "join_multiple": rows.join_multiple,
    "append_fields": rows.append_fields,
    "union": rows.union,
    "summarize": rows.summarize,
    "unique": rows.unique,
    "sort": rows.sort,
    "sample": rows.sample,
    "record_id": rows.record_id,
    "tile": rows.tile,
    "cross_tab": reshape.cross_tab,
    "transpose": reshape.transpose,
    "generate_rows": reshape.generate_rows,
    "dynamic_rename": reshape.dynamic_rename,
    "dynamic_select": reshape.dynamic_select,
    "field_info": reshape.field_info,
    "find_replace": text.find_replace,
    "reg_ex": text.regex,
    "text_to_columns": text.text_to_columns,
}
MACROS = macros.MACROS

__all__ = ["MACROS", "TOOLS", "Context", "ToolError"]
