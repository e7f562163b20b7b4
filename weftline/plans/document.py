"""Workflow documents (XML) to workflows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from weftline.plans.model import Connection, Field, Tool, Workflow
from weftline.sources.io import classify, connection_of

_WORDS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def kind_of_plugin(plugin: str) -> str:
    """The last part of a plugin's name in snake case, without the vendor's name that the first part begins with."""
    parts = plugin.split(".")
    last, vendor = parts[-1], _WORDS.split(parts[0])[0]
    if len(parts) > 1 and last.startswith(vendor) and last[len(vendor) :][:1].isupper():
        last = last[len(vendor) :]
    special = {"RecordID": "record_id", "RegEx": "reg_ex", "BrowseV2": "browse"}
    return special.get(last, _WORDS.sub("_", last).lower())


def as_dict(e: ET.Element) -> dict | str:
    """A leaf is its text; a repeated tag is a list; text beside attributes is ``_text``."""
    if not len(e) and not e.attrib:
        return (e.text or "").strip(" \t\n") if e.text and e.text.strip() else (e.text or "")
    out: dict = dict(e.attrib)
    for child in e:
        value = as_dict(child)
        if child.tag in out:
            if not isinstance(out[child.tag], list):
                out[child.tag] = [out[child.tag]]
            out[child.tag].append(value)
        else:
            out[child.tag] = value
    if e.text and e.text.strip():
        out["_text"] = e.text.strip()
    return out


def _fields(node: ET.Element) -> tuple[Field, ...]:
    infos = node.findall("./Properties/MetaInfo")
    info = next((i for i in infos if i.get("connection") == "Output"), infos[0] if infos else None)
    found = info.findall("./RecordInfo/Field") if info is not None else []
    return tuple(Field(f.get("name", ""), f.get("type", ""), f.get("size"), f.get("source")) for f in found)


def _disabled(node: ET.Element) -> bool:
    for path in ("./Properties/Configuration/Disabled", "./Properties/Disabled", "./EngineSettings/Disabled"):
        e = node.find(path)
        if e is not None and (e.get("value") or e.text or "").strip().lower() == "true":
            return True
    return False


def _tool(node: ET.Element) -> Tool:
    gui, engine = node.find("GuiSettings"), node.find("EngineSettings")
    plugin = (gui.get("Plugin") or "") if gui is not None else ""
    macro = engine.get("Macro") if engine is not None else None
    kind = kind_of_plugin(plugin) if plugin else ("macro" if macro else "unknown")
    c = node.find("./Properties/Configuration")
    config = as_dict(c) if c is not None else {}
    config = config if isinstance(config, dict) else {"_text": config}
    note = node.find("./Properties/Annotation/DefaultAnnotationText")
    name = node.find("./Properties/Annotation/Name")
    place = gui.find("Position") if gui is not None else None
    source = {"text_input": "Inline Data", "odbc_input": "ODBC Database"}.get(kind)
    if kind == "db_file_input":
        source = classify(connection_of(config).split("|||")[0] if "|||" not in connection_of(config) else "aka:")
    return Tool(
        id=int(node.get("ToolID", "0")),
        kind=kind,
        config=config,
        plugin=plugin,
        annotation=((name.text if name is not None else "") or (note.text if note is not None else "") or "").strip(),
        position=(float(place.get("x", 0)), float(place.get("y", 0))) if place is not None else (0, 0),
        fields=_fields(node),
        macro=macro,
        source=source,
    )


def parse_text(text: str, name: str = "") -> Workflow:
    root = ET.fromstring(text)
    tools: list[Tool] = []
    gone: set[int] = set()

    def visit(node: ET.Element, off: bool) -> None:
        off = off or _disabled(node)
        tool = _tool(node)
        if off:
            gone.add(tool.id)
        else:
            tools.append(tool)
        for child in node.findall("./ChildNodes/Node"):
            visit(child, off)

    for node in root.findall("./Nodes/Node"):
        visit(node, False)
    connections = []
    for c in root.findall("./Connections/Connection"):
        a, b = c.find("Origin"), c.find("Destination")
        if a is None or b is None:
            continue
        ends = int(a.get("ToolID", "0")), int(b.get("ToolID", "0"))
        if gone & set(ends):
            continue
        number = re.search(r"#(\d+)", c.get("name", ""))
        connections.append(Connection(*ends, a.get("Connection", "Output"), b.get("Connection", "Input"), c.get("Wireless", "").lower() == "true", int(number[1]) if number else None))
    return Workflow(tuple(tools), tuple(connections), name)


def parse_file(path: str | Path) -> Workflow:
    return parse_text(Path(path).read_text(encoding="utf-8"), Path(path).stem)
