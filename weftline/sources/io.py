"""Connection strings, readers and writers, inline data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.operators.context import Context, ToolError, listed, value_of

# Endings of file names, what they are, and Spark's reader for them (None: there is none).
FILES = {
    ".csv": ("CSV/Text File", "csv"), ".tsv": ("CSV/Text File", "csv"), ".txt": ("CSV/Text File", "csv"),
    ".xlsx": ("Excel File", None), ".xlsm": ("Excel File", None), ".xls": ("Excel File", None), ".yxdb": ("Workflow Database", None),
    ".parquet": ("Parquet File", "parquet"), ".avro": ("Avro File", "avro"), ".json": ("JSON File", "json"), ".orc": ("ORC File", "orc"), ".xml": ("XML File", "xml"),
}
# Schemes of connection strings.
SCHEMES = {"aka:": "SQL Database", "s3://": "Amazon S3", "s3n://": "Amazon S3", "s3a://": "Amazon S3", "hdfs://": "HDFS", "sftp://": "FTP/SFTP", "ftp://": "FTP/SFTP", "http://": "HTTP", "https://": "HTTP"}
# File format numbers of output tools.
FORMATS = {"0": "csv", "19": "parquet", "23": "table", "25": "excel"}


class UnresolvedSource(ToolError):
    pass


def classify(connection: str) -> str:
    """What kind of source a connection string names."""
    s = connection.strip()
    for scheme, label in SCHEMES.items():
        if s.startswith(scheme):
            return label
    end = re.search(r"\.\w+$", s.lower().split("?")[0])
    if end and end[0] in FILES:
        return FILES[end[0]][0]
    return "File" if s else "Unknown"


def connection_of(config: dict) -> str:
    for key in ("Connection", "ConnectionString", "DbConnection", "File"):
        if said := value_of(config.get(key)).strip():
            return said
    return ""


def split_connection(text: str) -> tuple[str, str]:
    """(connection, query or table)."""
    if "|||" in text:
        where, _, query = text.partition("|||")
        return where, query.strip().rstrip(";").strip()
    if m := re.search(r"\bSql=(.+)", text, re.I | re.S):
        return text[: m.start()], m[1].strip().rstrip(";").strip()
    if m := re.search(r"\bselect\b.+", text, re.I | re.S):
        return text[: m.start()], m[0].strip().rstrip(";").strip()
    return text, ""


def qualify(query: str, database: str, sources: dict) -> str:
    """Names after FROM and JOIN that ``sources`` has under ``database.name`` become that view's name."""

    def put(m: re.Match) -> str:
        name = m[2].strip("[]`\"")
        view = sources.get(f"{database}.{name}") if database else None
        return f"{m[1]}{view}" if isinstance(view, str) else m[0]

    return re.sub(r"(\b(?:from|join)\s+)([\[\]`\"\w.]+)", put, query, flags=re.I)


def read_file(ctx: Context, path: str, config: dict) -> DataFrame:
    end = re.search(r"\.\w+$", path.lower().split("?")[0])
    kind = FILES.get(end[0], ("", None))[1] if end else None
    if kind is None:
        raise UnresolvedSource(f"there is no reader for {path}")
    reader = ctx.spark.read
    if kind == "csv":
        options = config.get("FormatSpecificOptions") if isinstance(config.get("FormatSpecificOptions"), dict) else {}
        delimiter = value_of(options.get("Delimeter"), "\t" if path.lower().endswith(".tsv") else ",")
        header = value_of(options.get("HeaderRow"), "True").lower() != "false"
        return reader.option("header", header).option("sep", delimiter.encode().decode("unicode_escape")).csv(path)
    if kind == "xml":
        reader = reader.option("rowTag", value_of(config.get("RowTag"), "row"))
    return reader.format(kind).load(path)


def read_jdbc(ctx: Context, url: str, query: str, config: dict) -> DataFrame:
    """A query or table over JDBC, by a driver on Spark's class path. What Spark can push down runs in the database.

    ``ctx.options["jdbc"]`` has further options (user, password, fetchsize and so on), by url or for all. Settings
    PartitionColumn, LowerBound, UpperBound and NumPartitions deal a read over tasks.
    """
    told = ctx.options.get("jdbc", {})
    reader = ctx.spark.read.format("jdbc").option("url", url).options(**told.get(url, {k: v for k, v in told.items() if not isinstance(v, dict)}))
    parts = {k: value_of(config.get(k)) for k in ("PartitionColumn", "LowerBound", "UpperBound", "NumPartitions")}
    if re.match(r"\s*(select|with)\b", query, re.I):
        if all(parts.values()):
            return reader.options(dbtable=f"({query}) t", **{k[0].lower() + k[1:]: v for k, v in parts.items()}).load()
        return reader.option("query", query).load()
    return reader.options(dbtable=query, **({k[0].lower() + k[1:]: v for k, v in parts.items()} if all(parts.values()) else {})).load()


def db_input(config: dict, ctx: Context, declared: list[str] | None = None) -> DataFrame:
    """A query or table over the session's catalog and ``ctx.sources``, or a file."""
    text = connection_of(config)
    where, query = split_connection(text)
    database = m[1] if (m := re.search(r"\bDATABASE=([^;]+)", where, re.I)) else where.strip()
    key = where.strip()
    try:
        for name in (query, f"{database}.{query}", key):
            found = ctx.sources.get(name) if name else None
            if isinstance(found, DataFrame):
                return _ordered(found, config, ctx)
        if query and "jdbc:" in where:
            out = read_jdbc(ctx, where[where.index("jdbc:") :].strip(), query, config)
        elif query:
            if re.match(r"\s*(select|with)\b", query, re.I):
                out = ctx.spark.sql(qualify(query, database, ctx.sources))
            else:
                out = ctx.spark.table(ctx.sources.get(query, query))
        elif "jdbc:" in where:
            raise UnresolvedSource("a JDBC connection needs a query or a table")
        elif text:
            out = read_file(ctx, ctx.sources.get(text, text), config)
        else:
            raise UnresolvedSource("no connection is configured")
    except UnresolvedSource:
        if not ctx.allow_stubs:
            raise
        ctx.warn(f"input {text!r} can't be read; an empty table stands in")
        return ctx.spark.createDataFrame([], T.StructType([T.StructField("_stub", T.IntegerType())]))
    if declared and re.fullmatch(r"\s*select\s+\*\s+from\s+\S+\s*", query or "", re.I) and set(declared) <= set(out.columns):
        out = out.select(*declared)
    return _ordered(out, config, ctx)


def _ordered(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    keys = [k.strip() for k in value_of(config.get("OrderBy")).split(",") if k.strip()]
    return ctx.ordered(df, [(k, True) for k in keys]) if keys else df


def text_input(config: dict, ctx: Context) -> DataFrame:
    """Inline rows of texts; empty cells are null, short rows are filled with nulls, long ones cut."""
    fields = config.get("Fields")
    names = [f["name"] if isinstance(f, dict) else f for f in listed(fields.get("Field") if isinstance(fields, dict) else fields)]
    if not names:
        raise ToolError("text input: no fields")
    data = config.get("Data") if isinstance(config.get("Data"), dict) else {}
    rows = []
    for k, r in enumerate(listed(data.get("r", data.get("R")))):
        cells = listed(r.get("c", r.get("C"))) if isinstance(r, dict) else [r]
        cells = [c.get("v", c.get("_text")) if isinstance(c, dict) else c for c in cells]
        cells = [None if c in (None, "") else str(c) for c in cells][: len(names)]
        rows.append((*cells, *[None] * (len(names) - len(cells)), k))
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__line", T.IntegerType())])
    df = ctx.spark.createDataFrame(rows, schema)
    out = df.drop("__line")
    # rows are in the order given as long as they are few; their own columns then stand for it
    return out


def db_output(df: DataFrame, config: dict, ctx: Context) -> DataFrame:
    """Write a table or file, if the context says so; the rows are passed on."""
    file = config.get("File")
    text = connection_of(config)
    kind = FORMATS.get(file.get("FileFormat", "") if isinstance(file, dict) else "", "")
    options = config.get("FormatSpecificOptions") if isinstance(config.get("FormatSpecificOptions"), dict) else {}
    said = value_of(options.get("OutputOption"), "Overwrite").lower()
    mode = "append" if "append" in said else "errorifexists" if "create" in said and "drop" not in said else "overwrite"
    if not ctx.write_outputs:
        return df
    where, table = split_connection(text)
    if "|||" in text and kind in ("table", ""):
        df.write.mode(mode).saveAsTable(table)
        return df
    end = re.search(r"\.\w+$", text.lower())
    reader = FILES.get(end[0], ("", None))[1] if end else kind
    if reader not in ("csv", "parquet", "json", "orc", "xml"):
        raise ToolError(f"there is no writer for {text!r}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if reader == "csv" else writer).format(reader).save(ctx.sources.get(text, text))
    return df
