import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    yield session
    session.stop()


def compare(df, sql: str, folder: Path = DATA) -> None:
    """The rows of ``df`` are those that DuckDB finds."""
    import duckdb

    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    want = c.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if type(v).__name__ == "Decimal":
            v = float(v)
        return round(float(v), 6) if isinstance(v, (int, float)) else v

    order = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    got = order(df.select(*(f"`{n}`" for n in names)).collect())
    assert got == order(c.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from want").fetchall())
