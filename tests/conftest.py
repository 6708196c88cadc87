import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


def rows(df) -> list:
    """Rows with columns by name, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def sql_rows(con, sql: str) -> tuple[list, list]:
    got = con.sql(sql)
    names = sorted(got.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in got.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
