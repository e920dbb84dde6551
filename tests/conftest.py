import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT)]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rounded(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.fixture
def agrees(spark, sf_dir, duck):
    """Runs a query and its SQL and compares the rows."""

    def check(query, sql):
        got = query(spark, sf_dir)
        names = sorted(got.columns)
        a = sorted((tuple(rounded(r[c]) for c in names) for r in got.collect()), key=repr)
        out = duck.execute(sql)
        have = [c[0] for c in out.description]
        assert sorted(have) == names
        b = sorted((tuple(rounded(r[have.index(c)]) for c in names) for r in out.fetchall()), key=repr)
        assert a == b

    return check
