import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import duckdb  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    return SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, records):
    """Rows with columns by name, doubles to six places, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: f"{float(x):.5f}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in records)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, text):
        df = query(spark, SF)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(text)
        assert got == rows([x[0] for x in cur.description], cur.fetchall())

    return check
