"""Queries against their SQL on rows that the test tables lack."""

import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from framegrid.operators import service as S
from framegrid.plans import partials  # noqa: F401
from framegrid.plans.queries import ORACLES, QUERIES


def agree(spark, folder, name, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([x[0] for x in cur.description], cur.fetchall())


def test_durations_just_below_an_hour(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    prices = [59.99, 60.0, 3599.49, 3599.5, 3599.72, 3600.0, 7199.9]
    orders = spark.createDataFrame([(k, 1, "F", p, day, "1-URGENT") for k, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    agree(spark, tmp_path, "str_durations", {"orders": orders})
    assert [r[0] for r in spark.createDataFrame([(3599.72,), (3600.0,)], "s double").select(S.clock(F.col("s"))).collect()] == ["59:59", "1:00:00"]


def test_trimap_narrowed_at_corners_of_opaque_backdrop(spark, tmp_path):
    rng = np.random.default_rng(0)  # nearly opaque frames: the backdrop differs by the element's corners only
    data = [(k, [float(v) for v in (np.where(rng.random(64) < 0.08, 150, rng.integers(240, 256, 64)) / 255 - 0.5) / 2 + 1e-4], 1 + k % 2) for k in range(24)]
    agree(spark, tmp_path, "matte_trimap_ramp", {"embeddings": spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")})
