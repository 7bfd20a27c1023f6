"""Claiming, retrying and overriding over all jobs and clips."""

from conftest import SF
from framegrid.operators import service as S
from framegrid.plans import more  # noqa: F401
from framegrid.plans.queries import QUERIES


def test_claim_takes_every_queued_job_in_order(spark, duck):
    got = [r.job_id for r in QUERIES["ops_claim_queue"](spark, SF).collect()]
    want = [r[0] for r in duck.execute("select o_orderkey from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey").fetchall()]
    assert got == want and len(got) > 20


def test_retry_takes_every_clip_with_an_input(spark):
    rows = [(1, 0, "failed", "a"), (1, 1, "done", "b"), (1, 2, "failed", None), (2, 0, "pending", "c")]
    clips = spark.createDataFrame(rows, "job_id long, clip_no int, status string, input string")
    assert sorted(map(tuple, S.retried(clips).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_overrides_and_retry_cover_every_clip(spark, duck):
    n = duck.execute("select count(*) from lineitem").fetchone()[0]
    assert QUERIES["ops_overrides_all"](spark, SF).count() == 4 * n
    assert QUERIES["ops_retry_inputs"](spark, SF).count() == n
