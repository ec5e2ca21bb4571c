"""The planner's loads are those of the spans, not of much coarser cells."""

from pyspark.sql import functions as F

from tempora.operators import intervals
from tempora.plans import catalog
from tempora.sources.tables import event_spans
from tests.oracle import DATA


def test_loads_are_near_the_covered_time(spark):
    spans = intervals.normalize(event_spans(spark, DATA))
    islands = intervals.union(spans, ["user_id"], bucket=86_400_000_000).agg(F.sum(F.col("e") - F.col("s")).alias("covered")).first()
    axis = spans.agg((F.max("e") - F.min("s")).alias("length"), F.countDistinct("user_id").alias("users")).first()
    plans = catalog.plan_chunks(spark, DATA).collect()
    assert all(r.error is None for r in plans) and len({r.user_id for r in plans}) == axis.users
    length = max(r.e for r in plans)
    assert sum(r.e - r.s for r in plans) == length * axis.users
    assert all(length / 31 <= r.e - r.s <= 4.05 * length / 28 for r in plans)
    planned = sum(r.speech for r in plans) / (length * axis.users)
    covered = islands.covered / (axis.length * axis.users)
    assert covered <= planned < 1.3 * covered
