import pytest
from pyspark.sql import functions as F

from loamline.llm import common


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sides_are_broadcast_within_both_bounds(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit(1), F.lit(2)).alias("a.b"))
    joined = lambda **k: plan(spark.range(5).join(common.checked_broadcast(rows, **k), "id"))
    assert "broadcast" in joined()
    assert "broadcast" not in joined(limit=99)
    assert "broadcast" not in joined(most=100 * 1000)
    assert "broadcast" in joined(most=100 * 1000 + 100 * (24 + 16))
    assert common.checked_broadcast(rows.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
