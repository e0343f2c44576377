import random
from collections import Counter

from pyspark.sql import functions as F

from quern.operators import pairs
from quern.plans import catalogue


def test_pairs_over_several_blocks_match_a_plain_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 200)])) for _ in range(500)] + [(5, "alone", 1), (6, "two", 1), (6, "two", 1)]
    plain = Counter((a[2], b[2]) for a in rows for b in rows if None not in a + b and a[:2] == b[:2] and a[2] < b[2])
    for few in (0, pairs.FEW):
        found = pairs.ordered_pairs(spark.createDataFrame(rows, "g int, h string, `k k` long"), ["g", "h"], "k k", block=8, few=few)
        assert found.columns == ["one", "other"] and Counter(map(tuple, found.collect())) == plain
    assert not pairs.ordered_pairs(spark.createDataFrame([], "g int, k long"), ["g"], "k", few=-1).collect()


def test_pairs_of_one_group_are_made_by_many_tasks(spark, tmp_path):
    spark.range(6000).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalogue.QUERIES["join_self"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 6000 * 5999 // 2
    assert len(found) > 1 and max(r["count"] for r in found) < 0.8 * 6000 * 5999 // 2
