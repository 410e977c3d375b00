"""Several replenishments simulated side by side are what each gives alone, with one shuffle."""

from pyspark.sql import functions as F

from shelfsight.operators.replenish import KEYS, dynamic
from shelfsight.operators.studies import inventory


def test_strategies_share_one_shuffle(spark):
    rows = spark.range(120).select(
        (F.col("id") % 3).cast("string").alias("sku_id"), (F.col("id") % 2).cast("string").alias("province"), F.expr("date_add(date'2000-01-03', cast(id div 6 as int) * 7)").alias("week"), F.lit("A").alias("abc"), F.lit("LUMPY").alias("demand"),
        F.lit(1).alias("tier"), ((F.col("id") * 7) % 5).cast("double").alias("real"), ((F.col("id") * 3) % 4).alias("s0"), ((F.col("id") * 11) % 6).alias("s1"), (F.col("id") % 3).alias("s2"),
    )
    found = dynamic(rows, ("s0", "s1", "s2"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for s in ("s0", "s1", "s2"):
        alone = inventory(rows.select(*KEYS, "week", F.col("real").alias("demand"), F.col(s).cast("double").alias("replenishment")), KEYS, "week")
        names = [*KEYS, "week", "demand", "replenishment", "ending", "served", "short"]
        assert sorted(map(tuple, found.where(F.col("strategy") == s).select(*names).collect())) == sorted(map(tuple, alone.select(*names).collect()))
