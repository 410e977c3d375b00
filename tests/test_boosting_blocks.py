"""Rows of the quantile boosting travel in blocks, and a node is a comparison of a column."""

import numpy as np
from pyspark.sql import functions as F

from shelfsight.operators import boosting as B


def test_rows_are_written_in_blocks(spark, monkeypatch):
    """A row for each batch of a partition, not for each row of the table."""
    seen, own = [], B.written
    monkeypatch.setattr(B, "written", lambda df, name: seen.append(own(df, name)) or seen[-1])
    rows = spark.range(0, 3000, 1, 2).select(F.col("id").cast("string").alias("sku_id"), F.lit("2000-01-03").alias("week"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 31).cast("double").alias("y"))
    model = B.fit(rows, ["a"], [], ["y"], [("q", 0, 0.5)], B.Boosting(rounds=2, keep=1))
    assert len(model.rounds) == 2 and len(seen) == 2
    for table in seen:
        assert table.count() <= 4 and sum(len(r["id"]) for r in table.select("id").collect()) == 8 * 3000


def test_place_follows_the_tree():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 64, (5, 400)).astype(np.uint8)
    tree = B.Tree(rng.integers(0, 5, 15).astype(np.int32), np.where(rng.random(15) < 0.2, 255, rng.integers(0, 64, 15)).astype(np.int32), rng.random(16))
    want = []
    for r in range(400):
        at = 0
        for _ in range(4):
            at = 2 * at + 1 + int(x[tree.feature[at], r] > tree.bin[at])
        want.append(at - 15)
    assert tree.place(x, 4).tolist() == want and np.array_equal(tree.value(x), tree.leaf[want])
