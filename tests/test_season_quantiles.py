"""Quantiles of a SKU's same week in earlier years: right, and without a sketch for each SKU and week."""

import datetime

from pyspark.sql import functions as F

from shelfsight.operators.season import season_profile


def test_quantiles_of_the_same_week_need_no_sketch(spark):
    weeks = [datetime.date(1995, 1, 2) + datetime.timedelta(7 * k) for k in range(313)]
    rows = [(s, w, float((k * 37 + int(s) * 11) % 29), "VAL" if w.year >= 2000 else "TRAIN") for s in ("1", "2") for k, w in enumerate(weeks)]
    scores = spark.createDataFrame(rows, "sku_id string, week date, y double, split string").withColumn("season_group", F.lit("REST"))
    found = season_profile(scores)
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    past = {}
    for s, w, y, split in rows:
        if split == "TRAIN":
            past.setdefault((s, w.isocalendar()[1]), []).append((y, w.isocalendar()[0]))
    for r in found.collect():
        own = sorted(past.get((r["sku_id"], r["week"].isocalendar()[1]), []))
        assert (r["n_obs"], r["n_years"]) == (len(own), len({year for _, year in own}))
        assert (r["median_same"], r["p90_same"]) == (tuple(own[-(-len(own) * p // 100) - 1][0] for p in (50, 90)) if own else (0.0, 0.0))
