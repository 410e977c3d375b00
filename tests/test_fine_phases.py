"""The fine chain writes what later phases read, not the features and quantiles that nothing reads."""

from shelfsight.plans import states as S

DIR = "/root/testdata/sf0.001"


def test_phases_of_the_fine_chain_are_narrow(spark):
    labelled, stated, features = (f(spark, DIR) for f in (S.fine_labelled, S.stated, S.oos_features))
    assert not {"lag_1", "mean_12", "std_13", "sin_1", "oos_lag_1"} & set(labelled.columns)
    assert not {"z90", "q99", "factor"} & set(stated.columns)
    assert not {"mean_near", "q90", "recent_max_12"} & set(features.columns)
    assert set(S.fine_known(spark, DIR).resid.columns) == {"sku_id", "week", "season_group", "parent", "child", "bucket", "score"}
    assert [r["split"] for r in S.fine_forecast(spark, DIR).select("split").distinct().collect()] == ["VAL"]


def test_the_second_layer_joins_without_a_shuffle_of_all_rows(spark):
    from shelfsight.operators import layers as L

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = L.combined(S.oos_scores(spark, DIR), L.frozen_layer(S.layer_policies(spark, DIR)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan.splitlines()[1:4]
    assert any("BroadcastHashJoin" in line for line in top), top


def test_no_window_holds_a_whole_segment(spark):
    from shelfsight.operators import layers as L

    plan = L.recall_scores(S.layered(spark, DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) windowspecdefinition" not in plan


def test_percent_ranks_count_the_rows_that_are_left_out_as_lower(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shelfsight.operators.ranks import percent_ranks

    whole = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("x"))
    want = whole.select("id", F.percent_rank().over(Window.partitionBy("g").orderBy(F.asc_nulls_first("x"))).alias("r"), "x").where("x is not null").drop("x")
    got = percent_ranks(whole.where("x is not null"), ["g"], {"r": F.col("x")}, 5, whole).select("id", "r")
    assert sorted(got.collect()) == sorted(want.collect())


def test_third_layer_ranks_candidates_above_all_other_rows(spark):
    """As one window over all rows of a week and season says, at quotas and percentiles that bind."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shelfsight.operators import layers as L

    rows = S.layered(spark, DIR)
    for policy in ("F1_C_P1_Q1", "F2_D_P3_Q1", "F3_E_P2_Q3"):
        formula, gate, pct, quota = policy.split("_")
        own = L.recall_scores(rows).select("sku_id", "week", F.col(f"score_{formula}").alias("_s"), F.col(f"gate_{gate}").alias("_gate"))
        w = Window.partitionBy("week", "season_group")
        both = rows.join(own, ["sku_id", "week"], "left").withColumns({"_pct": F.percent_rank().over(w.orderBy(F.asc_nulls_first("_s"))), "_rank": F.row_number().over(w.orderBy(F.desc_nulls_last("_s"), "sku_id"))})
        (ph, pr), (qh, qr) = L.RecallGrid().percentiles[pct], L.RecallGrid().quotas[quota]
        want = both.where((F.col("_gate") == 1) & (F.col("_pct") >= L.by_season(ph, pr)) & (F.col("_rank") <= L.by_season(qh, qr))).select("sku_id", "week")
        frozen = spark.createDataFrame([(policy,)], "policy string")
        got = L.third_layer(rows, frozen, scores=False).where("third = 1").select("sku_id", "week")
        assert sorted(got.collect()) == sorted(want.collect()), policy
