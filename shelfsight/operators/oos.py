"""Suspected stock-outs: zero runs and recent sales, weighted scores, grid of policies, top-k curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OOS_THRESHOLDS, OOS_WEIGHTS, SEASON_COMPONENT, SEASON_DEFAULT
from ..functions.columns import clip, fixed, positive, ratio
from .panel import by_sku

RUN = 12
#: scope, rows that may be flagged: over the whole part or in each season
TOP_N = (("global", 50), ("global", 100), ("global", 200), ("season", 20), ("season", 50))
COMPONENTS = ("c_run", "c_gap", "c_past", "c_season", "c_p", "c_drop")


def recent_sales(panel: DataFrame) -> DataFrame:
    """Before each week: run of zero weeks (12 at most, 0 in the first week), weeks since a sale, means and zero shares.

    Weeks before the panel count as zero in shares and means, but in no run.
    """
    w = by_sku()
    before = lambda k: w.rowsBetween(-k, -1)
    at = F.row_number().over(w)
    rows = panel.select("sku_id", "week", "iso_week", "y").withColumn("at", at)
    rows = rows.withColumn("last", F.last(F.when(F.col("y") > 0, F.col("at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    sold = lambda k: F.coalesce(F.sum((F.col("y") > 0).cast("int")).over(before(k)), F.lit(0))
    mean = lambda k: F.coalesce(F.sum("y").over(before(k)), F.lit(0.0)) / float(k)
    return rows.select(
        "sku_id", "week",
        F.least(F.lit(RUN), F.col("at") - 1 - F.coalesce("last", F.lit(0))).alias("zero_run"),
        F.coalesce(F.least(F.lit(RUN), F.col("at") - 1 - F.col("last")), F.lit(RUN)).alias("weeks_since_sale"),
        *((F.lit(1.0) - sold(k) / float(k)).alias(f"zero_share_{k}w") for k in (4, 8, 12)),
        *(mean(k).alias(f"recent_mean_{k}") for k in (4, 8, 12)),
        F.coalesce(F.max("y").over(before(12)), F.lit(0.0)).alias("recent_max_12"), sold(12).alias("positive_weeks_12"),
    )


def run_bucket(run: Column) -> Column:
    return F.when(run == 0, "0").when(run == 1, "1").when(run <= 3, "2-3").when(run <= 7, "4-7").otherwise("8+")


def oos_features(rows: DataFrame, recent: DataFrame) -> DataFrame:
    """Rows with states and gated forecasts get the six components, and the chance that a zero is true demand."""
    weeks = F.broadcast(rows.select("week").distinct())  # a year's, of all weeks of the panel
    rows = rows.join(recent.join(weeks, "week", "left_semi"), ["sku_id", "week"])
    gap = positive(F.col("gated") - F.col("recent_mean_4"))
    season = F.lit(SEASON_DEFAULT)
    for state, value in SEASON_COMPONENT.items():
        season = F.when(F.col("state") == state, value).otherwise(season)
    drop = F.when(F.col("recent_mean_12") > 0, F.when(F.col("recent_mean_4") == 0, 1.0).otherwise(ratio(F.col("recent_mean_12") - F.col("recent_mean_4"), "recent_mean_12"))).otherwise(0.0)
    return rows.withColumns({
        "gap": gap, "run_bucket": run_bucket(F.col("zero_run")), "c_run": F.col("zero_run") / 12.0, "c_gap": clip(ratio(gap, F.greatest(F.col("gated"), F.lit(1.0))), 0.0, 1.0),
        "c_past": F.coalesce("pos_same", F.lit(0.5)), "c_season": season, "c_p": clip(F.col("p"), 0.0, 1.0), "c_drop": clip(drop, 0.0, 1.0),
        "true_zero": (1 - F.coalesce("pos_same", F.lit(0.5)) + F.col("zero_share_12w")) / 2,
    })


def weight_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, w)) for k, w in OOS_WEIGHTS.items()], "policy string, " + ", ".join(f"w{i} double" for i in range(1, 7)))


def suspicion(rows: DataFrame) -> DataFrame:
    """Rows with w1 to w6 get ``suspected``, ``expected_lost`` and ``priority``."""
    raw = sum((F.col(f"w{i}") * F.col(c) for i, c in enumerate(COMPONENTS, 1)), F.lit(0.0))
    rows = rows.withColumn("suspected", fixed(clip(raw * (1 - F.col("true_zero")), 0.0, 1.0), 9))
    boost = F.when(F.col("season_group") == "HIGH_SEASON", 1.2).otherwise(1.0)
    return rows.withColumns({"expected_lost": fixed(F.col("suspected") * F.col("gap"), 9), "priority": fixed(F.col("suspected") * F.log1p("gap") * boost, 9)})


def policy_grid(spark) -> DataFrame:
    rows = [(p, float(t), scope, n) for p in OOS_WEIGHTS for t in OOS_THRESHOLDS for scope, n in TOP_N]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "candidate_id int, policy string, threshold double, scope string, top_n int")


def policy_eval(features: DataFrame, part: str = "DEV_SELECT") -> DataFrame:
    """Precision, recall, F1, lift and loss of every candidate on one part.

    Weights are the only thing that changes an order, so rows are ranked once a weight vector, and
    only ranks that some candidate can use go on to the grid.
    """
    spark = features.sparkSession
    rows = features.where(F.col("part") == part)
    base = rows.agg(F.count("*").alias("all"), F.sum("event_12w").alias("events"))
    scored = suspicion(rows.crossJoin(F.broadcast(weight_table(spark)))).select("policy", "sku_id", "week", "season_group", "event_12w", "suspected", "priority")
    orders = {"global": ["policy"], "season": ["policy", "season_group"]}
    top = None
    for scope, keys in orders.items():
        most = max(n for s, n in TOP_N if s == scope)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), "sku_id", "week"))
        one = scored.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("scope", F.lit(scope))
        top = one if top is None else top.unionByName(one)
    grid = policy_grid(spark)
    hit = top.join(F.broadcast(grid), ["policy", "scope"]).where((F.col("rank") <= F.col("top_n")) & (F.col("suspected") >= F.col("threshold")))
    found = hit.groupBy("candidate_id").agg(F.count("*").alias("flags"), F.sum("event_12w").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = grid.join(found, "candidate_id", "left").crossJoin(F.broadcast(base)).select("candidate_id", "policy", "threshold", "scope", "top_n", zero("flags"), zero("hits"), "events", "all")
    precision, recall, rate = ratio("hits", "flags"), ratio("hits", "events"), ratio("events", "all")
    out = out.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * F.col("hits"), F.col("flags") + F.col("events")), "lift": ratio(precision, rate), "fpr": ratio(F.col("flags") - F.col("hits"), F.col("all") - F.col("events"))})
    violation = F.when(F.coalesce("precision", F.lit(0.0)) < rate, 1).otherwise(0)
    loss = (2 - F.coalesce("lift", F.lit(0.0))) + 0.01 * positive(F.col("flags") - F.col("events").cast("double")) + 10 * violation
    return out.withColumn("loss", fixed(loss, 9)).drop("all", "events")


def frozen_policy(evaluated: DataFrame) -> DataFrame:
    return evaluated.orderBy("loss", "candidate_id").limit(1)


def final_scores(features: DataFrame, frozen: DataFrame) -> DataFrame:
    """All rows scored with the frozen weights; ``flag`` where the suspicion reaches the threshold."""
    chosen = frozen.select("policy", "threshold").join(F.broadcast(weight_table(features.sparkSession)), "policy")
    rows = suspicion(features.crossJoin(F.broadcast(chosen)))
    return rows.withColumn("flag", (F.col("suspected") >= F.col("threshold")).cast("int")).drop("policy", *(f"w{i}" for i in range(1, 7)))


def flag_metrics(scored: DataFrame, part: str = "LOCKED_TEST") -> DataFrame:
    """Metrics of the flag in total, by season and by state, in one pass."""
    rows = scored.where(F.col("part") == part)
    hit = F.col("flag") * F.col("event_12w")
    out = rows.groupingSets([["season_group"], ["state"], []], "season_group", "state").agg(
        F.count("*").alias("n"), F.sum("flag").alias("flags"), F.sum(hit).alias("hits"), F.sum("event_12w").alias("events"),
        ratio(F.sum(F.when(F.col("flag") == 1, F.col("expected_lost"))), F.sum("expected_lost")).alias("lost_share"),
    )
    out = out.withColumns({"precision": ratio("hits", "flags"), "recall": ratio("hits", "events"), "f1": ratio(2 * F.col("hits"), F.col("flags") + F.col("events")), "fpr": ratio(F.col("flags") - F.col("hits"), F.col("n") - F.col("events"))})
    return out.withColumns({"season_group": F.coalesce("season_group", F.lit("ALL")), "state": F.coalesce("state", F.lit("ALL"))})


def top_k_curve(scored: DataFrame, ks: tuple[int, ...] = (50, 100, 200, 500, 1000), part: str = "LOCKED_TEST") -> DataFrame:
    """Precision and recall among the first k of the part by priority; only the first max(k) rows are ranked."""
    rows = scored.where(F.col("part") == part)
    total = rows.agg(F.sum("event_12w").alias("events"), F.count("*").alias("all"))
    order = [F.desc("priority"), F.col("sku_id"), F.col("week")]
    top = rows.orderBy(*order).limit(max(ks)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    got = top.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k")).groupBy("k").agg(F.count("*").alias("flags"), F.sum("event_12w").alias("hits"))
    return got.crossJoin(F.broadcast(total)).select("k", "flags", "hits", ratio("hits", "flags").alias("precision"), ratio("hits", "events").alias("recall"), ratio(ratio("hits", "flags"), ratio("events", "all")).alias("lift"))


def weekly_top_k(scored: DataFrame, ks: tuple[int, ...] = (10, 20, 50), part: str = "LOCKED_TEST") -> DataFrame:
    rows = scored.where(F.col("part") == part)
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("priority"), "sku_id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    weekly = top.groupBy("k", "week").agg(F.count("*").alias("flags"), F.sum("event_12w").alias("hits"))
    return weekly.groupBy("k").agg(F.count("*").alias("weeks"), F.sum("flags").alias("flags"), F.sum("hits").alias("hits"), F.avg(ratio("hits", "flags")).alias("mean_precision"), F.stddev_samp(ratio("hits", "flags")).alias("std_precision"))
