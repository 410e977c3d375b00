"""Seasonal profile of each SKU and week, its state, the off-season gate, and breakdowns by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, fixed, iso_week, iso_year, ratio, share
from .conformal import contract

#: Weeks on either side that count as neighbours.
REACH = 2
STATES = ("UNKNOWN_FALLBACK", "ALWAYS_ON", "OFF_SEASON", "IN_SEASON", "TRANSITION_UP", "TRANSITION_DOWN", "INTERMITTENT_RANDOM", "REST_OFFPEAK")


def season_profile(scores: DataFrame) -> DataFrame:
    """One row a SKU and validation week: what the same ISO week and its neighbours held in earlier years.

    Each decision week is exploded into the ISO weeks it looks at, so the join has equal keys only
    and one aggregation of plain sums gives the same week, both sides and all neighbours. Quantiles of the same week, a
    handful of rows, are taken from its rows in order: a sketch for each SKU and week would outweigh the rows.
    """
    past = scores.where("split in ('TRAIN', 'CALIB')").select("sku_id", iso_year("week").alias("past_year"), iso_week("week").alias("look"), "y", (F.col("y") > 0).cast("int").alias("pos"))
    asked = scores.where("split = 'VAL'").select("sku_id", "week", "season_group", iso_year("week").alias("year"), iso_week("week").alias("iso"))
    asked = asked.withColumn("off", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))).withColumn("look", F.col("iso") + F.col("off"))
    older = past.withColumnRenamed("sku_id", "_sku").withColumnRenamed("look", "_look")
    meets = (F.col("sku_id") == F.col("_sku")) & (F.col("look") == F.col("_look")) & (F.col("past_year") < F.col("year"))
    met = asked.join(older, meets, "left")
    same, before, after, near = F.col("off") == 0, F.col("off") < 0, F.col("off") > 0, F.col("off") != 0
    only = lambda c, v: F.when(c, F.col(v))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    year_bit = F.expr("shiftleft(1L, past_year % 64)")  # years of a span of 64
    out = met.groupBy("sku_id", "week", "season_group").agg(
        F.count(only(same, "y")).alias("n_obs"), F.coalesce(F.bit_count(F.bit_or(F.when(same, year_bit))).cast("long"), F.lit(0).cast("long")).alias("n_years"),
        zero(F.avg(only(same, "y"))).alias("mean_same"), zero(F.avg(only(same, "pos"))).alias("pos_same"),
        zero(F.avg(only(near, "y"))).alias("mean_near"), zero(F.avg(only(near, "pos"))).alias("pos_near"), zero(F.avg(only(before, "pos"))).alias("pos_before"), zero(F.avg(only(after, "pos"))).alias("pos_after"),
    )
    own = Window.partitionBy("sku_id", "week")
    ranked = asked.where("off = 0").join(older, meets).where("y is not null").select("sku_id", "week", "y", F.row_number().over(own.orderBy("y")).alias("_at"), F.count("*").over(own).alias("_n"))
    at = lambda p: F.max(F.when(F.col("_at") == F.expr(f"(_n * {p} + 99) div 100"), F.col("y")))
    out = out.join(ranked.groupBy("sku_id", "week").agg(at(50).alias("median_same"), at(90).alias("p90_same")), ["sku_id", "week"], "left").withColumns({c: zero(F.col(c)) for c in ("median_same", "p90_same")})
    annual = past.groupBy("sku_id").agg(F.avg("y").alias("mean_year"), F.avg("pos").alias("pos_year"))
    out = out.join(annual, "sku_id", "left").withColumns({"mean_year": zero(F.col("mean_year")), "pos_year": zero(F.col("pos_year"))})
    return out.withColumns({"index": ratio("mean_same", "mean_year"), "pos_index": ratio("pos_same", "pos_year"), "slope": fixed(F.col("pos_after") - F.col("pos_before"), 9)})


def season_state() -> Column:
    """The first rule that fits names the state."""
    pos, year, index = F.col("pos_same"), F.col("pos_year"), fixed("index", 9)
    middling = pos.between(0.15, 0.50)
    return (
        F.when(F.col("n_obs") < 3, "UNKNOWN_FALLBACK")
        .when((year >= 0.70) & (pos >= 0.50), "ALWAYS_ON")
        .when((pos < 0.15) & (index < 0.25), "OFF_SEASON")
        .when((pos >= 0.40) & (index >= 1.25), "IN_SEASON")
        .when((F.col("slope") > 0.10) & middling, "TRANSITION_UP")
        .when((F.col("slope") < -0.10) & middling, "TRANSITION_DOWN")
        .when((year < 0.35) & (F.abs(fixed("pos_index", 9) - 1) < 0.40), "INTERMITTENT_RANDOM")
        .when((F.col("season_group") == "REST") & (index < 0.60), "REST_OFFPEAK")
        .otherwise("IN_SEASON")
    )


def with_states(profile: DataFrame) -> DataFrame:
    return profile.withColumn("state", season_state())


def gate_off_season(rows: DataFrame) -> DataFrame:
    """``gated``: the forecast, lowered to a cap in dead weeks, but not under a share of the historic mean."""
    cap = (
        F.when((F.col("state") == "OFF_SEASON") & (F.col("p90_same") > 0), F.col("p90_same") * 12)
        .when((F.col("state") == "OFF_SEASON") & (F.col("mean_year") > 0), F.col("mean_year") * 3)
        .when((F.col("state") == "REST_OFFPEAK") & (F.col("p90_same") > 0), F.col("p90_same") * 18)
        .when((F.col("state") == "REST_OFFPEAK") & (F.col("mean_year") > 0), F.col("mean_year") * 6)
    )
    rows = rows.withColumn("gate_cap", cap)
    lowered = F.least(F.col("yhat"), F.greatest(F.col("gate_cap"), F.col("mean_same") * 12 * 0.30))
    gated = F.when(F.col("gate_cap") < F.col("yhat"), lowered).otherwise(F.col("yhat"))
    return rows.withColumns({"gated": gated, "lowered": (F.coalesce(F.col("gate_cap") < F.col("yhat"), F.lit(False))).cast("int")})


def stated(forecasts: DataFrame, states: DataFrame) -> DataFrame:
    """Validation rows of the forecast with profile, state, gated forecast and part of the contract."""
    extra = states.drop("season_group")
    rows = forecasts.where("split = 'VAL'").join(extra, ["sku_id", "week"], "left").withColumn("part", contract(F.col("week")))
    return gate_off_season(rows)


def zero_regime(zero_share: Column) -> Column:
    return F.when(zero_share >= 0.80, "EXTREME_ZERO").when(zero_share >= 0.65, "HIGH_ZERO").when(zero_share >= 0.50, "MODERATE_ZERO").otherwise("LOW_ZERO")


def point_metrics(forecast: str) -> list[Column]:
    f, y = F.col(forecast), F.col("y_12w")
    miss = F.abs(y - f)
    return [
        F.count("*").alias("n"), F.avg(miss).alias("mae"), ratio(F.sum(miss), F.sum(F.abs(y))).alias("wmape"),
        ratio(F.sum(F.when(y > 0, miss)), F.sum(F.when(y > 0, y))).alias("wmape_positive"), (100 * ratio(F.sum(f - y), F.sum(y))).alias("bias_pct"),
        share((y == 0) & (f > 0)).alias("zero_over"), F.avg("event_12w").alias("event_rate"), share(y > F.col("q90")).alias("viol_90"),
    ]


def breakdown(rows: DataFrame, forecast: str = "gated") -> DataFrame:
    """Metrics in total, by season, by state and by both, in one pass."""
    out = rows.groupingSets([["season_group", "state"], ["season_group"], ["state"], []], "season_group", "state").agg(F.grouping_id().alias("_g"), *point_metrics(forecast))
    level = F.when(F.col("_g") == 0, "season_state").when(F.col("_g") == 1, "season").when(F.col("_g") == 2, "state").otherwise("global")
    return out.withColumn("level", level).withColumns({"season_group": F.coalesce("season_group", F.lit("ALL")), "state": F.coalesce("state", F.lit("ALL"))}).drop("_g")


def state_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("sku_id").alias("skus"), F.avg("pos_same").alias("pos_same"), F.avg("index").alias("index"), F.avg("slope").alias("slope"))


def state_calibration(rows: DataFrame, least_state: int = 200, least_season: int = 50) -> DataFrame:
    """By state and season: the factor that brings the 90 % quantile's violations on DEV_TUNE to 10 %.

    The state's own where it has ``least_state`` rows, its season's where that has ``least_season``, else the total's.
    """
    tune = rows.where("part = 'DEV_TUNE'").withColumn("_x", (F.col("y_12w") > F.col("q90")).cast("int"))
    sets = tune.groupingSets([["season_group", "state"], ["season_group"], []], "season_group", "state").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("_x").alias("v"))
    own = sets.where("_g = 0").select("season_group", "state", "n", "v")
    season = sets.where("_g = 1").select("season_group", F.col("n").alias("_ns"), F.col("v").alias("_vs"))
    total = sets.where("_g = 3").select(F.col("v").alias("_vt"))
    out = own.join(F.broadcast(season), "season_group").crossJoin(F.broadcast(total))
    level = F.when(F.col("n") >= least_state, "STATE").when(F.col("_ns") >= least_season, "SEASON").otherwise("GLOBAL_FALLBACK")
    out = out.withColumn("level", level).withColumn("viol", F.when(level == "STATE", F.col("v")).when(level == "SEASON", F.col("_vs")).otherwise(F.col("_vt")))
    return out.select("season_group", "state", "n", "level", "viol", clip(F.col("viol") / 0.10, 0.8, 1.5).alias("factor"))
