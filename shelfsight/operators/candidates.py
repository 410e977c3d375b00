"""Joint choice of point forecast and quantile method: shrinkage tuned, spreads by segment on DEV_TUNE, sixteen pairs judged on DEV_SELECT, one reported on LOCKED_TEST."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, positive, ratio, share
from .ranks import quantiles
from .season import zero_regime

SHRINKS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00)
POINTS = ("A0", "A1", "A2", "A3")
METHODS = ("B1_ABS", "B2_LOG", "B3_HYBRID", "B4_TIGHT")
LEVELS = (50, 80, 90, 95)
#: Least rows of a state and regime, and of a season and regime.
LEAST_STATE, LEAST_SEASON = 50, 200
TIGHT = 0.80
#: Bounds of the violation rates and the weights below and above them (fixed values).
HINGES = {80: (0.10, 0.25, 5.0, 2.0), 90: (0.04, 0.15, 8.0, 3.0), 95: (0.01, 0.08, 10.0, 4.0)}


def quiet() -> Column:
    return (F.col("season_group") == "REST") | F.coalesce(F.col("state") == "OFF_SEASON", F.lit(False))


def _errors(f: str) -> dict[str, Column]:
    y, miss = F.col("y_12w"), F.abs(F.col("y_12w") - F.col(f))
    return {
        "wmape": ratio(F.sum(miss), F.sum(y)), "wmape_positive": ratio(F.sum(F.when(y > 0, miss)), F.sum(F.when(y > 0, y))), "bias": ratio(F.sum(F.col(f)) - F.sum(y), F.sum(y)),
        "zero_over": share((y == 0) & (F.col(f) > 0)),
    }


def shrink_grid(stated: DataFrame) -> DataFrame:
    """Error and loss of each shrinkage of quiet rows on DEV_TUNE, and which is chosen (ties: the smaller)."""
    rows = stated.where("part = 'DEV_TUNE' and y_12w is not null").select("season_group", "state", "gated", "y_12w", F.explode(F.array(*map(F.lit, SHRINKS))).alias("shrink"))
    rows = rows.withColumn("f", F.when(quiet(), F.col("gated") * F.col("shrink")).otherwise(F.col("gated")))
    e = _errors("f")
    out = rows.groupBy("shrink").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in e.items()))
    out = out.withColumn("loss", fixed(2 * F.col("wmape_positive") + F.col("zero_over") + 0.5 * F.abs("bias"), 9))
    best = out.agg(F.min_by("shrink", F.struct("loss", "shrink")).alias("_b"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("shrink") == F.col("_b")).drop("_b")


def with_points(stated: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for each point candidate: the forecast, gated, shrunk in quiet rows, zero where all signs say so."""
    rows = stated.crossJoin(F.broadcast(grid.where("chosen").select("shrink"))).withColumn("regime", zero_regime(F.col("zero_share_26w")))
    dead = (F.col("zero_share_26w") >= 0.80) & (F.col("median_same") == 0) & (F.col("zero_share_13w") >= 0.70)
    points = {"A0": F.col("yhat"), "A1": F.col("gated"), "A2": F.when(quiet(), F.col("gated") * F.col("shrink")).otherwise(F.col("gated")), "A3": F.when(F.coalesce(dead, F.lit(False)), 0.0).otherwise(F.col("gated"))}
    stack = F.explode(F.array(*(F.struct(F.lit(k).alias("point"), v.alias("p50")) for k, v in points.items()))).alias("s")
    return rows.select("sku_id", "week", "part", "season_group", "state", "regime", "y_12w", stack).select("sku_id", "week", "part", "season_group", "state", "regime", "y_12w", "s.*")


def spreads(rows: DataFrame) -> DataFrame:
    """Quantiles of positive residuals and of differences of logarithms on DEV_TUNE, by point and state, season (each with regime) and in all."""
    tune = rows.where("part = 'DEV_TUNE' and y_12w is not null")
    own = tune.withColumns({"_a": fixed(positive(F.col("y_12w") - F.col("p50")), 9), "_l": fixed(F.log(F.col("y_12w") + 1) - F.log(F.col("p50") + 1), 9)})
    sets = quantiles(own, ["point", "state", "season_group", "regime"], {f"{t}{k}": (f"_{t}", k) for t in "al" for k in LEVELS}, [["point", "state", "regime"], ["point", "season_group", "regime"], ["point"]])
    level = F.when(F.col("_set") == 0, "STATE").when(F.col("_set") == 1, "SEASON").otherwise("GLOBAL")
    return sets.select("point", level.alias("level"), F.coalesce("state", "season_group", F.lit("ALL")).alias("segment"), F.coalesce("regime", F.lit("ALL")).alias("regime"), "n", *(f"{t}{k}" for t in "al" for k in LEVELS))


def with_methods(rows: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each quantile method: q80, q90, q95 from the spread of the state, else the season, where rows suffice, else of all."""
    names = [f"{t}{k}" for t in "al" for k in LEVELS]

    def side(level: str, p: str, least: int) -> DataFrame:
        found = known.where((F.col("level") == level) & (F.col("n") >= least))
        return found.select(F.col("point").alias(f"{p}_point"), F.col("segment").alias(f"{p}_segment"), F.col("regime").alias(f"{p}_regime"), *(F.col(c).alias(f"{p}_{c}") for c in names))

    out = rows
    for level, p, least, of in (("STATE", "s", LEAST_STATE, "state"), ("SEASON", "g", LEAST_SEASON, "season_group")):
        out = out.join(F.broadcast(side(level, p, least)), (F.col("point") == F.col(f"{p}_point")) & (F.col(of) == F.col(f"{p}_segment")) & (F.col("regime") == F.col(f"{p}_regime")), "left")
    out = out.join(F.broadcast(side("GLOBAL", "t", 0)), F.col("point") == F.col("t_point"), "left")
    pick = lambda c: F.coalesce(f"s_{c}", f"g_{c}", f"t_{c}")
    p50 = F.col("p50")
    plain = {k: p50 + pick(f"a{k}") for k in LEVELS}
    log = {k: F.greatest(F.lit(0.0), F.exp(F.log(p50 + 1) + pick(f"l{k}")) - 1) for k in LEVELS}
    how = {"B1_ABS": plain, "B2_LOG": log, "B3_HYBRID": {k: F.when(quiet(), plain[k]).otherwise(log[k]) for k in LEVELS}, "B4_TIGHT": {k: p50 + TIGHT * pick(f"a{k}") for k in LEVELS}}
    stack = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), *(fixed(v[k], 9).alias(f"q{k}") for k in (80, 90, 95))) for m, v in how.items()))).alias("m")
    return out.select(*rows.columns, stack).select(*rows.columns, "m.*")


def _coverage() -> list[Column]:
    y = F.col("y_12w")
    broken = (F.col("q80") < F.col("p50")) | (F.col("q90") < F.col("q80")) | (F.col("q95") < F.col("q90"))
    return [F.count("*").alias("n"), *(v.alias(k) for k, v in _errors("p50").items()), *(share(y > F.col(f"q{k}")).alias(f"viol_{k}") for k in (80, 90, 95)), share(broken).alias("disorder")]


def joint_eval(long: DataFrame, part: str = "DEV_SELECT") -> DataFrame:
    """Metrics and loss of the sixteen pairs on one part. The bars of the seasons are the errors of the gated forecast there; a season without rows costs nothing."""
    own = long.where((F.col("part") == part) & F.col("y_12w").isNotNull())
    sets = own.groupingSets([["point", "method", "season_group"], ["point", "method"]], "point", "method", "season_group").agg(F.grouping("season_group").alias("_g"), *_coverage())
    total = sets.where("_g = 1").drop("_g", "season_group")
    season = sets.where("_g = 0").groupBy("point", "method").agg(*(F.max(F.when(F.col("season_group") == s, F.col("wmape_positive"))).alias(n) for s, n in (("REST", "rest"), ("HIGH_SEASON", "high"))))
    bars = season.where("point = 'A1'").agg(F.max("rest").alias("_rest"), F.max("high").alias("_high"))  # the same for every method
    out = total.join(season, ["point", "method"]).crossJoin(F.broadcast(bars))
    hinge = F.lit(0.0)
    for k, (low, high, below, above) in HINGES.items():
        v = fixed(f"viol_{k}", 9)
        hinge = hinge + F.when(v < low, (F.lit(low) - v) * below).when(v > high, (v - high) * above).otherwise(0.0)
    worse = lambda c, slack, w: F.when(F.col(c) > F.col(f"_{c}") * slack, (F.col(c) - F.col(f"_{c}")) * w).otherwise(0.0)
    loss = 2 * F.col("wmape") + 2 * F.col("wmape_positive") + F.col("zero_over") + 0.5 * F.abs("bias") + 0.8 * hinge + worse("rest", 1.05, 2.0) + worse("high", 1.10, 3.0) + 10 * F.col("disorder")
    return out.withColumn("candidate", F.concat_ws("_", "point", "method")).withColumn("loss", fixed(loss, 9)).drop("_rest", "_high")


def joint_frozen(evaluated: DataFrame) -> DataFrame:
    """The pair of least loss, ties by name."""
    best = evaluated.orderBy(F.asc_nulls_last("loss"), "candidate").limit(1).select("candidate", "point", "method", "loss")
    return best.withColumns({"evaluated_on_split": F.lit("DEV_SELECT"), "used_locked_test": F.lit(False)})


def joint_locked(long: DataFrame, frozen: DataFrame) -> DataFrame:
    """Metrics of the frozen pair on LOCKED_TEST, its quantiles in order, in total, by season and by state."""
    own = long.where("part = 'LOCKED_TEST' and y_12w is not null").join(F.broadcast(frozen.select("candidate", "point", "method")), ["point", "method"])
    own = own.withColumn("q80", F.greatest("p50", "q80")).withColumn("q90", F.greatest("q80", "q90")).withColumn("q95", F.greatest("q90", "q95"))
    out = own.groupingSets([["candidate", "season_group"], ["candidate", "state"], ["candidate"]], "candidate", "season_group", "state").agg(F.grouping("season_group").alias("_s"), F.grouping("state").alias("_t"), *_coverage(), F.avg(F.col("q90") - F.col("p50")).alias("spread"))
    level = F.when(F.col("_s") == 0, "BY_SEASON").when(F.col("_t") == 0, "BY_STATE").otherwise("GLOBAL")
    return out.withColumns({"level": level, "segment": F.coalesce("season_group", "state", F.lit("ALL"))}).drop("_s", "_t", "season_group", "state")
