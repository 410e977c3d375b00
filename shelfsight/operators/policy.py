"""Alert policies: stacked scores, ranks within weeks, precision and lift, selection and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOP_K
from ..functions.columns import fixed, positive, ratio
from .conformal import with_tune
from .ranks import quantiles

POLICIES = ("A", "B", "C05", "C10", "C15", "D", "E")


def policy_scores(fc: DataFrame) -> DataFrame:
    """Columns ``score_<policy>``; E weighs by amplitude over its season's training mean.

    That mean is rounded, so that ranks don't hang on the order in which it was summed.
    """
    mean = fc.where("split = 'TRAIN'").groupBy("season_group").agg(fixed(F.avg("amplitude"), 6).alias("_mean"))
    rows = fc.join(F.broadcast(mean), "season_group", "left")
    spread = lambda q: positive(F.col(q) - F.col("yhat"))
    rel = F.least(F.greatest(F.coalesce(ratio("amplitude", "_mean"), F.lit(1.0)), F.lit(0.5)), F.lit(2.0))
    out = {"A": F.col("p") * spread("q95"), "B": F.col("p") * F.col("q90"), "C05": F.sqrt("p") * spread("q95"), "C10": F.col("p") * spread("q95"), "C15": F.pow("p", F.lit(1.5)) * spread("q95"), "D": F.col("p") * F.coalesce("lost_12w", F.lit(0.0)), "E": F.col("p") * F.col("q90") * rel}
    return rows.withColumns({f"score_{k}": v for k, v in out.items()}).drop("_mean")


def stacked(fc: DataFrame, where: str = "split = 'VAL'") -> DataFrame:
    """One row a policy, so that one window ranks them all; ``where`` chooses rows once their scores are known."""
    pairs = F.array(*(F.struct(F.lit(k).alias("policy"), F.col(f"score_{k}").alias("score")) for k in POLICIES))
    return policy_scores(fc).where(where).select("sku_id", "week", "season_group", "event_12w", "lost_12w", F.explode(pairs).alias("s")).select("*", "s.policy", "s.score").drop("s")


def ranked(rows: DataFrame, *by: str, score: str = "score") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "sku_id"))


def policy_sweep(fc: DataFrame, k: int = TOP_K) -> DataFrame:
    """Precision and lift of the first k of each week, by policy and season, on the tuning weeks."""
    rows = stacked(with_tune(fc), "split = 'VAL' and tune")
    base = rows.where(F.col("policy") == POLICIES[0]).groupBy("season_group").agg(F.avg("event_12w").alias("base_rate"))
    top = rows.withColumn("rank", ranked(rows, "policy", "week")).where(F.col("rank") <= k)
    out = top.groupBy("policy", "season_group").agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("hits"), F.sum("lost_12w").alias("lost"))
    out = out.join(F.broadcast(base), "season_group")
    return out.select("policy", "season_group", "alerts", "hits", "lost", ratio("hits", "alerts").alias("precision"), ratio(ratio("hits", "alerts"), "base_rate").alias("lift"))


def policy_best(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("policy").agg(fixed(F.avg("lift"), 9).alias("mean_lift"), F.sum("lost").alias("lost")).orderBy(F.desc("mean_lift"), "policy").limit(1)


def alerts(fc: DataFrame, best: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k of each validation week by the chosen policy."""
    rows = stacked(fc).join(F.broadcast(best.select("policy")), "policy")
    return rows.withColumn("rank", ranked(rows, "week")).where(F.col("rank") <= k)


def alert_eval(fc: DataFrame, found: DataFrame) -> DataFrame:
    total = fc.where("split = 'VAL'").agg(F.sum("event_12w").alias("events"), F.count("*").alias("n"), F.sum("lost_12w").alias("all_lost"))
    got = found.agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("hits"), F.sum("lost_12w").alias("lost"))
    precision, base = ratio("hits", "alerts"), ratio("events", "n")
    return got.crossJoin(F.broadcast(total)).select("alerts", "hits", precision.alias("precision"), ratio("hits", "events").alias("recall"), ratio(precision, base).alias("lift"), ratio("lost", "all_lost").alias("lost_share"))


def pooled_alerts(fc: DataFrame, found: DataFrame) -> DataFrame:
    """Alerts of all weeks by season, judged by the event and by weeks ahead without any sales."""
    zero = F.coalesce(F.col("y_12w") == 0, F.lit(False)).cast("int")
    total = fc.where("split = 'VAL'").groupBy("season_group").agg(F.count("*").alias("n"), F.sum("event_12w").alias("events"), F.sum(zero).alias("zeros"), F.sum("lost_12w").alias("all_lost"))
    got = found.join(fc.where("split = 'VAL'").select("sku_id", "week", zero.alias("zero")), ["sku_id", "week"])
    got = got.groupBy("season_group").agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("hits"), F.sum("zero").alias("zero_hits"), F.sum("lost_12w").alias("lost")).join(F.broadcast(total), "season_group")
    out = {"precision": ratio("hits", "alerts"), "precision_zero": ratio("zero_hits", "alerts"), "recall": ratio("hits", "events"), "recall_zero": ratio("zero_hits", "zeros")}
    lift = {"lift": ratio(out["precision"], ratio("events", "n")), "lift_zero": ratio(out["precision_zero"], ratio("zeros", "n")), "lost_share": ratio("lost", "all_lost")}
    return got.select("season_group", "alerts", "hits", "zero_hits", *(v.alias(k) for k, v in (out | lift).items()))


def probability_comparison(fc: DataFrame) -> DataFrame:
    """Brier score, log-loss and correlation of the probability, by season."""
    label, p = F.col("event_12w").cast("double"), F.col("p")
    log_loss = -(label * F.log(F.greatest(p, F.lit(1e-7))) + (1 - label) * F.log(F.greatest(1 - p, F.lit(1e-7))))
    return fc.where("split = 'VAL'").groupBy("season_group").agg(F.count("*").alias("n"), F.avg(F.pow(p - label, F.lit(2.0))).alias("brier"), F.avg(log_loss).alias("log_loss"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"), F.corr(p, label).alias("corr"))


def probability_deciles(fc: DataFrame) -> DataFrame:
    """Mean probability and rate in ten bands of the probability, cut on CALIB."""
    cuts = {f"_{k}": ("p", 10 * k) for k in range(1, 10)}
    cuts = quantiles(fc.where("split = 'CALIB'"), [], cuts).select(F.array(*cuts).alias("cuts"))
    rows = fc.where("split = 'VAL'").crossJoin(F.broadcast(cuts)).withColumn("band", F.lit(1) + F.size(F.filter("cuts", lambda c: F.col("p") > c)))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("event_12w").alias("rate"))
