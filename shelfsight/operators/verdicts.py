"""Deployment: all gates, what is compared, probabilities and forecast for use, examples, the final verdict, exports with a sentinel row.

A verdict is a table of one row; what depends on it joins that row, so no export asks the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZON, SPLITS, TOP_K
from ..functions.columns import fixed, positive, ratio, share
from .allocation import service_tier
from .ranks import with_quantiles

EXAMPLES = 20


def scope_check(rows: DataFrame) -> DataFrame:
    """One row: whether labels are whole sums of the horizon and validation weeks lie in their year; the first fault names the status."""
    day = lambda s: F.to_date(F.lit(s))
    week = lambda f, s: f(F.when(F.col("split") == s, F.col("week")))
    out = rows.agg(
        *(week(f, s).alias(f"{s.lower()}_{n}") for s in ("TRAIN", "CALIB", "VAL") for n, f in (("first", F.min), ("last", F.max))),
        F.count_if(F.col("n_future") != HORIZON).alias("incomplete"), F.count_if((F.col("split") == "VAL") & ~F.col("week").between(day(SPLITS.val_start), day(SPLITS.val_end))).alias("outside"), F.count_if(F.col("n_future") == 1).alias("point_forecasts"),
    )
    status = F.when(F.col("incomplete") > 0, "FAIL: incomplete labels").when(F.col("outside") > 0, "FAIL: validation weeks outside their year").when(F.col("point_forecasts") > 0, "FAIL: point forecasts").otherwise("OK")
    return out.withColumn("status", status)


def gate_metrics(rows: DataFrame) -> DataFrame:
    """One row of figures of labelled gate weeks: coverage, caps, order, balance, error."""
    y, q90 = F.col("y_12w"), F.col("q90")
    rows = rows.where("y_12w is not null").withColumn("_ratio", fixed(ratio("q90", "yhat"), 9))
    out = rows.agg(
        F.count("*").alias("n"), share(y > q90).alias("viol_90"), share(y > F.col("q95")).alias("viol_95"), share(q90 >= F.col("cap")).alias("cap_rate"),
        F.count_if((q90 < F.col("q80")) | (F.col("q95") < q90)).alias("non_monotone"), ratio(F.sum(positive(q90 - y)), F.sum(positive(y - q90))).alias("over_under"), ratio(F.sum(F.abs(y - F.col("yhat"))), F.sum(F.abs(y))).alias("wmape"),
        (100 * ratio(F.sum(F.col("yhat") - y), F.sum(y))).alias("bias_pct"),
    )
    return with_quantiles(out, rows, [], {"ratio_median": ("_ratio", 50)})


def _one(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def deployment_gates(metrics: DataFrame, first: DataFrame, alerts: DataFrame, labelled: DataFrame, scope: DataFrame, leaks: DataFrame) -> DataFrame:
    """All gates of the gate weeks in one row, and DEPLOY if leakage, scope, coverage, order and lift pass.

    metrics: of the forecast that would be deployed; first: ``y_12w, yhat`` of the first one; alerts: rows that alert, with
    ``event_12w``; labelled: ``event_12w, p, p_cal`` of all gate rows. Gates of the 95 % quantile, caps, ratio and stock only warn. An unknown figure fails its gate.
    """
    label = F.col("event_12w").cast("double")
    base = labelled.agg(F.count("*").alias("_rows"), F.sum("event_12w").alias("_events"), F.avg(F.pow(F.col("p") - label, F.lit(2.0))).alias("brier_raw"), F.avg(F.pow(F.col("p_cal") - label, F.lit(2.0))).alias("brier"))
    got = alerts.agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("_hits"))
    wmape = first.where("y_12w is not null").agg(ratio(F.sum(F.abs(F.col("y_12w") - F.col("yhat"))), F.sum(F.abs("y_12w"))).alias("wmape_first"))
    row = _one(metrics, base, got, wmape, scope.select(F.col("status").alias("_scope")), leaks.agg(F.count_if(F.col("status") == "FAIL").alias("_leaks")))
    precision = ratio("_hits", "alerts")
    row = row.withColumns({"precision": precision, "recall": ratio("_hits", "_events"), "lift": ratio(precision, ratio("_events", "_rows"))})
    gate = lambda ok, other: F.when(ok, "PASS").otherwise(other)
    gates = {
        "b1_leakage": gate(F.col("_leaks") == 0, "FAIL"), "b2_scope": gate(F.col("_scope") == "OK", "FAIL"), "b3_coverage": gate(F.col("viol_90").between(0.08, 0.12), "FAIL"), "b3b_q95": gate(F.col("viol_95").between(0.03, 0.08), "CONDITIONAL"),
        "b3c_order": gate(F.col("non_monotone") == 0, "FAIL"), "b3d_cap": gate(F.col("cap_rate") <= 0.05, "WARN"), "b3e_ratio": gate(F.col("ratio_median") <= 3.0, "WARN"), "b4_lift": gate(F.col("lift") > 1.5, "FAIL"),
        "b5_brier": gate(F.col("brier") <= F.col("brier_raw"), "FAIL"), "b6_wmape": gate(F.col("wmape") <= 1.10 * F.col("wmape_first"), "FAIL"), "b7_stock": gate(F.col("over_under") <= 3.0, "WARN"),
    }
    row = row.withColumns(gates)
    named = ["b1_leakage", "b2_scope", "b3_coverage", "b3c_order", "b4_lift", "b6_wmape"]
    failed = F.array_join(F.filter(F.array(*(F.when(F.col(c) == "FAIL", c) for c in named)), lambda x: x.isNotNull()), ",")
    must = reduce(lambda a, b: a & b, (F.col(c) == "PASS" for c in named[:5]))
    figures = ["n", "viol_90", "viol_95", "cap_rate", "ratio_median", "non_monotone", "over_under", "wmape", "wmape_first", "bias_pct", "alerts", "precision", "recall", "lift", "brier", "brier_raw"]
    return row.select(*figures, *gates, failed.alias("failed"), F.when(must, "DEPLOY").otherwise("HOLD").alias("verdict"))


def ranking_comparison(rows: DataFrame, k: int = TOP_K) -> DataFrame:
    """Lift of the first k of each week by the raw and by the calibrated probability, each times the 90 % quantile, and which is better (RAW if equal).

    rows: ``sku_id, week, q90, p, p_cal, event_12w`` of one part.
    """
    own = rows.where("event_12w is not null")
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("probability"), fixed(F.col(c) * F.col("q90"), 9).alias("score")) for n, c in (("RAW", "p"), ("CALIBRATED", "p_cal")))))
    long = own.select("sku_id", "week", "event_12w", stack.alias("s")).select("sku_id", "week", "event_12w", "s.*")
    top = long.withColumn("rank", F.row_number().over(Window.partitionBy("probability", "week").orderBy(F.desc("score"), "sku_id"))).where(F.col("rank") <= k)
    base = own.agg(ratio(F.sum("event_12w"), F.count("*")).alias("base_rate"))
    out = top.groupBy("probability").agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("hits")).crossJoin(F.broadcast(base))
    out = out.withColumn("precision", ratio("hits", "alerts")).withColumn("lift", ratio("precision", "base_rate"))
    best = out.agg(F.max_by("probability", F.struct(fixed("lift", 9), (F.col("probability") == "RAW").cast("int"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("probability") == F.col("_best")).drop("_best")


def final_forecast(rows: DataFrame, choice: DataFrame, comparison: DataFrame) -> DataFrame:
    """Validation rows with the probability for reports, the one for ranks, and score, tier and buffers by them.

    choice: one row with ``for_reports``; comparison: two rows, the chosen one ranks.
    """
    one = _one(choice.select(F.col("for_reports").alias("_report")), comparison.where("chosen").select(F.col("probability").alias("_rank")))
    both = rows.where("split = 'VAL'").crossJoin(F.broadcast(one))
    pick = lambda c: F.when(F.col(c) == "CALIBRATED", F.col("p_cal")).otherwise(F.col("p"))
    both = both.withColumns({"p_report": pick("_report"), "p_rank": pick("_rank")})
    return both.select(
        "sku_id", "week", "season_group", "yhat", "q80", "q90", "q95", F.col("p").alias("p_raw"), "p_cal", "p_report", "p_rank", F.col("_report").alias("report_choice"), F.col("_rank").alias("rank_choice"),
        fixed(F.col("p_rank") * F.col("q90"), 9).alias("score"), service_tier(fixed("p_report", 9)).alias("tier"), (F.col("q90") - F.col("yhat")).alias("buffer_90"), (F.col("q95") - F.col("yhat")).alias("buffer_95"),
    )


#: Kinds of examples in the order of the report: what puts a row first, and which rows are meant.
KINDS = ("OVER_ON_ZERO", "UNDER", "WIDE", "CAPPED")


def examples(rows: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first rows of each kind: stock where nothing sold, demand above the quantile, wide quantiles, capped ones.

    Each kind is a top-k of its own; kinds come in the order of ``KINDS``, rows by value. Rows without a label count for the last two only.
    """
    own = rows.where("split = 'VAL'").select("sku_id", "week", "season_group", "yhat", "q90", "y_12w", "cap")
    y, q90 = F.col("y_12w"), F.col("q90")
    value = {"OVER_ON_ZERO": F.when((y == 0) & (q90 > 0), q90), "UNDER": F.when(y > q90, y - q90), "WIDE": F.when(F.col("yhat") >= 5, ratio("q90", "yhat")), "CAPPED": F.when(q90 >= F.col("cap"), F.col("cap"))}
    branch = lambda k: own.withColumns({"kind": F.lit(k), "value": fixed(value[k], 6)}).where("value is not null").orderBy(F.desc("value"), "sku_id", "week").limit(most)
    both = reduce(DataFrame.unionByName, map(branch, KINDS))
    order = F.when(F.col("kind") == KINDS[0], 1).when(F.col("kind") == KINDS[1], 2).when(F.col("kind") == KINDS[2], 3).otherwise(4)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "sku_id", "week"))
    return both.withColumns({"kind_no": order, "place": place}).orderBy("kind_no", "place").drop("cap")


def final_verdict(gates: DataFrame, choice: DataFrame, reconciled: DataFrame, shares: DataFrame, hidden: DataFrame, guardrails: DataFrame) -> DataFrame:
    """One row: DEPLOY_FULL if every hard gate passes, DEPLOY_NATIONAL_ONLY without the provinces, else HOLD; with the gates that fail.

    choice: ``brier_raw, brier_cal, for_reports`` on the part that chooses; the probability passes if the
    chosen one is at most a hundredth worse than the raw. shares: ``sku_id, week, share``.
    """
    chosen = F.when(F.col("for_reports") == "CALIBRATED", F.col("brier_cal")).otherwise(F.col("brier_raw"))
    probability = choice.select(F.when(chosen <= F.col("brier_raw") * 1.01, "PASS").otherwise("FAIL").alias("b5_probability"), F.col("for_reports").alias("probability"))
    provinces = reconciled.agg(F.when(F.coalesce(F.sum(F.when(F.col("status") == "FAIL", F.col("n"))), F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("d1_reconciled"))
    sums = shares.groupBy("sku_id", "week").agg(F.sum("share").alias("_s"))
    weights = sums.agg(F.when(F.max(F.abs(F.col("_s") - 1)) <= 1e-9, "PASS").otherwise("FAIL").alias("d2_weights"), F.when(F.count_if(F.col("_s") > 1.000001) == 0, "PASS").otherwise("FAIL").alias("d3_no_duplicate"))
    blind = hidden.select(F.col("status").alias("blind_leakage"), F.when((F.col("labels") == 0) & (F.col("events") == 0), "PASS").otherwise("FAIL").alias("blind_labels"), F.when((F.col("first_week") == 28) & (F.col("last_week") <= 40), "PASS").otherwise("FAIL").alias("blind_range"))
    bad = F.array_sort(F.collect_set(F.when(F.col("status").startswith("FAIL"), F.col("status"))))
    ratios = guardrails.agg(F.when(F.size(bad) > 0, F.get(bad, F.lit(0))).when(F.count_if(F.col("status") == "WARN_RATIO") > 0, "WARN_RATIO").otherwise("PASS").alias("ratio_gate"))
    row = _one(gates.drop("failed", "verdict"), probability, provinces, weights, blind, ratios)
    ok = lambda *c: reduce(lambda a, b: a & b, (F.col(x) == "PASS" for x in c))
    national = ok("b1_leakage", "b3_coverage", "b4_lift", "b5_probability", "blind_leakage")
    full = national & ok("b2_scope", "b3c_order", "d1_reconciled", "d3_no_duplicate", "blind_labels") & ~F.col("ratio_gate").startswith("FAIL")
    named = ["b1_leakage", "b2_scope", "b3_coverage", "b3c_order", "b4_lift", "b5_probability", "d1_reconciled", "d2_weights", "d3_no_duplicate", "blind_leakage", "blind_labels"]
    failed = F.array_join(F.filter(F.array(*(F.when(F.col(c) == "FAIL", c) for c in named), F.when(F.col("ratio_gate").startswith("FAIL"), F.lit("ratio_gate"))), lambda x: x.isNotNull()), ",")
    shown = [*(c for c in gates.columns if c[0] == "b" and c[1].isdigit() and c != "b5_brier"), "b5_probability", "d1_reconciled", "d2_weights", "d3_no_duplicate", "blind_leakage", "blind_labels", "blind_range", "ratio_gate"]
    verdict = F.when(full, "DEPLOY_FULL").when(national, "DEPLOY_NATIONAL_ONLY").otherwise("HOLD")
    return row.select(*shown, "probability", failed.alias("failed"), verdict.alias("verdict"))


def with_sentinel(rows: DataFrame, verdict: DataFrame, allowed: tuple[str, ...], name: str = "HOLD_NOT_GENERATED") -> DataFrame:
    """All rows with status DEPLOYED if the one-row verdict is allowed, else one row of typed nulls whose status names the failed gates.

    Whether there are rows or not is decided in the plan. A verdict without a row exports nothing at all.
    """
    one = verdict.select(F.col("verdict").alias("_v"), F.col("failed").alias("_f")).limit(1)
    yes = F.col("_v").isin(*allowed)
    kept = rows.join(F.broadcast(one), yes, "inner").drop("_v", "_f").withColumn("status", F.lit("DEPLOYED"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    held = one.where(~F.coalesce(yes, F.lit(False))).select(*nulls, F.concat(F.lit(f"{name}: "), F.coalesce("_f", F.lit(""))).alias("status"))
    return kept.unionByName(held)


def blind_national(final: DataFrame, verdict: DataFrame) -> DataFrame:
    """The final forecast of the locked weeks without labels, or the sentinel row."""
    rows = final.where(F.weekofyear("week").between(28, 40)).select("sku_id", "week", "season_group", "yhat", "q80", "q90", "q95", "p_report", "score", "tier", "buffer_90", "buffer_95", F.lit(None).cast("double").alias("y_12w"), F.lit(None).cast("int").alias("event_12w"))
    return with_sentinel(rows, verdict, ("DEPLOY_FULL", "DEPLOY_NATIONAL_ONLY"))


def blind_provincial(parts: DataFrame, verdict: DataFrame) -> DataFrame:
    """Provincial quantiles of the locked weeks, for a full deployment only."""
    rows = parts.where(F.weekofyear("week").between(28, 40)).select("sku_id", "week", "province", "share", "yhat", "q80", "q90", "q95")
    return with_sentinel(rows, verdict, ("DEPLOY_FULL",))


def blind_alerts(final: DataFrame, verdict: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k of each locked week by score, or the sentinel row."""
    rows = final.where(F.weekofyear("week").between(28, 40)).select("sku_id", "week", "season_group", "score", "p_rank", "q90", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("score"), "sku_id")).alias("rank"))
    return with_sentinel(rows.where(F.col("rank") <= k), verdict, ("DEPLOY_FULL", "DEPLOY_NATIONAL_ONLY"))


def gate_part(rows: DataFrame, tuned: DataFrame) -> DataFrame:
    """Validation rows of the weeks that don't tune. tuned: distinct ``week, tune``."""
    late = tuned.where(~F.col("tune")).select("week").distinct()
    return rows.join(F.broadcast(late), "week", "left_semi")


