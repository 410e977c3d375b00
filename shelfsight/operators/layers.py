"""Layered alerts: a stable layer, a difficult one under gates, percentiles and quotas, a recall-safe third."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LayerGrid, RecallGrid
from ..functions.columns import fixed, positive, ratio
from ..sources.stages import written
from .ranks import percent_ranks

#: Shares of the percentiles of suspicion, priority, expected loss, probability, forecast.
DIFFICULT_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)
RANKED = ("suspected", "priority", "expected_lost", "p", "gated", "c_gap")
#: Recall-safe scores: weights of the percentiles above.
SCORES = {"F1": (0.30, 0.25, 0.20, 0.15, 0.10, 0.0), "F2": (0.20, 0.15, 0.15, 0.30, 0.0, 0.20), "F3": (0.20, 0.20, 0.35, 0.10, 0.15, 0.0)}
LEAST_SEGMENT = 500


def by_season(high: float, rest: float) -> Column:
    return F.when(F.col("season_group") == "HIGH_SEASON", high).otherwise(rest)


def with_layers(scored: DataFrame) -> DataFrame:
    """``stable``: the flag; ``difficult``: rows that aren't flagged, with a zero run that true demand doesn't explain."""
    difficult = (F.col("c_run") >= 0.15) & (F.col("true_zero") < 0.75) & (F.col("flag") == 0)
    return scored.withColumns({"stable": F.col("flag"), "difficult": difficult.cast("int")})


def passes(gate: tuple[float, float, float, float]) -> Column:
    forecast, lost, suspected, p = gate
    return (F.col("gated") >= forecast) & (F.col("expected_lost") >= lost) & (F.col("suspected") >= suspected) & (F.col("p") >= p)


def percentiles(rows: DataFrame, by: Sequence[str], columns: Sequence[str] = RANKED) -> DataFrame:
    """``pr_<column>``: percent rank within the groups."""
    return percent_ranks(rows, by, {f"pr_{c}": fixed(c, 9) for c in columns})


def weighted(weights: Sequence[float]) -> Column:
    return fixed(sum((w * F.col(f"pr_{c}") for w, c in zip(weights, RANKED, strict=False) if w), F.lit(0.0)), 9)


def difficult_scores(layers: DataFrame, grid: LayerGrid | None = None) -> DataFrame:
    """Gates, percentiles within part and season, composite score and rank within week and season of difficult rows."""
    g = grid or LayerGrid()
    rows = percentiles(layers.where("difficult = 1"), ["part", "season_group"], RANKED[:5]).withColumn("score", weighted(DIFFICULT_WEIGHTS))
    rows = rows.withColumns({f"gate_{k}": passes(v).cast("int") for k, v in g.gates.items()})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("week", "season_group").orderBy(F.desc("score"), "sku_id")))


def layer_grid(spark, grid: LayerGrid | None = None) -> DataFrame:
    g = grid or LayerGrid()
    rows = [(f"GATE_{a}_{p}_{q}", a, *g.percentiles[p], *g.quotas[q]) for a in g.gates for p in g.percentiles for q in g.quotas]
    return spark.createDataFrame(rows, "policy string, gate string, pct_high double, pct_rest double, quota_high int, quota_rest int")


def _alerts(rows: DataFrame, policies: DataFrame, gates: Sequence[str], by: str | None = None) -> DataFrame:
    """Rows x policies (those of equal ``by``, if named) that alert: gate, percentile of the season, quota of the season."""
    gate = F.lit(0)
    for k in gates:
        gate = F.when(F.col("gate") == k, F.col(f"gate_{k}")).otherwise(gate)
    both = rows.join(F.broadcast(policies), by) if by else rows.crossJoin(F.broadcast(policies))
    high = F.col("season_group") == "HIGH_SEASON"
    return both.where((gate == 1) & (F.col("score") >= F.when(high, F.col("pct_high")).otherwise(F.col("pct_rest"))) & (F.col("rank") <= F.when(high, F.col("quota_high")).otherwise(F.col("quota_rest"))))


def layer_eval(layers: DataFrame, part: str = "DEV_SELECT", grid: LayerGrid | None = None) -> DataFrame:
    """Incremental and combined metrics, weekly spread, loss and validity of each policy on one part."""
    g = grid or LayerGrid()
    spark = layers.sparkSession
    own = layers.where(F.col("part") == part)
    total = own.agg(F.count("*").alias("all"), F.sum("event_12w").alias("events"), F.count_distinct("week").alias("weeks"), F.sum("stable").alias("stable_n"), F.sum(F.col("stable") * F.col("event_12w")).alias("stable_hits"))
    hits = _alerts(difficult_scores(own, g).select("sku_id", "week", "season_group", "event_12w", "expected_lost", "score", "rank", *(f"gate_{k}" for k in g.gates)), layer_grid(spark, g), list(g.gates))
    weekly = hits.groupBy("policy", "week").agg(F.count("*").alias("a"), F.sum("event_12w").alias("h"), F.sum("expected_lost").alias("lost"))
    found = weekly.groupBy("policy").agg(F.sum("a").alias("alerts"), F.sum("h").alias("hits"), F.sum("lost").alias("lost"), F.sum(F.col("a") * F.col("a")).alias("_sq"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = layer_grid(spark, g).select("policy").join(found, "policy", "left").crossJoin(F.broadcast(total))
    out = out.withColumns({"alerts": zero("alerts"), "hits": zero("hits"), "lost": F.coalesce("lost", F.lit(0.0)), "_sq": zero("_sq")})
    # weeks without alerts count as zero
    spread = F.sqrt(ratio(F.col("_sq") - ratio(F.col("alerts") * F.col("alerts"), "weeks"), F.col("weeks") - 1))
    base = ratio("events", "all")
    out = out.withColumns({
        "precision": ratio("hits", "alerts"), "recall": ratio("hits", "events"), "lift": ratio(ratio("hits", "alerts"), base), "fpr": ratio(F.col("alerts") - F.col("hits"), F.col("all") - F.col("events")),
        "weekly_std": fixed(spread, 9), "combined_precision": ratio(F.col("hits") + F.col("stable_hits"), F.col("alerts") + F.col("stable_n")), "combined_recall": ratio(F.col("hits") + F.col("stable_hits"), "events"),
    })
    precision, volume = F.coalesce("precision", F.lit(0.0)), ratio("alerts", "all")
    loss = (
        (2 - F.coalesce("lift", F.lit(0.0))) - 1.5 * F.col("lost") / 1000 - F.coalesce("recall", F.lit(0.0)) + 100 * F.coalesce("fpr", F.lit(0.0))
        + F.when(volume > 0.10, 2.0).when(volume > 0.05, 1.0).otherwise(0.0) + F.when(precision < base, 5.0).when(precision < 1.2 * base, 2.0).otherwise(0.0)
        + F.when(F.col("weekly_std") > 5, 1.5).when(F.col("weekly_std") > 3, 0.5).otherwise(0.0)
    )
    valid = (F.col("alerts") > 0) & (precision >= base) & (F.coalesce("lift", F.lit(0.0)) > 1)
    return out.withColumns({"loss": fixed(loss, 9), "valid": valid.cast("int")}).drop("_sq", "all", "events", "weeks", "stable_n", "stable_hits")


def frozen_layer(evaluated: DataFrame, none: str = "NONE_VALID") -> DataFrame:
    """The valid policy of least loss; a row named ``none`` if no policy is valid."""
    best = evaluated.where("valid = 1").orderBy("loss", "policy").limit(1).select("policy", "loss")
    return evaluated.agg(F.max("valid").alias("_any")).join(best, F.lit(True), "left").select(F.coalesce("policy", F.lit(none)).alias("policy"), "loss")


def combined(layers: DataFrame, frozen: DataFrame, grid: LayerGrid | None = None) -> DataFrame:
    """All rows with the source of their alert; a freeze without a policy still gives every row."""
    g = grid or LayerGrid()
    chosen = layer_grid(layers.sparkSession, g).join(F.broadcast(frozen.select("policy")), "policy")
    found = _alerts(difficult_scores(layers, g).select("sku_id", "week", "season_group", "score", "rank", *(f"gate_{k}" for k in g.gates)), chosen, list(g.gates)).select("sku_id", "week", F.lit(1).alias("_second"))
    # quotas bound what is found: a few rows a week and season
    rows = layers.join(F.broadcast(found), ["sku_id", "week"], "left").withColumn("second", F.coalesce("_second", F.lit(0))).drop("_second")
    source = F.when(F.col("stable") == 1, "STABLE").when(F.col("second") == 1, "DIFFICULT").otherwise("NONE")
    return rows.withColumns({"source": source, "alert": (source != "NONE").cast("int")})


def layer_metrics(rows: DataFrame, part: str = "LOCKED_TEST") -> DataFrame:
    """Metrics of each source and of all alerts, in total and by season, in one pass."""
    own = rows.where(F.col("part") == part)
    kinds = F.array(F.struct(F.lit("STABLE").alias("layer"), (F.col("source") == "STABLE").alias("on")), F.struct(F.lit("DIFFICULT").alias("layer"), (F.col("source") == "DIFFICULT").alias("on")), F.struct(F.lit("COMBINED").alias("layer"), (F.col("alert") == 1).alias("on")))
    long = own.select("season_group", "event_12w", "expected_lost", F.explode(kinds).alias("s")).select("*", "s.layer", F.col("s.on").cast("int").alias("on"))
    out = long.groupingSets([["layer", "season_group"], ["layer"]], "layer", "season_group").agg(F.count("*").alias("n"), F.sum("on").alias("alerts"), F.sum(F.col("on") * F.col("event_12w")).alias("hits"), F.sum("event_12w").alias("events"), F.sum(F.col("on") * F.col("expected_lost")).alias("lost"))
    return out.withColumns({"season_group": F.coalesce("season_group", F.lit("ALL")), "precision": ratio("hits", "alerts"), "recall": ratio("hits", "events"), "fpr": ratio(F.col("alerts") - F.col("hits"), F.col("n") - F.col("events")), "lift": ratio(ratio("hits", "alerts"), ratio("events", "n"))})


def uplift_verdict(metrics: DataFrame) -> DataFrame:
    """One row: whether the second layer is promoted."""
    total = metrics.where("season_group = 'ALL'")
    m = total.where("layer = 'DIFFICULT'").select("alerts", "hits", "events", "n", "lost", "precision", "recall")
    base = ratio("events", "n")
    precision, recall = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    verdict = (
        F.when((precision >= 1.5 * base) & (recall >= 0.05) & (F.col("lost") >= 100), "PROMOTE")
        .when((precision >= base) & (recall >= 0.02) & (F.col("lost") >= 50), "EXPERIMENTAL")
        .when((precision < base) | (F.col("hits") < 5) | (F.col("lost") < 20), "REJECT").otherwise("KEEP_STABLE_ONLY")
    )
    return m.withColumns({"base_rate": base, "verdict": verdict})


def candidate_type() -> Column:
    """Ordered reasons for a third look at a row that has no alert yet."""
    run, zero, gap, p = F.col("c_run"), fixed("true_zero", 9), fixed("c_gap", 9), fixed("p", 9)
    return (
        F.when(F.col("alert") == 1, "NOT_CANDIDATE")
        .when((run >= 0.15) & (zero < 0.75), "T1_ZERO_RUN").when((run >= 0.30) & (zero < 0.85) & (p >= 0.05), "T2_LONG_RUN")
        .when((gap >= 0.50) & (zero < 0.85) & (p >= 0.05), "T3_GAP").when((F.col("expected_lost") >= 1) & (F.col("suspected") >= 0.03) & (zero < 0.90), "T4_LOSS")
        .when((p >= 0.10) & (zero < 0.90) & (F.col("gated") >= 1), "T5_PROBABILITY").otherwise("NOT_CANDIDATE")
    )


def recall_scores(rows: DataFrame) -> DataFrame:
    """Candidates with their segment (season and type where that is large), gates and three scores."""
    rows = rows.withColumn("type", candidate_type()).where("type <> 'NOT_CANDIDATE'")
    by = ["part", "season_group", "type"]
    size = F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("_size")))  # at most a row for each part, season and type
    rows = rows.join(size, by, "left").withColumn("segment", F.when(F.col("_size") >= LEAST_SEGMENT, F.concat("season_group", F.lit("::"), "type")).otherwise(F.col("season_group"))).drop("_size")
    rows = percentiles(rows, ["part", "segment"])
    zero = fixed("true_zero", 9) < 0.90
    gates = {"C": passes(LayerGrid().gates["C"]), "D": passes((0.5, 0.10, 0.005, 0.005)) & zero, "E": (F.col("expected_lost") >= 1) & (F.col("gated") >= 1) & zero}
    return rows.withColumns({f"score_{k}": weighted(w) for k, w in SCORES.items()} | {f"gate_{k}": v.cast("int") for k, v in gates.items()})


def recall_grid(spark, grid: RecallGrid | None = None) -> DataFrame:
    g = grid or RecallGrid()
    rows = [(f"{s}_{a}_{p}_{q}", s, a, *g.percentiles[p], *g.quotas[q]) for s in SCORES for a in g.gates for p in g.percentiles for q in g.quotas]
    return spark.createDataFrame(rows, "policy string, formula string, gate string, pct_high double, pct_rest double, quota_high int, quota_rest int")


def recall_eval(rows: DataFrame, part: str = "DEV_SELECT", grid: RecallGrid | None = None) -> DataFrame:
    """Each policy's incremental metrics and validity on one part.

    Percentile and rank within the week depend on the formula only, so three orders serve the grid.
    """
    g = grid or RecallGrid()
    spark = rows.sparkSession
    own = rows.where(F.col("part") == part)
    total = own.agg(F.count("*").alias("all"), F.sum("event_12w").alias("events"), F.sum("alert").alias("prior"), F.sum(F.col("alert") * F.col("event_12w")).alias("prior_hits"))
    long = recall_scores(own).select("sku_id", "week", "season_group", "event_12w", "expected_lost", "gate_C", "gate_D", "gate_E", F.explode(F.array(*(F.struct(F.lit(k).alias("formula"), F.col(f"score_{k}").alias("score")) for k in SCORES))).alias("s")).select("*", "s.formula", F.col("s.score").alias("raw")).drop("s")
    long = percent_ranks(long, ["formula", "week"], {"score": F.col("raw")}).withColumns({"rank": F.row_number().over(Window.partitionBy("formula", "week", "season_group").orderBy(F.desc("raw"), "sku_id"))})
    hits = _alerts(long, recall_grid(spark, g), g.gates, "formula")
    found = hits.groupBy("policy").agg(F.count("*").alias("alerts"), F.sum("event_12w").alias("hits"), F.sum("expected_lost").alias("lost"))
    out = recall_grid(spark, g).select("policy").join(found, "policy", "left").crossJoin(F.broadcast(total))
    out = out.withColumns({"alerts": F.coalesce("alerts", F.lit(0)), "hits": F.coalesce("hits", F.lit(0)), "lost": F.coalesce("lost", F.lit(0.0))})
    base, prior = ratio("events", "all"), ratio("prior_hits", "prior")
    out = out.withColumns({
        "precision": ratio("hits", "alerts"), "recall": ratio("hits", "events"), "lift": ratio(ratio("hits", "alerts"), F.coalesce(prior, base)), "fpr": ratio(F.col("alerts") - F.col("hits"), F.col("all") - F.col("events")),
        "combined_precision": ratio(F.col("hits") + F.col("prior_hits"), F.col("alerts") + F.col("prior")), "floor": F.greatest(1.5 * base, F.lit(0.55)), "volume": ratio("alerts", "all"),
    })
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    valid = (F.col("alerts") > 0) & (z("precision") >= F.col("floor")) & (z("combined_precision") >= F.col("floor")) & (z("lift") >= 1.5) & (z("fpr") <= 0.02)
    penalty = F.when(z("precision") < F.col("floor"), 10.0).when(z("combined_precision") < F.col("floor"), 5.0).otherwise(0.0)
    loss = -4 * z("recall") - 2 * z("lift") - F.col("lost") / 1000 + 2 * z("fpr") + 2 * penalty + F.when(F.col("volume") > 0.03, 2.0).when(F.col("volume") > 0.015, 0.5).otherwise(0.0)
    return out.withColumns({"loss": fixed(loss, 9), "valid": valid.cast("int")}).drop("all", "events", "prior", "prior_hits")


def recall_verdict(frozen: DataFrame, evaluated: DataFrame) -> DataFrame:
    """KEEP if nothing is valid; else by precision, lift, recall and false alarms."""
    rows = frozen.select("policy").join(evaluated.drop("loss"), "policy", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    verdict = (
        F.when((F.col("policy") == "NONE_VALID") | (F.coalesce("alerts", F.lit(0)) == 0), "KEEP")
        .when((z("precision") >= z("floor")) & (z("lift") >= 2) & (z("recall") >= 0.03) & (z("fpr") <= 0.01), "PROMOTE")
        .when((z("precision") >= 0.50) & (z("lift") >= 1.5) & (z("recall") >= 0.001) & (z("fpr") <= 0.02), "EXPERIMENTAL").otherwise("REJECT")
    )
    return rows.select("policy", "alerts", "hits", verdict.alias("verdict"))


def least_loss(evaluated: DataFrame) -> DataFrame:
    """The policy of least loss, valid or not."""
    return evaluated.orderBy("loss", "policy").limit(1).select("policy", "loss")


def third_layer(rows: DataFrame, frozen: DataFrame, grid: RecallGrid | None = None, scores: bool = True) -> DataFrame:
    """All rows with the third layer of one policy and the source of their alert; without a policy nothing is added.

    Percentile and rank are over all rows of a week and season, rows that aren't candidates lowest, so candidates are
    ranked among themselves above the number of the others. scores: whether ``third_score`` is joined to the rows;
    the layer itself is a few rows a week, as quotas bound it.
    """
    g = grid or RecallGrid()
    keys = ["sku_id", "week"]
    policy = recall_grid(rows.sparkSession, g).join(frozen.select("policy"), "policy").drop("policy")
    pick = lambda name, of, kind: F.coalesce(*(F.when(F.col(name) == k, F.col(f"{kind}_{k}")) for k in of))
    scored = recall_scores(rows).join(F.broadcast(policy), F.lit(True), "left")
    scored = scored.select(*keys, "season_group", pick("formula", SCORES, "score").alias("third_score"), pick("gate", g.gates, "gate").alias("_gate"), "pct_high", "pct_rest", "quota_high", "quota_rest")
    scored = written(scored, "third-scores")
    week = Window.partitionBy("week", "season_group")
    ranked = percent_ranks(scored, ["week", "season_group"], {"_pct": F.col("third_score")}, whole=rows).withColumns({"_rank": F.row_number().over(week.orderBy(F.desc_nulls_last("third_score"), "sku_id"))})
    high = F.col("season_group") == "HIGH_SEASON"
    on = (F.col("_gate") == 1) & (F.col("_pct") >= F.when(high, F.col("pct_high")).otherwise(F.col("pct_rest"))) & (F.col("_rank") <= F.when(high, F.col("quota_high")).otherwise(F.col("quota_rest")))
    both = rows.join(scored.select(*keys, "third_score"), keys, "left") if scores else rows
    both = both.join(F.broadcast(ranked.where(on).select(*keys, F.lit(1).alias("_third"))), keys, "left")
    third = F.coalesce("_third", F.lit(0))
    source = F.when(third == 1, "RECALL_SAFE").otherwise(F.col("source"))
    return both.select(*rows.columns, candidate_type().alias("candidate"), *(["third_score"] if scores else []), third.alias("third"), source.alias("source_3"), F.greatest("alert", third).alias("alert_3"))


def third_metrics(rows: DataFrame, part: str = "LOCKED_TEST") -> DataFrame:
    """Stable, prior, incremental and combined alerts of one part: in total, by season and by type of candidate, in one pass."""
    own = rows.where(F.col("part") == part)
    layers = {"STABLE": "stable", "PRIOR": "alert", "INCREMENTAL": "third", "COMBINED": "alert_3"}
    kinds = F.array(*(F.struct(F.lit(k).alias("layer"), F.col(c).alias("on")) for k, c in layers.items()))
    long = own.select("season_group", "candidate", "event_12w", "expected_lost", F.explode(kinds).alias("s")).select("*", "s.layer", "s.on")
    out = long.groupingSets([["layer", "season_group"], ["layer", "candidate"], ["layer"]], "layer", "season_group", "candidate").agg(
        F.count("*").alias("n"), F.sum("on").alias("alerts"), F.sum(F.col("on") * F.col("event_12w")).alias("hits"), F.sum("event_12w").alias("events"), F.sum(F.col("on") * F.col("expected_lost")).alias("lost"),
    )
    scope = F.coalesce(F.concat(F.lit("SEASON "), "season_group"), F.concat(F.lit("TYPE "), "candidate"), F.lit("ALL"))
    return out.select("layer", scope.alias("scope"), "n", "alerts", "hits", "events", "lost", ratio("hits", "alerts").alias("precision"), ratio("hits", "events").alias("recall"), ratio(F.col("alerts") - F.col("hits"), F.col("n") - F.col("events")).alias("fpr"), ratio(ratio("hits", "alerts"), ratio("events", "n")).alias("lift"))


LISTS = (50, 100, 250, 500, 1000)


def alert_lists(rows: DataFrame, part: str = "LOCKED_TEST") -> DataFrame:
    """Alerts of one part in order of priority, with the top lists that each is in."""
    own = rows.where((F.col("part") == part) & (F.col("alert_3") == 1))
    # only rows down to the longest list need a rank
    top = own.orderBy(F.desc("priority"), "sku_id", "week").limit(max(LISTS))
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "sku_id", "week"))
    top = top.withColumn("place", place)
    return top.select("sku_id", "week", "season_group", "source_3", "priority", "place", *((F.col("place") <= k).alias(f"top_{k}") for k in LISTS))


def version_comparison(rows: DataFrame) -> DataFrame:
    """How the three versions' alerts agree, by part: rows, events and expected loss of each combination."""
    return rows.groupBy("part", "stable", "alert", "alert_3").agg(
        F.count("*").alias("n"), F.sum("event_12w").alias("events"), F.sum("expected_lost").alias("lost"), F.bool_or(F.col("event_12w") == 1).alias("any_event"), F.bool_and(F.col("alert_3") >= F.col("alert")).alias("monotone"),
    )


def missed_events(rows: DataFrame, part: str = "LOCKED_TEST") -> DataFrame:
    """Where events without an alert were lost, with their expected loss."""
    own = rows.where((F.col("part") == part) & (F.col("event_12w") == 1))
    stage = F.when(F.col("alert") == 1, "CAUGHT").when(F.col("difficult") == 1, "DIFFICULT_NOT_SELECTED").when(F.col("c_run") == 0, "NO_ZERO_RUN").when(F.col("true_zero") >= 0.75, "TRUE_ZERO_LIKELY").otherwise("OTHER")
    return own.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.sum("expected_lost").alias("expected_lost"), F.avg("p").alias("mean_p"))


def audit(rows: DataFrame, evaluated: DataFrame, frozen: DataFrame, policies: int = 27) -> DataFrame:
    """Checks of the data: bounds, uniqueness, overlap, parts, grid, one frozen policy."""
    one = rows.agg(
        F.count("*").alias("n"), F.count_distinct("sku_id", "week").alias("keys"), F.count_if((F.col("suspected") < 0) | (F.col("suspected") > 1)).alias("out_of_bounds"), F.count_if(F.col("priority") < 0).alias("negative"),
        F.count_if((F.col("stable") == 1) & (F.col("second") == 1)).alias("overlap"), F.count_if(F.col("event_12w").isNull()).alias("unlabelled"), F.count_distinct("part").alias("parts"), F.count_if((F.col("part") == "LOCKED_TEST") & ~F.weekofyear("week").between(28, 40)).alias("misplaced"),
    ).crossJoin(F.broadcast(evaluated.agg(F.count_distinct("policy").alias("policies")))).crossJoin(F.broadcast(frozen.agg(F.count("*").alias("frozen"))))
    checks = [
        ("ROWS_PRESENT", "n", F.col("n") > 0), ("UNIQUE_ROWS", "keys", F.col("keys") == F.col("n")), ("SUSPICION_BOUNDS", "out_of_bounds", F.col("out_of_bounds") == 0), ("PRIORITY_NOT_NEGATIVE", "negative", F.col("negative") == 0),
        ("LAYERS_APART", "overlap", F.col("overlap") == 0), ("LABELS_COMPLETE", "unlabelled", F.col("unlabelled") == 0), ("ALL_PARTS", "parts", F.col("parts") == 5), ("LOCKED_WEEKS", "misplaced", F.col("misplaced") == 0),
        ("GRID_SIZE", "policies", F.col("policies") == policies), ("ONE_FROZEN_POLICY", "frozen", F.col("frozen") == 1),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("check_id"), F.lit(name).alias("name"), F.col(c).cast("long").alias("value"), F.when(ok, "PASS").otherwise("FAIL").alias("status")) for i, (name, c, ok) in enumerate(checks, 1)))).alias("c")).select("c.*")
