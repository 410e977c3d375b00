"""Side studies: demand classes, encodings, point and quantile candidates, stock policies, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ROUNDS
from ..functions.columns import fixed, positive, quantile, ratio, share
from .panel import by_sku
from .ranks import quantiles, with_quantiles
from .season import zero_regime

ADI, CV2 = 1.32, 0.49
#: Cost of a unit missing and of a unit left, and the standard normal quantile at their critical ratio 10/11.
SHORT, OVER, Z_CRITICAL = 10.0, 1.0, 1.3351777
SMOOTHING = 30.0
POINTS = ("A0", "A1", "A2", "A3")
SHRINK = 0.85


def demand_class(panel: DataFrame, until: str) -> DataFrame:
    """Mean gap between sales and squared variation of sales of each SKU, and the class they give."""
    rows = panel.where(F.col("week") <= F.lit(until).cast("date"))
    sold = F.when(F.col("y") > 0, F.col("y"))
    out = rows.groupBy("sku_id").agg(F.count("*").alias("weeks"), F.count(sold).alias("sales"), F.avg(sold).alias("mean"), fixed(F.stddev_samp(sold), 9).alias("std"))
    out = out.withColumns({"adi": ratio("weeks", "sales"), "cv2": fixed(F.pow(ratio("std", "mean"), F.lit(2.0)), 9)})
    smooth = F.coalesce("cv2", F.lit(0.0)) < CV2
    name = F.when(F.col("sales") == 0, "NO_SALES").when((F.col("adi") < ADI) & smooth, "SMOOTH").when(F.col("adi") < ADI, "ERRATIC").when(smooth, "INTERMITTENT").otherwise("LUMPY")
    return out.withColumn("class", name)


def target_encoding(scores: DataFrame) -> DataFrame:
    """Each SKU's mean demand in TRAIN, drawn to the total's by ``SMOOTHING`` rows, and its cap at the 99.5 % quantile."""
    train = scores.where("split = 'TRAIN'")
    total = with_quantiles(train.agg(F.avg("y_12w").alias("_mean")), train, [], {"cap": ("y_12w", 99.5)})
    out = train.groupBy("sku_id").agg(F.count("*").alias("n"), F.avg("y_12w").alias("mean")).crossJoin(F.broadcast(total))
    return out.select("sku_id", "n", "mean", ((F.col("mean") * F.col("n") + F.col("_mean") * SMOOTHING) / (F.col("n") + SMOOTHING)).alias("encoded"), F.least("mean", "cap").alias("capped"))


def walk_forward(fc: DataFrame) -> DataFrame:
    miss = F.abs(F.col("y_12w") - F.col("yhat"))
    return fc.where("split = 'VAL'").groupBy("week").agg(F.count_distinct("sku_id").alias("skus"), F.avg(miss).alias("mae"), ratio(F.sum(miss), F.sum("y_12w")).alias("wmape"))


def point_candidates(stated: DataFrame) -> DataFrame:
    """A0 the forecast, A1 gated, A2 shrunk out of season, A3 zero where all signs say so."""
    quiet = (F.col("season_group") == "REST") | (F.col("state") == "OFF_SEASON")
    dead = (F.col("zero_share_26w") >= 0.80) & (F.col("median_same") == 0) & (F.col("zero_share_13w") >= 0.70)
    return stated.withColumns({"A0": F.col("yhat"), "A1": F.col("gated"), "A2": F.when(quiet, F.col("gated") * SHRINK).otherwise(F.col("gated")), "A3": F.when(dead, 0.0).otherwise(F.col("gated"))})


def point_eval(stated: DataFrame) -> DataFrame:
    """Error and loss of each candidate by part; the candidates are stacked, so one aggregation does."""
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).alias("f")) for c in POINTS)))
    rows = point_candidates(stated).select("part", "y_12w", stack.alias("s")).select("part", "y_12w", "s.candidate", "s.f")
    miss, y = F.abs(F.col("y_12w") - F.col("f")), F.col("y_12w")
    out = rows.groupBy("part", "candidate").agg(F.count("*").alias("n"), ratio(F.sum(miss), F.sum(y)).alias("wmape"), ratio(F.sum(F.when(y > 0, miss)), F.sum(F.when(y > 0, y))).alias("wmape_positive"), share((y == 0) & (F.col("f") > 0)).alias("zero_over"), ratio(F.sum(F.col("f") - y), F.sum(y)).alias("bias"))
    return out.withColumn("loss", fixed(2 * F.col("wmape_positive") + F.col("zero_over") + 0.5 * F.abs("bias"), 9))


def residual_spreads(stated: DataFrame, least: int = 50) -> DataFrame:
    """Quantiles of positive residuals on DEV_TUNE by season and zero regime; the total's where rows are few."""
    rows = stated.where("part = 'DEV_TUNE'").withColumns({"regime": zero_regime(F.col("zero_share_26w")), "_r": fixed(positive(F.col("y_12w") - F.col("gated")), 9)})
    sets = quantiles(rows, ["season_group", "regime"], {f"r{k}": ("_r", k) for k in (80, 90, 95)}, [["season_group", "regime"], []])
    total = sets.where("_set = 1").select(*(F.col(f"r{k}").alias(f"_t{k}") for k in (80, 90, 95)))
    out = sets.where("_set = 0").crossJoin(F.broadcast(total))
    return out.select("season_group", "regime", "n", F.when(F.col("n") >= least, "SEGMENT").otherwise("GLOBAL").alias("level"), *(F.when(F.col("n") >= least, F.col(f"r{k}")).otherwise(F.col(f"_t{k}")).alias(f"r{k}") for k in (80, 90, 95)))


#: Overlay methods, caps (multiples of the forecast; 0 for none) and least rows of a segment.
METHODS, CAPS, LEAST_ROWS = ("C1_ABS", "C2_LOG", "C3_HYBRID", "C4_MINIMAL"), (0, 2, 3), (300, 500, 1000)


def overlay_grid(spark) -> DataFrame:
    rows = [(f"{m}_CAP{c}_N{n}", m, c, n) for m in METHODS for c in CAPS for n in LEAST_ROWS]
    return spark.createDataFrame(rows, "candidate string, method string, cap int, least int")


def overlay_spreads(stated: DataFrame) -> DataFrame:
    """Residual quantiles on DEV_TUNE, plain and of logarithms, and the 95 % quantile of demand: by state, season and in total."""
    rows = stated.where("part = 'DEV_TUNE'").withColumns({"_a": fixed(positive(F.col("y_12w") - F.col("gated")), 9), "_l": fixed(F.log(F.col("y_12w") + 1) - F.log(F.col("gated") + 1), 9)})
    sets = quantiles(rows, ["state", "season_group"], {f"{t}{k}": (f"_{t}", k) for t in "al" for k in (80, 90, 95)} | {"hist": ("y_12w", 95)}, [["state"], ["season_group"], []])
    level = F.when(F.col("state").isNotNull(), "STATE").when(F.col("season_group").isNotNull(), "SEASON").otherwise("GLOBAL")
    return sets.select(level.alias("level"), F.coalesce("state", "season_group", F.lit("ALL")).alias("segment"), "n", *(f"{t}{k}" for t in "al" for k in (80, 90, 95)), "hist")


def overlaid(rows: DataFrame, spreads: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows x candidates with ``o80, o90, o95``: a state's spread, else its season's, else the total's, and the total's for small segments.

    Caps are the multiple of the forecast or the forecast and the segment's 95 % demand, whichever is
    more; quantiles are ordered from the forecast on.
    """
    names = [f"{t}{k}" for t in "al" for k in (80, 90, 95)] + ["n", "hist"]
    side = lambda level, p: spreads.where(F.col("level") == level).select(F.col("segment").alias(f"{p}_segment"), *(F.col(c).alias(f"{p}_{c}") for c in names))
    out = rows.join(F.broadcast(side("STATE", "s")), F.col("state") == F.col("s_segment"), "left").join(F.broadcast(side("SEASON", "g")), F.col("season_group") == F.col("g_segment"), "left")
    out = out.join(F.broadcast(side("GLOBAL", "t")), F.lit(True), "left").crossJoin(F.broadcast(grid))
    own = lambda c: F.coalesce(f"s_{c}", f"g_{c}", f"t_{c}")
    pick = lambda c: F.when(own("n") >= F.col("least"), own(c)).otherwise(F.col(f"t_{c}"))
    p50, quiet = F.col("gated"), F.col("state").isin("OFF_SEASON", "TRANSITION_DOWN") | (F.col("season_group") == "REST")
    top = F.greatest(p50 * F.col("cap"), p50 + own("hist"))
    last, columns = p50, {}
    for k in (80, 90, 95):
        plain, log = p50 + pick(f"a{k}"), F.greatest(F.lit(0.0), F.exp(F.log(p50 + 1) + pick(f"l{k}")) - 1)
        raw = F.when(F.col("method") == "C1_ABS", plain).when(F.col("method") == "C2_LOG", log).when(F.col("method") == "C3_HYBRID", F.when(quiet, plain).otherwise(log)).otherwise(p50 + 0.5 * own(f"a{k}"))
        columns[f"o{k}"] = last = fixed(F.greatest(last, F.when(F.col("cap") == 0, raw).otherwise(F.least(raw, top))), 9)
    return out.withColumns(columns).drop(*(c for c in out.columns if c[:2] in ("s_", "g_", "t_")))


def overlay_eval(stated: DataFrame, spreads: DataFrame, part: str = "DEV_SELECT") -> DataFrame:
    """Coverage, width and loss of each of the 36 overlays on one part."""
    rows = stated.where(F.col("part") == part).select("season_group", "state", "gated", "y_12w")
    out = overlaid(rows, spreads, overlay_grid(stated.sparkSession)).groupBy("candidate").agg(
        F.count("*").alias("n"), *(share(F.col("y_12w") > F.col(f"o{k}")).alias(f"viol_{k}") for k in (80, 90, 95)), F.avg(F.col("o90") - F.col("gated")).alias("spread"),
        F.coalesce(F.avg(F.when(F.col("season_group") == "REST", F.col("o90") - F.col("gated"))), F.lit(0.0)).alias("spread_rest"),
    )
    h = lambda x: F.greatest(x, F.lit(0.0))
    loss = 1.5 * (F.abs(F.col("viol_80") - 0.10) + F.abs(F.col("viol_90") - 0.04) + F.abs(F.col("viol_95") - 0.01)) + 0.1 * h(F.col("spread") - 20) + 0.05 * F.col("spread_rest")
    return out.withColumn("loss", fixed(loss, 6))


def overlay_forecast(stated: DataFrame, spreads: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Every row of the contract's parts with the quantiles of the overlay of least loss."""
    best = evaluated.orderBy("loss", "candidate").limit(1).select("candidate")
    chosen = overlay_grid(stated.sparkSession).join(best, "candidate")
    rows = stated.select("sku_id", "week", "part", "season_group", "state", "gated", zero_regime(F.col("zero_share_26w")).alias("regime"), "y_12w")
    return overlaid(rows, spreads, chosen).select("sku_id", "week", "part", "candidate", "regime", F.col("gated").alias("p50"), "o80", "o90", "o95", (F.col("o90") - F.col("gated")).alias("spread_90"), "y_12w")


def composite_loss(fc: DataFrame) -> DataFrame:
    """Quantile sources stacked and weighed by coverage, error, zeros and order, on the tuning part."""
    rows = fc.where("split = 'VAL'")
    sources = {"CONFORMAL": ("yhat", "q80", "q90", "q95"), "LAGGED": ("lag_sum", "q80", "q90", "q95"), "WIDE": ("yhat", "q85", "q95", "q99")}
    rows = rows.withColumn("lag_sum", 12 * F.coalesce("lag_1", F.lit(0.0)))
    stack = F.explode(F.array(*(F.struct(F.lit(k).alias("source"), *(F.col(c).alias(n) for n, c in zip(("f", "a", "b", "c"), v, strict=True))) for k, v in sources.items())))
    long = rows.select("y_12w", stack.alias("s")).select("y_12w", "s.*")
    y = F.col("y_12w")
    out = long.groupBy("source").agg(F.count("*").alias("n"), *(share(y > F.col(c)).alias(f"v{k}") for c, k in (("a", 80), ("b", 90), ("c", 95))), ratio(F.sum(F.when(y > 0, F.abs(y - F.col("f")))), F.sum(F.when(y > 0, y))).alias("wmape_positive"), share((y == 0) & (F.col("f") > 0)).alias("zero_over"), share((F.col("b") < F.col("a")) | (F.col("c") < F.col("b"))).alias("non_monotone"))
    loss = 2 * F.abs(F.col("v80") - 0.20) + 3 * F.abs(F.col("v90") - 0.10) + 2 * F.abs(F.col("v95") - 0.05) + F.col("wmape_positive") + 0.5 * F.col("zero_over") + 10 * F.col("non_monotone")
    return out.withColumn("loss", fixed(loss, 9))


def newsvendor(fc: DataFrame) -> DataFrame:
    """Stock at the critical ratio for a normal forecast error, and the expected costs seen on validation rows."""
    rows = fc.where("split = 'VAL'").withColumn("stock", F.greatest(F.col("yhat") + Z_CRITICAL * F.col("scale"), F.lit(0.0)))
    short, over = positive(F.col("y_12w") - F.col("stock")), positive(F.col("stock") - F.col("y_12w"))
    return rows.groupBy("season_group").agg(F.count("*").alias("n"), F.sum("stock").alias("stock"), F.sum(F.least("y_12w", "stock")).alias("served"), ratio(F.sum(F.least("y_12w", "stock")), F.sum("y_12w")).alias("fill"), ratio(F.sum("stock"), F.sum("y_12w")).alias("stock_ratio"), F.sum(F.when(F.col("y_12w") == 0, F.col("stock")).otherwise(0.0)).alias("stock_on_zero"), (SHORT * F.sum(short) + OVER * F.sum(over)).alias("cost"))


def inventory(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stock carried over time: replenishment comes first, demand is served from what is there.

    The stock after each step is the running sum of replenishment less demand above its running
    minimum (or zero), so two windows over one order replace the step-by-step recursion.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum(F.col("replenishment") - F.col("demand")).over(w)
    rows = rows.withColumn("_s", run)
    end = F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))
    rows = rows.withColumn("ending", end)
    start = F.coalesce(F.lag("ending").over(w), F.lit(0.0))
    rows = rows.withColumn("served", start + F.col("replenishment") - F.col("ending"))
    return rows.withColumn("short", F.col("demand") - F.col("served")).drop("_s")


def stocks(rows: DataFrame, keys: list[str], order: str, amounts: list[str]) -> DataFrame:
    """``inventory`` of several replenishments side by side: the stock before and after each step, ``_start_i`` and ``_end_i`` for the i-th."""
    w = Window.partitionBy(*keys).orderBy(order)
    of = lambda what, i: F.col(f"_{what}_{i}")
    each = range(len(amounts))
    own = rows.withColumns({f"_run_{i}": F.sum(F.col(c) - F.col("demand")).over(w) for i, c in enumerate(amounts)})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"_low_{i}": F.min(f"_run_{i}").over(w) for i in each} | {f"_was_{i}": F.lag(f"_run_{i}").over(w) for i in each} | {f"_least_{i}": F.min(f"_run_{i}").over(before) for i in each})
    end = {f"_end_{i}": of("run", i) - F.least(F.lit(0.0), of("low", i)) for i in each}
    start = {f"_start_{i}": F.coalesce(of("was", i) - F.least(F.lit(0.0), of("least", i)), F.lit(0.0)) for i in each}
    return own.select(*rows.columns, *(c.alias(n) for n, c in (end | start).items()))


def inventories(rows: DataFrame, keys: list[str], order: str, plans: dict[str, str], name: str) -> DataFrame:
    """``inventory`` of several replenishments: a row for each of ``plans`` (column by name) and row.

    The windows run over the rows as they are; the plans are stacked behind them, so nothing is shuffled or sorted for each plan.
    """
    kept = [c for c in rows.columns if c not in plans.values()]
    own = stocks(rows, keys, order, [*plans.values()])
    each = [F.struct(F.lit(n).alias(name), F.col(c).alias("replenishment"), F.col(f"_end_{i}").alias("ending"), (F.col(f"_start_{i}") + F.col(c) - F.col(f"_end_{i}")).alias("served")) for i, (n, c) in enumerate(plans.items())]
    out = own.select(*kept, F.explode(F.array(*each)).alias("_s")).select(*kept, "_s.*")
    return out.withColumn("short", F.col("demand") - F.col("served"))


def replenished(panel: DataFrame, recent_weeks: int = 4) -> DataFrame:
    """Each week's demand and a replenishment of the mean of the weeks before, in whole units."""
    mean = F.avg("y").over(by_sku().rowsBetween(-recent_weeks, -1))
    return panel.select("sku_id", "week", F.col("y").alias("demand"), F.floor(F.coalesce(mean, F.lit(0.0)) + 0.5).cast("double").alias("replenishment"))


def inventory_summary(rows: DataFrame) -> DataFrame:
    sim = inventory(rows, ["sku_id"], "week")
    return sim.groupBy("sku_id").agg(F.sum("demand").alias("demand"), F.sum("served").alias("served"), ratio(F.sum("served"), F.sum("demand")).alias("fill"), F.count_if(F.col("short") > 0).alias("short_weeks"), F.avg("ending").alias("mean_stock"), F.max_by("ending", "week").alias("last_stock"))


def whole_units(parts: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Whole units by the largest remainder: floors, then one more for the largest fractions until the rounded total is met."""
    per = Window.partitionBy(*keys)
    rows = parts.withColumn("_v", fixed(value, 6)).withColumn("_f", F.floor("_v"))
    rest = F.round(F.sum("_v").over(per)) - F.sum("_f").over(per)
    rank = F.row_number().over(per.orderBy(F.desc(fixed(F.col("_v") - F.col("_f"), 6)), name))
    rows = rows.withColumns({"_rest": rest, "_rank": rank})
    return rows.withColumn("whole", (F.col("_f") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)).cast("long")).drop("_v", "_f", "_rest", "_rank")


#: Weeks whose discounted sums are taken together; the decay to this power must stay a normal number.
BLOCK = 64


def smoothed(panel: DataFrame, span: int = 8) -> DataFrame:
    """Exponentially weighted mean of all weeks before each week, weights brought to one; null in the first week.

    The recurrence s = decay * s + y is a prefix scan: within blocks of ``BLOCK`` weeks a running sum of y over
    the decay's powers, which can't overflow there, and the blocks' totals carried from one to the next. Weeks without gaps are
    expected, as the panel has them.
    """
    decay = 1 - 2.0 / (span + 1)
    power = lambda k: F.pow(F.lit(decay), k)
    first = Window.partitionBy("sku_id")
    rows = panel.select("sku_id", "week", F.col("y").cast("double").alias("y")).withColumn("_t", F.datediff("week", F.min("week").over(first)) / 7)
    rows = rows.withColumns({"_k": F.floor(F.col("_t") / BLOCK).cast("int"), "_j": (F.col("_t") % BLOCK).cast("int")})
    block = Window.partitionBy("sku_id", "_k").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("sku_id", "_k").agg(F.sum(F.col("y") * power(BLOCK - 1 - F.col("_j"))).alias("_c"))
    # a list of a number for each 64 weeks; carried[k] is the sum up to the end of block k - 1
    lists = whole.groupBy("sku_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_c"))), lambda x: x["_c"]).alias("_cs"))
    step = lambda a, c: F.concat(a, F.array(F.element_at(a, -1) * decay**BLOCK + c))
    carried = lists.select("sku_id", F.aggregate("_cs", F.array(F.lit(0.0)), step).alias("_carried"))
    local = F.coalesce(F.sum(F.col("y") * power(-F.col("_j"))).over(block), F.lit(0.0)) * power(F.col("_j") - 1)
    weight = (1 - power(F.col("_t"))) / (1 - decay)
    return rows.withColumn("_local", local).drop("y").join(carried, "sku_id").select("sku_id", "week", F.when(F.col("_t") > 0, (F.col("_local") + F.get("_carried", F.col("_k")) * power(F.col("_j"))) / weight).alias("smoothed"))


def poisson_weights(seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson weights of mean 1, rows x rounds, from a hash of row and round: the same on any partitioning."""
    x = seeds.astype(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share_ = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cdf, share_ / float(1 << 53), side="right").astype(np.float64)


def bootstrap(fc: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Paired difference of WMAPE between the forecast and the last week's sales, by season and for ALL, with its interval.

    Every row has in each round a Poisson weight that depends on its key and the round, so rounds
    are sums over partitions: a partition gives ``rounds`` sums a season, whatever its rows.
    """

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for season, rows_ in b.groupby("season_group"):
                for at in range(0, len(rows_), 256):
                    part = rows_.iloc[at : at + 256]
                    weights = poisson_weights(part["seed"].to_numpy(), rounds)
                    total[season] = total.get(season, 0) + np.stack([weights.T @ part[c].to_numpy(dtype=float) for c in ("miss_a", "miss_b", "y_12w")])
        for season, t in total.items():
            yield pd.DataFrame({"season_group": season, "round": np.arange(rounds), "a": t[0], "b": t[1], "y": t[2]})

    per_round = bootstrap_rows(fc).mapInPandas(sums, "season_group string, round int, a double, b double, y double")
    per_round = per_round.groupingSets([["season_group", "round"], ["round"]], "season_group", "round").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("y").alias("y"))
    diff = ratio(F.col("a") - F.col("b"), "y")
    out = per_round.groupBy(F.coalesce("season_group", F.lit("ALL")).alias("season_group")).agg(F.avg(diff).alias("mean"), quantile(diff, 2.5).alias("low"), quantile(diff, 97.5).alias("high"), share(diff > 0).alias("_up"), share(diff < 0).alias("_down"))
    return out.select("season_group", "mean", "low", "high", F.least(F.lit(1.0), 2 * F.least("_up", "_down")).alias("p_value"))


def bootstrap_rows(fc: DataFrame) -> DataFrame:
    """Misses of both forecasts and the seed of each validation row."""
    miss = lambda x: F.abs(F.col("y_12w") - x)
    return fc.where("split = 'VAL'").select("season_group", "y_12w", miss(F.col("yhat")).alias("miss_a"), miss(12 * F.coalesce("lag_1", F.lit(0.0))).alias("miss_b"), F.abs(F.xxhash64("sku_id", "week") % (1 << 40)).alias("seed"))
