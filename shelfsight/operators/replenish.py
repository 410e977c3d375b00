"""Replenishment in whole units: strategies from a continuous stock, simulated, scored, one chosen and checked.

A plan has a row for each SKU, province and week. Groups that a window holds are a SKU and
province (the weeks of one horizon); orders over all rows are ranked by ranges, and the search
of the top-up evaluates several amounts in one pass, so the driver sees a few sums a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Service
from ..functions.columns import fixed, positive, ratio
from ..sources.stages import dealt, written, written_buckets
from .ranks import is_before, is_same, quantiles, reached, running_sums
from .studies import Z_CRITICAL, inventories, stocks

KEYS = ["sku_id", "province"]
STRATEGIES = ("weekly_round", "weekly_priority", "monthly_release", "block3_release", "horizon_release", "hybrid", "hybrid_topup")
#: Weight of the class of value, of the tier of a province, and of uneven demand (fixed values).
ABC_WEIGHT = {"A": 2.0, "B": 1.3, "C": 0.6}
TIER_WEIGHT = {1: 1.4, 2: 1.25, 3: 1.15, 4: 1.0}
UNEVEN, UNEVEN_WEIGHT = ("INTERMITTENT", "LUMPY"), 1.25
#: Caps of the top-up by class: multiples of the stock and of the forecast (fixed values).
TOPUP_CAPS = {"A": (1.40, 2.50), "B": (1.25, 2.00), "C": (1.15, 1.50)}


def _when(pairs: dict, of: Column, last: float) -> Column:
    out = F.lit(last)
    for k, v in pairs.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def tiers(geo: DataFrame, until: str) -> DataFrame:
    """Tier of each province by its volume up to a day: three largest, five next, four next, the others. A row a province."""
    sold = geo.where(F.col("week") <= F.lit(until).cast("date")).groupBy("province").agg(fixed(F.sum("units"), 6).alias("_u"))
    place = F.row_number().over(Window.orderBy(F.desc("_u"), "province"))
    return sold.select("province", place.alias("place")).withColumn("tier", F.when(F.col("place") <= 3, 1).when(F.col("place") <= 8, 2).when(F.col("place") <= 12, 3).otherwise(4))


def abc_classes(panel: DataFrame, until: str) -> DataFrame:
    """A for SKUs with training units at the 80 % quantile or more, B at the median or more, else C."""
    sold = panel.where(F.col("week") <= F.lit(until).cast("date")).groupBy("sku_id").agg(F.sum("y").alias("_u"))
    cuts = quantiles(sold, [], {"_a": ("_u", 80), "_b": ("_u", 50)}).drop("n")
    return sold.crossJoin(F.broadcast(cuts)).select("sku_id", F.when(F.col("_u") >= F.col("_a"), "A").when(F.col("_u") >= F.col("_b"), "B").otherwise("C").alias("abc"))


def plan(shares: DataFrame, national: DataFrame, skus: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each SKU, province and validation week: a week's share of the forecast and of the newsvendor's stock, and what sold.

    shares: with ``sold``, dealt by SKU as ``national`` is, so that a plan moves no rows. skus: the classes of each SKU.
    ``with_scores`` adds what follows from a row alone.
    """
    rows = shares.select(*KEYS, "week", "share", "sold").join(national.select("sku_id", "week", "yhat", "p", "scale"), ["sku_id", "week"])
    rows = rows.join(skus, "sku_id", "left").join(F.broadcast(places.select("province", "tier")), "province", "left")
    rows = rows.withColumns({"abc": F.coalesce("abc", F.lit("C")), "demand": F.coalesce("demand", F.lit("NO_SALES")), "tier": F.coalesce("tier", F.lit(4)), "real": F.coalesce("sold", F.lit(0.0))})
    return rows.withColumns({
        "pred": fixed(F.col("share") * F.col("yhat") / 12, 6), "stock": fixed(positive(F.col("share") * (F.col("yhat") + Z_CRITICAL * F.col("scale")) / 12), 6), "prob": fixed(1 - F.col("p"), 6),
    }).select(*KEYS, "week", "abc", "demand", "tier", "pred", "stock", "prob", "real")


def with_scores(rows: DataFrame) -> DataFrame:
    """The plan with month, block of weeks and the scores that order rows; they use what is known before the week only, ``real`` is for the simulation."""
    week = F.weekofyear("week")
    uneven = F.when(F.col("demand").isin(*UNEVEN), UNEVEN_WEIGHT).otherwise(1.0)
    score = fixed(F.col("pred") * F.col("prob") * _when(ABC_WEIGHT, F.col("abc"), 0.6) * _when(TIER_WEIGHT, F.col("tier"), 1.0) * uneven, 9)
    return rows.withColumns({
        "month": F.when(week <= 4, "M01").when(week <= 8, "M02").when(week <= 13, "M03").when(week <= 17, "M04").when(week <= 22, "M05").otherwise("M06"),
        "block3": F.when(week <= 9, "B1").when(week <= 18, "B2").otherwise("B3"), "score": score,
    }).withColumn("release", fixed(F.col("score") + 0.10 * F.col("stock") + 0.01 * F.col("pred"), 9))


#: The order of candidates for one more unit, and of rows for the top-up; true where a column falls.
PRIORITY = {"score": True, "stock": True, "prob": True, "sku_id": False, "province": False, "week": False}
TOPUP = {"score": True, "sku_id": False, "province": False, "week": False}


def with_priority(rows: DataFrame, threshold: float = 0.10, parts: int | None = None) -> DataFrame:
    """``weekly_priority``: floors, and one more unit for the best rows until the rounded total is met.

    Rows of ``threshold`` or more that have a fraction are candidates, by score, stock and probability. The last
    one within the total is searched; all others are held against it, so rows are not moved.
    """
    floor = F.floor("stock")
    able = (F.col("stock") >= threshold) & (F.col("stock") > floor)
    budget = int(rows.agg(F.greatest(F.bround(fixed(F.sum("stock"), 6)) - F.sum(floor), F.lit(0.0)).alias("n")).first()["n"])
    last = reached(rows.where(able), PRIORITY, F.lit(1), budget, parts)
    within = F.lit(budget > 0) if last is None else is_before(last, PRIORITY) | is_same(last, PRIORITY)
    return rows.withColumn("weekly_priority", (floor + F.when(able & within, 1).otherwise(0)).cast("long"))


#: Column that parts a horizon with its values, and the least stock of a group that is rounded up, by strategy.
RELEASES = {"monthly_release": ("month", ("M01", "M02", "M03", "M04", "M05", "M06"), 0.50), "block3_release": ("block3", ("B1", "B2", "B3"), 0.50), "horizon_release": (None, ("ALL",), 0.35)}


def large_groups(rows: DataFrame) -> dict[str, float]:
    """The 60 % quantile of the groups' forecasts for each of ``RELEASES``."""
    sums = [rows.groupBy(*KEYS, *filter(None, [by])).agg(fixed(F.sum("pred"), 6).alias("_g")).select(F.lit(n).alias("_name"), "_g") for n, (by, _, _) in RELEASES.items()]
    cuts = quantiles(written(reduce(DataFrame.unionByName, sums), "groups"), ["_name"], {"_q60": ("_g", 60)})
    return {r["_name"]: r["_q60"] for r in cuts.collect()}


def with_releases(rows: DataFrame) -> DataFrame:
    """A column for each of ``RELEASES``: a group's stock in whole units, dealt to its best weeks; and ``_mean``, the mean stock of the months.

    Groups of class A, of uneven demand, in the first three tiers, of large forecast or with a stock of the least size or more are
    rounded up, others to the nearest. The units go to as many rows as there are units at
    most, evenly, the rest one each to the first ones by score. Groups are few for a SKU and province, whose class
    and tier they share, so one order of its rows serves all of them.
    """
    large = large_groups(rows)
    best = fixed(F.col("release") + 0.001 * F.col("stock") + 0.0001 * F.col("prob"), 9)
    whole = Window.partitionBy(*KEYS)
    upto = whole.orderBy(F.desc(best), "week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = lambda by, v: F.col(by) == v if by else F.lit(True)
    each = [(n, by, v) for n, (by, values, _) in RELEASES.items() for v in values]
    out = rows.withColumns({f"_rank_{v}": F.count(F.when(here(by, v), 1)).over(upto) for _, by, v in each})
    out = out.withColumns({f"_{name}_{v}": f(F.when(here(by, v), x)).over(whole) for _, by, v in each for name, f, x in (("total", F.sum, F.col("stock")), ("pred", F.sum, F.col("pred")), ("n", F.count, F.lit(1)))})
    pick = lambda what, by, values: reduce(lambda x, v: F.when(F.col(by) == v, F.col(f"_{what}_{v}")).otherwise(x), values[1:], F.col(f"_{what}_{values[0]}"))
    months = RELEASES["monthly_release"][1]
    mean = reduce(lambda x, y: x + y, (F.coalesce(f"_total_{m}", F.lit(0.0)) for m in months)) / reduce(lambda x, y: x + y, ((F.col(f"_n_{m}") > 0).cast("int") for m in months))
    picked = {f"_{what}_{name}": pick(what, by, values) for name, (by, values, _) in RELEASES.items() for what in ("rank", "total", "pred", "n")}
    of = lambda what, name: fixed(picked[f"_{what}_{name}"], 6) if what in ("total", "pred") else picked[f"_{what}_{name}"]
    out = out.select(*rows.columns, fixed(mean, 6).alias("_mean"), *(of(what, name).alias(f"_{what}_{name}") for name in RELEASES for what in ("rank", "total", "pred", "n")))
    # in steps, so that no expression is worked out more than once
    key = (F.col("abc") == "A") | F.col("demand").isin(*UNEVEN) | (F.col("tier") <= 3)
    up = lambda name, least: key | (F.col(f"_pred_{name}") >= large.get(name, 0.0)) | (F.col(f"_total_{name}") >= least)
    out = out.withColumns({f"_units_{n}": F.when(up(n, least) & (F.col(f"_total_{n}") > 0), F.ceil(f"_total_{n}")).otherwise(F.bround(f"_total_{n}")).cast("long") for n, (_, _, least) in RELEASES.items()})
    out = out.withColumns({f"_slots_{n}": F.least(f"_n_{n}", f"_units_{n}") for n in RELEASES})
    rank, units, slots = (lambda n, what=what: F.col(f"_{what}_{n}") for what in ("rank", "units", "slots"))
    own = lambda n: F.when((slots(n) > 0) & (rank(n) <= slots(n)), F.floor(units(n) / slots(n)) + F.when(rank(n) <= units(n) % slots(n), 1).otherwise(0)).otherwise(0)
    return out.select(*rows.columns, *(own(n).cast("long").alias(n) for n in RELEASES), "_mean")


def with_strategies(rows: DataFrame) -> DataFrame:
    """The plan with six ways to whole units; ``hybrid`` takes one of the others by class, tier and demand.

    All windows are within a SKU and province: a plan in buckets of the SKU isn't shuffled.
    """
    out = with_releases(with_priority(rows.withColumn("weekly_round", F.bround("stock").cast("long"))))
    uneven = F.col("demand").isin(*UNEVEN)
    hybrid = (
        F.when((F.col("abc") == "A") | (F.col("tier") <= 3), F.col("block3_release")).when(uneven & (F.col("_mean") < 1), F.col("horizon_release"))
        .when(uneven, F.col("monthly_release")).when(F.col("abc") == "C", F.col("weekly_priority")).otherwise(F.col("monthly_release"))
    )
    return out.withColumn("hybrid", hybrid).drop("_mean")


def _fill(rows: DataFrame, amounts: dict[int, Column]) -> dict[int, float]:
    """Share of demand that each of several replenishments serves, in one pass."""
    own = rows.select(*KEYS, "week", F.col("real").alias("demand"), *(a.cast("double").alias(f"_r_{k}") for k, a in amounts.items()))
    out = inventories(own, KEYS, "week", {str(k): f"_r_{k}" for k in amounts}, "_try").groupBy("_try").agg(ratio(F.sum("served"), F.sum("demand")).alias("fill"))
    return {int(r["_try"]): r["fill"] or 0.0 for r in out.collect()}


def topped_up(rows: DataFrame, s: Service | None = None, ways: int = 8, parts: int | None = None, fills: dict[str, float] | None = None) -> tuple[str, Column | None]:
    """What ``hybrid_topup`` starts from, the hybrid (or, where that serves too much, the release by horizon), and the fewest further units that serve the target, if any.

    Units are added by score, to a row up to its cap, within the budget of stock and of stock where
    nothing sells. What a number of units serves never falls with the number, so the
    least one is found by trying ``ways`` numbers at a time. It looks at what sold, so it is a
    bound for planning, not a forecast. fills: what the strategies serve, where known.
    """
    s = s or Service()
    if fills is None:
        fills = dict(zip(("hybrid", "horizon_release"), map(_fill(rows, {0: F.col("hybrid"), 1: F.col("horizon_release")}).get, (0, 1)), strict=True))
    name = "horizon_release" if (fills.get("hybrid") or 0.0) > s.fill_max else "hybrid"
    if s.fill_target <= (fills.get(name) or 0.0) <= s.fill_max:
        return name, None
    rows = rows.withColumn("_base", F.col(name))
    of = lambda k: _when({c: v[k] for c, v in TOPUP_CAPS.items()}, F.col("abc"), TOPUP_CAPS["C"][k])
    cap = F.ceil(F.greatest(fixed(F.col("stock") * of(0), 6), fixed(F.col("pred") * of(1), 6)))
    dull = (F.col("pred") <= 0.01) & (F.col("prob") <= 0.50) & ~((F.col("abc") == "A") & (F.col("tier") <= 3))
    can = F.when(dull, 0).otherwise(F.greatest(cap - F.col(name), F.lit(0))).cast("long")
    rows = rows.withColumn("_can", can)
    sums = rows.agg(F.sum("real").alias("real"), F.sum("_base").alias("base"), F.sum("_can").alias("can"), F.coalesce(F.sum(F.when(F.col("real") == 0, F.col("_base"))), F.lit(0)).alias("idle")).first()
    most = min(sums["can"] or 0, int(s.ratio_max * (sums["real"] or 0.0) - (sums["base"] or 0)))
    room = s.zeros_max - sums["idle"]
    if room < 0 or most <= 0:  # no unit may be added, so nothing is ranked
        return name, None
    order = [F.desc(c) if falls else F.asc(c) for c, falls in TOPUP.items()]
    own = running_sums(rows.select(*TOPUP, "real", "_base", "_can"), [], order, {"_upto": F.col("_can"), "_idle": F.when(F.col("real") == 0, F.col("_can")).otherwise(0)}, parts)
    own = written_buckets(dealt(own, "sku_id"), "topup", "sku_id")
    # the first row whose idle units pass the limit ends the prefix within it
    over = own.where((F.col("real") == 0) & (F.col("_idle") > room)).agg(F.min(F.col("_upto") - F.col("_can") + F.greatest(F.lit(room) - (F.col("_idle") - F.col("_can")), F.lit(0))).alias("n")).first()["n"]
    most = min(most, int(over)) if over is not None else most
    add = lambda n: F.col("_base") + F.least(F.greatest(F.lit(n) - (F.col("_upto") - F.col("_can")), F.lit(0)), F.col("_can"))
    low, high = 0, most  # the answer lies above low, and at high at most
    if high and _fill(own, {high: add(high)})[high] >= s.fill_target:
        while high - low > 1:
            tries = sorted({low + (high - low) * k // ways for k in range(1, ways)} - {low})
            got = _fill(own, {n: add(n) for n in tries})
            enough = [n for n in tries if got[n] >= s.fill_target]
            low, high = max([n for n in tries if got[n] < s.fill_target], default=low), min(enough, default=high)
    last = own.where((F.col("_upto") >= high) & (F.col("_upto") - F.col("_can") < high)).first()
    # rows before the last one that gets units are filled up; all are held against it, so none is joined
    return name, None if last is None else F.when(is_before(last, TOPUP), can).when(is_same(last, TOPUP), high - (last["_upto"] - last["_can"])).otherwise(0)


def with_topup(rows: DataFrame, s: Service | None = None, ways: int = 8, parts: int | None = None) -> DataFrame:
    """``hybrid_topup``: see ``topped_up``."""
    name, more = topped_up(rows, s, ways, parts)
    return rows.withColumn("hybrid_topup", (F.col(name) + (F.lit(0) if more is None else more)).cast("long"))


SUMS = ("n", "demand", "replenished", "served", "short", "last_stock", "ending", "idle", "nan", "negative")


def _sums(sim: DataFrame) -> DataFrame:
    """What figures are sums of, a row each as ``dynamic`` gives it; cells are sums already."""
    if "replenished" in sim.columns:
        return sim
    r, y, e = F.col("replenishment"), F.col("demand"), F.col("ending")
    return sim.select(
        "strategy", "abc", "class", "province", "week", F.lit(1).cast("long").alias("n"), "demand", r.alias("replenished"), "served", "short", F.col("_last").alias("last_stock"), "ending", F.when(y == 0, r).otherwise(0.0).alias("idle"),
        F.least(r, e).alias("least"), F.coalesce((F.isnan(r) | F.isnan("served") | F.isnan(e)).cast("long"), F.lit(0)).alias("nan"), F.coalesce(((r < 0) | (e < -1e-9)).cast("long"), F.lit(0)).alias("negative"),
    )


def cells(rows: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """The sums of ``dynamic`` by strategy, both classes, province and week: as many rows as there are of these, however many SKUs.

    Strategies are summed up side by side and stacked as sums.
    """
    own = stocks(_simulated(rows, strategies), KEYS, "week", [*strategies])
    y, last, sums = F.col("demand"), F.col("week") == F.col("_end"), []
    for i, c in enumerate(strategies):
        r, end = F.col(c), F.col(f"_end_{i}")
        served = F.col(f"_start_{i}") + r - end
        sums += [
            F.sum(r).alias(f"replenished_{i}"), F.sum(served).alias(f"served_{i}"), F.sum(y - served).alias(f"short_{i}"), F.sum(F.when(last, end).otherwise(0.0)).alias(f"last_stock_{i}"), F.sum(end).alias(f"ending_{i}"),
            F.sum(F.when(y == 0, r).otherwise(0.0)).alias(f"idle_{i}"), F.min(F.least(r, end)).alias(f"least_{i}"), F.count_if(F.isnan(r) | F.isnan(served) | F.isnan(end)).alias(f"nan_{i}"), F.count_if((r < 0) | (end < -1e-9)).alias(f"negative_{i}"),
        ]
    by, names = ["abc", "class", "province", "week"], (*SUMS[2:], "least")
    wide = own.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("demand"), *sums)
    each = [F.struct(F.lit(c).alias("strategy"), *(F.col(f"{x}_{i}").alias(x) for x in names)) for i, c in enumerate(strategies)]
    return wide.select(*by, "n", "demand", F.explode(F.array(*each)).alias("_s")).select("_s.strategy", *by, "n", "demand", *(f"_s.{x}" for x in names))


def _figures() -> list[Column]:
    total = F.sum
    return [
        total("n").alias("n"), total("demand").alias("demand"), total("replenished").alias("replenished"), ratio(total("served"), total("demand")).alias("fill"), ratio(total("replenished"), total("demand")).alias("stock_ratio"), total("short").alias("short"),
        total("last_stock").alias("last_stock"), ratio(total("ending"), total("n")).alias("mean_stock"), total("idle").alias("idle"), total("ending").alias("excess"), F.min("least").alias("least"),
    ]


def _simulated(rows: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    last = F.max("week").over(Window.partitionBy(*KEYS))
    return rows.select(*KEYS, "week", "abc", F.col("demand").alias("class"), "tier", F.col("real").alias("demand"), *(F.col(s).cast("double").alias(s) for s in strategies), last.alias("_end"))


def dynamic(rows: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Every strategy simulated: a row for each strategy, SKU, province and week. Rows are shuffled and sorted once, not once a strategy."""
    sim = inventories(_simulated(rows, strategies), KEYS, "week", {s: s for s in strategies}, "strategy")
    last = F.col("_end")
    return sim.withColumn("_last", F.when(F.col("week") == last, F.col("ending")).otherwise(0.0)).drop("_end")


def strategy_scores(sim: DataFrame, s: Service | None = None) -> DataFrame:
    """Figures of each strategy, whether it keeps to the limits, its score (less is better), and ``chosen`` for the best valid one, or the best.

    sim: the simulated rows or their ``cells``, here and below.
    """
    s = s or Service()
    out = _sums(sim).groupBy("strategy").agg(*_figures())
    h = lambda x: F.greatest(x, F.lit(0.0))
    fill, stock = F.col("fill"), F.col("stock_ratio")
    score = F.abs(fill - s.fill_ideal) + 2 * h(stock - 1.75) + h(F.col("idle") - 100_000) / F.greatest(F.col("demand"), F.lit(1.0)) + 5 * h(s.fill_target - fill) + 2 * h(fill - s.fill_max)
    valid = fill.between(s.fill_target, s.fill_max) & (stock <= s.ratio_max) & (F.col("idle") <= s.zeros_max) & (F.col("least") >= -1e-9)
    out = out.withColumns({"score": fixed(score, 6), "valid": F.coalesce(valid, F.lit(False))}).drop("least")
    place = F.row_number().over(Window.orderBy(F.desc("valid"), F.asc_nulls_last("score"), "strategy"))  # seven rows
    return out.withColumn("chosen", place == 1)


def segment_scores(sim: DataFrame, scores: DataFrame) -> DataFrame:
    """Figures of the chosen strategy by class of value, class of demand, both, province and week, in one pass."""
    own = _sums(sim).join(F.broadcast(scores.where("chosen").select("strategy")), "strategy").withColumn("_class", F.col("class"))
    sets = [["abc"], ["_class"], ["abc", "_class"], ["province"], ["week"]]
    out = own.groupingSets([["strategy", *x] for x in sets], "strategy", "abc", "_class", "province", "week").agg(F.grouping_id().alias("_g"), *_figures())
    name = F.when(F.col("_g") == 7, "ABC").when(F.col("_g") == 11, "DEMAND").when(F.col("_g") == 3, "ABC_DEMAND").when(F.col("_g") == 13, "PROVINCE").otherwise("WEEK")
    segment = F.concat_ws("_", "abc", "_class", "province", F.col("week").cast("string"))
    return out.select(name.alias("level"), segment.alias("segment"), "strategy", "n", "demand", "replenished", "fill", "stock_ratio", "short", "last_stock", "mean_stock", "idle", "excess")


def acceptance(sim: DataFrame, scores: DataFrame, segments: DataFrame, places: DataFrame, s: Service | None = None) -> DataFrame:
    """Fourteen checks of the chosen strategy, six of them mandatory, and what is recommended.

    Segments are held against plain weekly rounding. Of the three largest provinces the first must serve
    88.8 %, the others 86 %. A figure that is unknown fails.
    """
    s = s or Service()
    one = scores.where("chosen").select("strategy", "fill", "stock_ratio", "idle")
    sums = _sums(sim)
    sane = sums.join(F.broadcast(one.select("strategy")), "strategy").agg(F.coalesce(F.sum("nan"), F.lit(0)).alias("_nan"), F.coalesce(F.sum("negative"), F.lit(0)).alias("_negative"))
    plain = sums.where("strategy = 'weekly_round' and abc = 'A'").groupBy("class").agg(ratio(F.sum("served"), F.sum("demand")).alias("_plain"))
    mine = segments.where("level = 'ABC_DEMAND'").select("segment", F.col("fill").alias("_mine"))

    def gain(name: str) -> DataFrame:
        a = plain.where(F.col("class") == name).agg(F.max("_plain").alias("_a"))
        b = mine.where(F.col("segment") == f"A_{name}").agg(F.max("_mine").alias("_b"))
        return a.crossJoin(F.broadcast(b)).select((F.col("_b") - F.col("_a")).alias(f"gain_{name.lower()}"))

    spots = segments.where("level = 'PROVINCE'").join(F.broadcast(places.where("place <= 3").select(F.col("province").alias("segment"), "place")), "segment")
    spots = spots.agg(*(F.max(F.when(F.col("place") == k, F.col("fill"))).alias(f"place_{k}") for k in (1, 2, 3)))
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [one, sane, gain("INTERMITTENT"), gain("LUMPY"), spots])
    fill, stock, idle = F.col("fill"), F.col("stock_ratio"), F.col("idle")
    checks = [
        ("FILL_LEAST", True, fill, fill >= s.fill_target), ("FILL_MOST", True, fill, fill <= s.fill_max), ("STOCK_RATIO", True, stock, stock <= s.ratio_max), ("IDLE_STOCK", True, idle, idle <= s.zeros_max),
        ("NO_NAN", True, F.col("_nan"), F.col("_nan") == 0), ("NO_NEGATIVE", True, F.col("_negative"), F.col("_negative") == 0), ("FILL_IDEAL", False, fill, fill.between(0.9110, 0.9135)), ("STOCK_RATIO_IDEAL", False, stock, stock <= 1.75),
        ("IDLE_STOCK_IDEAL", False, idle, idle <= 100_000), ("A_INTERMITTENT_GAIN", False, F.col("gain_intermittent"), F.col("gain_intermittent") >= 0), ("A_LUMPY_GAIN", False, F.col("gain_lumpy"), F.col("gain_lumpy") >= 0),
        *((f"PLACE_{k}", False, F.col(f"place_{k}"), F.col(f"place_{k}") >= least) for k, least in ((1, 0.888), (2, 0.860), (3, 0.860))),
    ]
    rows = row.select("strategy", F.explode(F.array(*(F.struct(F.lit(i).alias("check_id"), F.lit(n).alias("name"), F.lit(m).alias("mandatory"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")) for i, (n, m, v, ok) in enumerate(checks, 1)))).alias("c")).select("strategy", "c.*")
    total = rows.agg(F.count_if(F.col("mandatory") & ~F.col("passed")).alias("_failed"), F.count_if(~F.col("mandatory") & F.col("passed")).alias("_nice"))
    verdict = F.when(F.col("_failed") > 0, F.concat(F.lit("REJECT ("), F.col("_failed").cast("string"), F.lit(" mandatory failed)"))).when(F.col("_nice") >= 5, "APPROVE").otherwise(F.concat(F.lit("APPROVE WITH RESERVATIONS ("), F.col("_nice").cast("string"), F.lit(" of 8)")))
    return rows.crossJoin(F.broadcast(total)).select("check_id", "strategy", "name", "mandatory", "value", "passed", verdict.alias("recommendation"))


def stock_comparison(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """The continuous stock, week by week without carrying over, beside every strategy with it."""
    static = rows.agg(ratio(F.sum(F.least("stock", "real")), F.sum("real")).alias("fill"), ratio(F.sum("stock"), F.sum("real")).alias("stock_ratio"), F.sum(positive(F.col("real") - F.col("stock"))).alias("short"), F.sum(F.when(F.col("real") == 0, F.col("stock")).otherwise(0.0)).alias("idle"))
    static = static.select(F.lit("continuous").alias("version"), F.lit("static").alias("kind"), "fill", "stock_ratio", "short", "idle")
    return static.unionByName(scores.select(F.col("strategy").alias("version"), F.lit("dynamic").alias("kind"), "fill", "stock_ratio", "short", "idle"))
