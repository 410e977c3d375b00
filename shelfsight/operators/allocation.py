"""Provincial allocation: trailing sales, smoothed shares, exact reconciliation, historic shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SPLITS
from ..functions.columns import fixed, monday, ratio
from ..sources.stages import written

#: Days of trailing sales; sales exactly that old are out, those of the decision week are in.
TRAILING = 364
LEAST_UNITS, LEAST_WEEKS = 5.0, 3
ALPHA = {"sku": 10.0, "family": 25.0, "global": 50.0}
SPREAD = ("yhat", "q80", "q90", "q95")


def weekly_geo(fact: DataFrame) -> DataFrame:
    """Units by SKU, province and week; returns are left out."""
    return fact.where("units > 0 and sku_id is not null").groupBy("sku_id", "province", monday("date").alias("week")).agg(F.sum("units").alias("units"))


def sku_family(lines: DataFrame) -> DataFrame:
    """The most sold family of each SKU, ties to the first name."""
    by = lines.groupBy("sku_id", "family").agg(F.sum(F.greatest(F.col("units"), F.lit(0.0))).alias("units"))
    return by.groupBy("sku_id").agg(F.min_by("family", F.struct(-F.col("units"), F.col("family"))).alias("family"))


def sku_metadata(fact: DataFrame) -> DataFrame:
    """One row a SKU: its most sold family, ties to the first name; first and last day, provinces."""
    family = sku_family(fact)
    span = fact.groupBy("sku_id").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_distinct("province").alias("provinces"))
    return family.join(span, "sku_id")


def trailing_sales(geo: DataFrame, weeks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, week, units, n_weeks`` of the trailing year of each decision week, where anything sold, and ``sold``, the week's own units.

    Each week's sales meet the decision weeks that see them, a broadcast table of at most 53 rows, and are summed up
    where they are: sales dealt by one of the keys are not moved.
    """
    sold = geo.groupBy(*keys, "week").agg(F.sum("units").alias("u"))
    marks = F.broadcast(weeks.select(F.col("week").alias("_mark")).distinct())
    rows = sold.join(marks, (F.col("week") <= F.col("_mark")) & (F.col("week") > F.date_sub("_mark", TRAILING)))
    own = F.sum(F.when(F.col("week") == F.col("_mark"), F.col("u")))
    return rows.groupBy(*keys, "_mark").agg(F.sum("u").alias("units"), F.count("*").alias("n_weeks"), own.alias("sold")).where("units > 0").select(*keys, F.col("_mark").alias("week"), "units", "n_weeks", "sold")


def dirichlet_shares(geo: DataFrame, metadata: DataFrame, weeks: DataFrame, sold: bool = False) -> DataFrame:
    """Smoothed share of each province in each SKU and decision week.

    A SKU and province with enough sales leans on its family's share with a small weight, others
    with a larger one, then on the global share, then on equal shares. geo: dealt or in buckets by SKU, so that no
    row of a share is moved. sold: the week's own sales too.
    """
    weeks = weeks.select("week").distinct()
    span = weeks.agg(F.date_sub(F.min("week"), TRAILING).alias("_after"), F.max("week").alias("_upto"))
    seen = geo.crossJoin(F.broadcast(span)).where("week > _after and week <= _upto").drop("_after", "_upto")
    placed = seen.join(metadata.select("sku_id", "family"), "sku_id")
    own = trailing_sales(placed, weeks, ["sku_id", "family", "province"])
    family = trailing_sales(placed, weeks, ["family", "province"]).select("family", "province", "week", F.col("units").alias("fu"))
    everything = trailing_sales(placed, weeks, ["province"]).select("province", "week", F.col("units").alias("gu"))
    family = family.withColumn("family_share", ratio("fu", F.sum("fu").over(Window.partitionBy("family", "week")))).drop("fu")
    family = written(family, "family-shares")  # Spark sees its size, which doesn't grow with the sales
    total = everything.groupBy("week").agg(F.sum("gu").alias("gt"))
    everything = everything.join(F.broadcast(total), "week").select("province", "week", ratio("gu", "gt").alias("global_share"))
    rows = own.join(family, ["family", "province", "week"], "left").join(F.broadcast(everything), ["province", "week"], "left")
    per_week = Window.partitionBy("sku_id", "week")
    rows = rows.withColumns({"n_total": F.sum("units").over(per_week), "n_places": F.count("*").over(per_week)})
    enough = (F.col("units") >= LEAST_UNITS) | (F.col("n_weeks") >= LEAST_WEEKS)
    level = F.when(enough, "sku").when(F.col("family_share").isNotNull(), "family").otherwise("global")
    prior = F.coalesce(F.when(level != "global", F.col("family_share")), F.col("global_share"), F.lit(1.0) / F.col("n_places"))
    rows = rows.withColumns({"level": level, "prior": prior})
    alpha = F.when(F.col("level") == "sku", ALPHA["sku"]).when(F.col("level") == "family", ALPHA["family"]).otherwise(ALPHA["global"])
    rows = rows.withColumn("alpha", alpha).withColumn("weight", (F.col("units") + F.col("alpha") * F.col("prior")) / (F.col("n_total") + F.col("alpha")))
    return rows.select("sku_id", "province", "week", "units", "n_weeks", "n_total", "level", "alpha", "prior", "weight", *(["sold"] if sold else []))


def normalized(shares: DataFrame) -> DataFrame:
    """Shares brought to one per SKU and week."""
    return shares.withColumn("share", ratio("weight", F.sum("weight").over(Window.partitionBy("sku_id", "week"))))


def allocated(shares: DataFrame, national: DataFrame) -> DataFrame:
    """Shares brought to one per SKU and week, and forecasts spread by them."""
    rows = normalized(shares).join(national.select("sku_id", "week", *SPREAD), ["sku_id", "week"])
    return rows.select("sku_id", "week", "province", "level", "share", *((F.col("share") * F.col(c)).alias(c) for c in SPREAD))


def fixed_shares(shares: DataFrame, national: DataFrame) -> DataFrame:
    """Shares by an ordered rule: none without places, one for a single place, raw, prior, equal."""
    per = Window.partitionBy("sku_id", "week")
    rows = shares.withColumns({"n": F.count("*").over(per), "raw": F.sum("weight").over(per), "pri": F.sum("prior").over(per)})
    rule = F.when(F.col("n") == 1, "D_SINGLE").when(F.col("raw") > 0, "A_RAW").when(F.col("pri") > 0, "B_PRIOR").otherwise("C_EQUAL")
    value = F.when(F.col("rule") == "D_SINGLE", 1.0).when(F.col("rule") == "A_RAW", F.col("weight") / F.col("raw")).when(F.col("rule") == "B_PRIOR", F.col("prior") / F.col("pri")).otherwise(1.0 / F.col("n"))
    rows = rows.withColumn("rule", rule).withColumn("share", value).select("sku_id", "week", "province", "rule", "share")
    out = national.select("sku_id", "week").join(rows, ["sku_id", "week"], "left")
    return out.withColumn("rule", F.coalesce("rule", F.lit("E_NONE")))


def reconciliation(parts: DataFrame, national: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """By SKU and week: sums over provinces against the national figures. Without geography: NO_GEO."""
    sums = parts.groupBy("sku_id", "week").agg(F.count("*").alias("places"), F.sum("share").alias("shares"), F.sum("yhat").alias("sum_yhat"), F.sum("q90").alias("sum_q90"))
    rows = national.select("sku_id", "week", "yhat", "q90").join(sums, ["sku_id", "week"], "left")
    fine = (F.abs(F.col("shares") - 1) <= 1e-9) & (F.abs(F.col("sum_yhat") - F.col("yhat")) <= tolerance) & (F.abs(F.col("sum_q90") - F.col("q90")) <= tolerance)
    status = F.when(F.col("places").isNull(), "NO_GEO").when(fine, "PASS").otherwise("FAIL")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("yhat").alias("national"), F.sum("sum_yhat").alias("provincial"))


def historic_shares(geo: DataFrame) -> DataFrame:
    """Share of each SKU's training volume by province, its concentration and rank."""
    rows = geo.where(F.col("week") <= F.lit(SPLITS.train_end).cast("date")).groupBy("sku_id", "province").agg(F.sum("units").alias("units"))
    per = Window.partitionBy("sku_id")
    share = ratio("units", F.sum("units").over(per))
    rows = rows.withColumn("share", share)
    rank = F.row_number().over(per.orderBy(F.desc("units"), "province"))
    return rows.withColumns({"hhi": F.sum(F.col("share") * F.col("share")).over(per), "rank": rank})


def service_tier(p: Column) -> Column:
    return F.when(p >= 0.80, "CRITICAL").when(p >= 0.60, "HIGH").when(p >= 0.40, "MEDIUM").otherwise("LOW")


def national_export(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Forecast, buffers, tier and alert score of each validation row, with the SKU's family."""
    out = rows.where("split = 'VAL'").join(metadata.select("sku_id", "family"), "sku_id", "left")
    score = F.col("p") * F.col("q90")  # rounded once, by the query
    return out.select("sku_id", "week", "family", "yhat", "q80", "q90", "q95", (F.col("q90") - F.col("yhat")).alias("buffer_90"), (F.col("q95") - F.col("yhat")).alias("buffer_95"), service_tier(fixed("p", 9)).alias("tier"), score.alias("score"))


def blind(rows: DataFrame) -> DataFrame:
    """Labels only where the contract lets them be seen."""
    hide = F.col("part") == "LOCKED_TEST"
    return rows.withColumns({c: F.when(~hide, F.col(c)) for c in ("y_12w", "event_12w", "lost_12w")}).select("sku_id", "week", "part", "yhat", "q90", "p", "y_12w", "event_12w", "lost_12w")


def blind_check(hidden: DataFrame) -> DataFrame:
    """PASS if no label of the locked weeks shows and all weeks are within 28 to 40."""
    out = hidden.where("part = 'LOCKED_TEST'").agg(F.count("*").alias("n"), F.count("y_12w").alias("labels"), F.count("event_12w").alias("events"), F.min(F.weekofyear("week")).alias("first_week"), F.max(F.weekofyear("week")).alias("last_week"))
    return out.withColumn("status", F.when((F.col("labels") == 0) & (F.col("events") == 0) & (F.col("first_week") >= 28) & (F.col("last_week") <= 40), "PASS").otherwise("FAIL"))
