"""Dense SKU x week panel, customer and value metrics, lags, rolling statistics, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..config import DEMAND_LAGS, HORIZON, SPLITS, VIP_CUSTOMERS, Splits
from ..functions.columns import fixed, iso_week, iso_year, monday, positive, ratio, season_group
from .ranks import quantiles, tiles


def by_sku() -> WindowSpec:
    return Window.partitionBy("sku_id").orderBy("week")


def dense_spine(sales: DataFrame, splits: Splits = SPLITS) -> DataFrame:
    """Every SKU in every week, zeros where nothing sold; returns are left out.

    Days are summed up first, so that distinct days are counted as rows, and dealt by SKU once; each
    week with lines is followed by the weeks without any up to the next one.
    """
    first, last = F.lit(splits.start).cast("date"), F.date_add(F.lit(splits.start).cast("date"), F.floor(F.datediff(F.lit(splits.end).cast("date"), F.lit(splits.start).cast("date")) / 7).cast("int") * 7)
    units, sold = F.col("units"), F.col("units") >= 0
    daily = sales.where("sku_id is not null").groupBy("sku_id", "date").agg(F.sum(F.when(sold, units)).alias("y"), F.max(F.when(sold, (units > 0).cast("int"))).alias("up")).repartition("sku_id")
    # a week outside the calendar only says that there is such a SKU
    week = monday("date")
    inside = week.between(first, last) & (F.datediff(week, first) % 7 == 0)
    of = lambda c: F.when(inside, c)
    weekly = daily.groupBy("sku_id", F.coalesce(of(week), first).alias("_from")).agg(
        F.sum(of(F.col("y"))).alias("y"), F.count(of(F.col("up"))).alias("days_active"), F.count_if(inside & (F.col("up") == 1)).alias("days_nonzero")
    )
    order = Window.partitionBy("sku_id").orderBy("_from")
    begin = F.when(F.row_number().over(order) == 1, first).otherwise(F.col("_from"))
    end = F.coalesce(F.date_sub(F.lead("_from").over(order), 7), last)
    spans = weekly.withColumns({"_begin": begin, "_end": end})
    rows = spans.withColumn("week", F.explode(F.sequence("_begin", "_end", F.expr("interval 7 day"))))
    here = F.col("week") == F.col("_from")
    zero = lambda c: F.when(here, F.col(c)).otherwise(F.lit(0)).alias(c)
    return rows.select("sku_id", "week", iso_year("week").alias("iso_year"), iso_week("week").alias("iso_week"), F.coalesce(F.when(here, F.col("y")), F.lit(0.0)).alias("y"), zero("days_active"), zero("days_nonzero"))


def sku_customer_sales(fact: DataFrame) -> DataFrame:
    return fact.groupBy("sku_id", monday("date").alias("week"), "customer_id").agg(
        F.sum(positive(F.col("units"))).alias("units"), F.sum("base_amount").alias("base"),
        ratio(F.sum(F.col("unit_price") * positive(F.col("units"))), F.sum(positive(F.col("units")))).alias("price"), F.countDistinct("date").alias("days"),
    )


def vip_customers(fact: DataFrame, most: int = VIP_CUSTOMERS, splits: Splits = SPLITS) -> DataFrame:
    """Customers of the ``most`` largest totals before the validation weeks, ties included."""
    total = fact.where(F.col("date") <= F.lit(splits.calib_end).cast("date")).groupBy("customer_id").agg(fixed(F.sum("base_amount"), 4).alias("total")).where("total > 0")
    # the rank needs only rows down to the last total that counts
    cut = F.broadcast(total.select("total").distinct().orderBy(F.desc("total")).limit(most).agg(F.min("total").alias("cut")))
    top = total.join(cut, F.col("total") >= F.col("cut")).drop("cut")
    return top.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("total"))))


def customer_concentration(fact: DataFrame) -> DataFrame:
    """Customers, VIPs, largest shares and the Herfindahl index of each SKU and week."""
    rows = sku_customer_sales(fact).join(vip_customers(fact).select("customer_id", F.lit(1).alias("vip")), "customer_id", "left")
    sums = rows.groupBy("sku_id", "week").agg(
        F.count("*").alias("customers"), F.sum(F.coalesce("vip", F.lit(0))).alias("vips"), F.sum("units").alias("u"), F.sum("base").alias("b"),
        F.max("units").alias("top_u"), F.max("base").alias("top_b"), F.sum(F.col("units") * F.col("units")).alias("uu"),
    )
    return sums.select(
        "sku_id", "week", "customers", "vips", (F.col("vips") > 0).cast("int").alias("has_vip"),
        ratio("top_u", "u").alias("top_share_units"), ratio("top_b", "b").alias("top_share_base"), ratio(F.col("uu"), F.col("u") * F.col("u")).alias("hhi"),
    )


def value_metrics(fact: DataFrame) -> DataFrame:
    sold = fact.where("units > 0")
    out = sold.groupBy("sku_id", monday("date").alias("week")).agg(
        F.sum("base_amount").alias("base"), F.avg("unit_price").alias("mean_price"), ratio(F.sum(F.col("unit_price") * F.col("units")), F.sum("units")).alias("weighted_price"),
        F.sum(F.when((ratio(F.col("unit_price") * F.col("units"), "base_amount") > 5) | (ratio(F.col("base_amount"), F.col("unit_price") * F.col("units")) > 5), 1).otherwise(0)).alias("discrepancies"),
    )
    return out


def _before(weeks: int) -> WindowSpec:
    return by_sku().rowsBetween(-weeks, -1)


def _std(weeks: int) -> Column:
    return fixed(F.stddev_samp("y").over(_before(weeks)), 9)


def features(panel: DataFrame, splits: Splits = SPLITS) -> DataFrame:
    """Lags, rolling means and deviations, frequencies, harmonics, ratios, proxy and its lags.

    All windows share one partitioning and order, so the panel is shuffled once. Frequencies are
    divided by the frame's full length in early weeks too.
    """
    mean = lambda k: F.avg("y").over(_before(k))
    out = panel.withColumns({f"lag_{k}": F.lag("y", k).over(by_sku()) for k in DEMAND_LAGS})
    out = out.withColumns({f"mean_{k}": mean(k) for k in (4, 8, 12, 13)} | {f"std_{k}": _std(k) for k in (4, 12, 13)})
    hits = lambda c, k: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(_before(k)), F.lit(0))
    out = out.withColumns({
        "sold_before": F.coalesce(F.max((F.col("y") > 0).cast("int")).over(by_sku().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "sale_freq_12w": hits(F.col("y") > 0, 12) / 12.0,
        "zero_share_13w": hits(F.col("y") == 0, 13) / 13.0,
        "zero_share_26w": hits(F.col("y") == 0, 26) / 26.0,
    })
    angle = F.col("iso_week") * (2 * F.pi() / 52)
    out = out.withColumns({f"{n}_{k}": f(angle * k) for k in (1, 2, 3) for n, f in (("sin", F.sin), ("cos", F.cos))})
    cv = lambda k: F.coalesce(fixed(ratio(f"std_{k}", f"mean_{k}"), 9), F.lit(0.0))
    out = out.withColumns({
        "season_group": season_group(F.col("iso_week")), "cv_4w": cv(4), "cv_12w": cv(12), "cv_13w": cv(13),
        "amplitude": F.coalesce("mean_13", F.lit(0.0)), "lag1_rel": F.coalesce(ratio("lag_1", "mean_13"), F.lit(1.0)),
        "weeks_since_start": F.datediff("week", F.lit(splits.start).cast("date")) / 7,
    })
    busy = (F.col("sale_freq_12w") > 0.25) | (F.coalesce("mean_4", F.lit(0.0)) > 5) | (F.coalesce("lag_1", F.lit(0.0)) > 5) | (F.coalesce("mean_13", F.lit(0.0)) > 5)
    out = out.withColumn("oos_proxy", F.when((F.col("y") == 0) & (F.col("sold_before") == 1) & busy, 1).otherwise(0))
    return out.withColumns({f"oos_lag_{k}": F.coalesce(F.lag("oos_proxy", k).over(by_sku()), F.lit(0)) for k in (1, 2, 4)})


def forward_labels(feats: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Labels of the ``horizon`` weeks after each week; the panel has no gaps, so rows are weeks."""
    ahead = by_sku().rowsBetween(1, horizon)
    base = F.coalesce("mean_12", "mean_13", "mean_4", F.lit(0.0))
    lost = F.when(F.col("oos_proxy") == 1, positive(base - F.col("y"))).otherwise(0.0)
    return feats.withColumns({
        "n_future": F.count("*").over(ahead), "y_12w": F.sum("y").over(ahead), "event_12w": F.max("oos_proxy").over(ahead),
        "oos_weeks_12w": F.sum("oos_proxy").over(ahead), "lost_12w": F.sum(lost).over(ahead),
    })


def closed_labels(labelled: DataFrame, horizon: int = HORIZON, spans: tuple[int, ...] = (4, 8, 13)) -> DataFrame:
    """Rolling mean, deviation and zero share of labels whose window had closed before each week.

    The label of week t - 13 covers the weeks up to t - 1; later ones are still open and aren't looked at.
    """
    y = F.when(F.col("n_future") == horizon, F.col("y_12w"))
    frame = lambda k: by_sku().rowsBetween(-(horizon + k), -(horizon + 1))
    out = {}
    for k in spans:
        w = frame(k)
        zeros = F.sum(F.when(y == 0, 1).when(y.isNotNull(), 0)).over(w)
        out |= {f"label_mean_{k}": F.avg(y).over(w), f"label_std_{k}": fixed(F.stddev_samp(y).over(w), 9), f"label_zero_{k}": ratio(zeros, F.count(y).over(w))}
    return labelled.select("sku_id", "week", *(v.alias(n) for n, v in out.items()))


def split_of(week: Column, splits: Splits = SPLITS) -> Column:
    d = lambda s: F.lit(s).cast("date")
    return F.when(week <= d(splits.train_end), "TRAIN").when(week <= d(splits.calib_end), "CALIB").when(week.between(d(splits.val_start), d(splits.val_end)), "VAL")


def demand_cuts(rows: DataFrame) -> DataFrame:
    """Cut points between deciles of amplitude by season, from the training weeks only."""
    cuts = {f"_{k}": ("amplitude", 10 * k) for k in range(1, 10)}
    return quantiles(rows.where("split = 'TRAIN'"), ["season_group"], cuts).select("season_group", F.array(*cuts).alias("cuts"))


def split_rows(labelled: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows with a whole label window and a split."""
    return labelled.where(F.col("n_future") == horizon).withColumn("split", split_of(F.col("week"))).where("split is not null")


def with_deciles(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with a split get their demand decile; cuts: two rows."""
    decile = F.lit(1) + F.size(F.filter("cuts", lambda c: F.col("amplitude") > c))
    return rows.join(F.broadcast(cuts), "season_group").withColumn("decile", decile).drop("cuts")


def train_calib_split(labelled: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows with a whole label window and a split, and their demand decile."""
    rows = split_rows(labelled, horizon)
    return with_deciles(rows, demand_cuts(rows))


def market_lags(panel: DataFrame, values: DataFrame, customers: DataFrame, splits: Splits = SPLITS) -> DataFrame:
    """Lags of value, price and customers of each SKU and week, the price's change, and the share of the span that has passed.

    Weeks without sales have no price and no customers, so their lags are null.
    """
    keys = ["sku_id", "week"]
    rows = panel.select(*keys).join(values.select(*keys, "base", F.col("mean_price").alias("price")), keys, "left").join(customers.select(*keys, "customers", "top_share_base", "hhi", "has_vip"), keys, "left")
    lag = lambda c, k: F.lag(c, k).over(by_sku())
    lags = {f"{n}_lag_{k}": lag(n, k) for n in ("base", "price") for k in (1, 4, 12, 13)} | {f"{n}_lag_{k}": lag(n, k) for n in ("customers", "top_share_base", "hhi", "has_vip") for k in (1, 4)}
    days = F.datediff("week", F.lit(splits.start).cast("date"))
    out = rows.withColumns(lags).withColumns({"price_change_1w": ratio("price", "price_lag_1") - 1, "life": ratio(days, F.datediff(F.lit(splits.end).cast("date"), F.lit(splits.start).cast("date")))})
    return out.select(*keys, *lags, "price_change_1w", "life")


def pooled_deciles(labelled: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Deciles by rank over all splits of a season, as older reports have them: they see later weeks, so no model uses them."""
    return tiles(split_rows(labelled, horizon), ["season_group"], [F.asc("amplitude"), F.asc("sku_id"), F.asc("week")], 10, "decile_pooled")
