"""Ranks and running sums of large groups: no task holds a whole group.

Rows are dealt out by ranges of (group, order) and written, so a group lies in several partitions
one after the other. Sums by partition and group are a small table (a row for each partition and group
that meet), whose running sums say where a partition starts; within a partition an ordinary
window does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.stages import written

PART, BEFORE, HERE = "_part", "_before", "_here"


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"{prefix}{c}"]) for c in columns), F.lit(True))


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows of the group up to this one, itself included."""
    return running_sums(rows, by, order, {name: amount}, parts)


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amounts: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with a running sum for each of ``amounts`` in one order; the rows are dealt out and written once.

    order: must tell any two rows of a group apart, or their sums are exchanged. Null groups are
    groups; a null amount counts as zero. parts: number of ranges, else Spark's setting.
    """
    own = rows.withColumns({f"{HERE}_{n}": F.coalesce(a, F.lit(0)) for n, a in amounts.items()})
    keys = [*by, *order] or [F.lit(0)]
    dealt = own.repartitionByRange(parts, *keys) if parts else own.repartitionByRange(*keys)
    dealt = written(dealt.withColumn(PART, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, PART).agg(*(F.sum(f"{HERE}_{n}").alias(f"_sum_{n}") for n in amounts))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_g_{c}") for c in by), F.col(PART).alias("_range"), *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"{BEFORE}_{n}") for n in amounts))
    within = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({n: F.sum(f"{HERE}_{n}").over(within) for n in amounts})
    both = local.join(starts, _same(local, starts, by, "_g_") & (local[PART] == starts["_range"]))
    return both.select(*rows.columns, *((F.col(n) + F.col(f"{BEFORE}_{n}")).alias(n) for n in amounts))


#: Ranges that a pass of ``reached`` tells apart, and how many rows are ranked at last.
RANGES, FEW = 1024, 100_000


def reached(rows: DataFrame, order: dict[str, bool], amount: Column, at: int, parts: int | None = None) -> Row | None:
    """The row at which the running sum of ``amount`` (whole, not below zero) comes to ``at``, with ``_amount`` and ``_upto``; none if it never does.

    order: columns, true where they fall; the first is a number, all of them tell rows apart. Sums by ranges of the first say in which
    range the row lies, pass by pass, so only the rows of a narrow range or of one tied value are moved and ranked.
    """
    first = next(iter(order))
    key = (-F.col(first) if order[first] else F.col(first)).cast("double")
    own = rows.select(*order, F.coalesce(amount, F.lit(0)).cast("long").alias("_amount")).where("_amount > 0").withColumn("_key", key)
    figures = [F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"), F.sum("_amount").alias("sum")]
    here = own.agg(*figures, F.count_if(F.coalesce(F.isnan("_key") | F.isnan(F.col("_key") - F.col("_key")), F.lit(True))).alias("odd")).first()
    if at < 1 or (here["sum"] or 0) < at:
        return None
    before, left, odd = 0, own, here["odd"]
    while not odd and here["n"] > FEW and here["low"] < here["high"]:
        step = F.least(F.floor((F.col("_key") - here["low"]) / (here["high"] - here["low"]) * RANGES), F.lit(RANGES - 1))
        for here in sorted(left.groupBy(step.alias("_step")).agg(*figures).collect(), key=lambda r: r["_step"]):
            if before + here["sum"] >= at:
                break
            before += here["sum"]
        left = own.where(F.col("_key").between(here["low"], here["high"]))
    by = [F.desc(c) if falls else F.asc(c) for c, falls in order.items()]
    placed = running_sum(left.drop("_key"), [], by, F.col("_amount"), "_upto", parts).withColumn("_upto", F.col("_upto") + before)
    return placed.where((F.col("_upto") >= at) & (F.col("_upto") - F.col("_amount") < at)).first()


def is_before(row: Row, order: dict[str, bool]) -> Column:
    """Whether a row comes before the given one."""
    out = F.lit(False)
    for c, falls in reversed(order.items()):
        out = (F.col(c) > row[c] if falls else F.col(c) < row[c]) | ((F.col(c) == row[c]) & out)
    return out


def is_same(row: Row, order: dict[str, bool]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(c) == row[c] for c in order))


def row_numbers(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their number in the group, from 1, as ``row_number`` gives; ``order`` must tell rows apart."""
    return running_sum(rows, by, order, F.lit(1).cast("long"), name, parts)


def tiles(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their tile of ``k``, as ``ntile`` gives: the first ones are larger by one row."""
    numbered = row_numbers(rows, by, order, "_nr", parts)
    size = rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_g_{c}") for c in by), "_n")
    both = numbered.join(size, _same(numbered, size, by, "_g_"))
    q, more, at = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_nr") - 1
    long = more * (q + 1)
    tile = F.when(at < long, F.floor(at / (q + 1))).otherwise(more + F.floor((at - long) / F.greatest(q, F.lit(1))))
    return both.select(*rows.columns, (tile + 1).cast("int").alias(name))


def percent_ranks(rows: DataFrame, by: Sequence[str], values: dict[str, Column], parts: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values``: its share of lower ranks in the group, as ``percent_rank`` gives, nulls lowest.

    Ties count as one row of the value's table, so a value that most rows have is one row as well;
    all columns are ranked in one pass over their distinct values. whole: the rows that ``rows`` are some
    of; all others count as lower than any of these.
    """
    named = rows.withColumns({f"_v_{n}": v.cast("double") for n, v in values.items()})
    long = named.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(f"_v_{n}").alias("_value")) for n in values))).alias("_s")).select(*by, "_s._name", "_s._value")
    counts = long.groupBy(*by, "_name", "_value").agg(F.count("*").alias("_count"))
    upto = running_sum(counts, [*by, "_name"], [F.asc_nulls_first("_value")], F.col("_count"), "_upto", parts)
    size = (rows if whole is None else whole).groupBy(*by).agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_s_{c}") for c in by), "_n")
    lower = F.col("_upto") - F.col("_count")
    if whole is not None:
        given = counts.groupBy(*by, "_name").agg(F.sum("_count").alias("_given")).select(*(F.col(c).alias(f"_t_{c}") for c in [*by, "_name"]), "_given")
        upto = upto.join(given, _same(upto, given, [*by, "_name"], "_t_"))
        lower = lower + F.col("_n") - F.col("_given")
    share = upto.join(size, _same(upto, size, by, "_s_")).select(*by, "_name", "_value", F.when(F.col("_n") > 1, lower / (F.col("_n") - 1)).otherwise(0.0).alias("_share"))
    share = written(share, "shares")
    out = named
    for n in values:
        own = share.where(F.col("_name") == n).select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_value").alias(f"_k_value_{n}"), F.col("_share").alias(n))
        kept = [*out.columns]
        out = out.join(own, _same(out, own, by, "_k_") & out[f"_v_{n}"].eqNullSafe(own[f"_k_value_{n}"])).select(*kept, n)
    return out.select(*rows.columns, *values)


#: Accuracy of the sketches that bracket a quantile, and how far to either side the bracket reaches, as a share of the rows.
SKETCH, REACH = 10_000, 3e-4


def quantiles(rows: DataFrame, by: Sequence[str], picks: dict[str, tuple[str, float]], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """A row for each group: ``n``, its rows, and a column for each of ``picks``: the value of rank ceil(p n) among a column's non-null values.

    picks: column and percent by name. sets: grouping sets, told apart by ``_set``; a column that a set lacks is null.
    Exact for groups of any size: sketches bracket each quantile, then rows below a bracket are counted and
    those within it (less than a thousandth, ties as one) are ranked. Without groups there is always one row.
    """
    columns = [*dict.fromkeys(c for c, _ in picks.values())]
    own = rows.select(*by, *(F.col(c).cast("double").alias(f"_v_{c}") for c in columns))
    keys = [*by]
    if sets is not None:
        own = own.withColumn("_set", F.explode(F.array(*map(F.lit, range(len(sets))))))
        within = lambda c: F.col("_set").isin([i for i, s in enumerate(sets) if c in s])
        own = own.withColumns({c: F.when(within(c), F.col(c)) for c in by})
        keys = ["_set", *by]
    ends = {c: [F.lit(min(max(p / 100 + d, 0.0), 1.0)) for a, p in picks.values() if a == c for d in (-REACH, REACH)] for c in columns}
    first = own.groupBy(*keys).agg(*(F.count(f"_v_{c}").alias(f"_n_{c}") for c in columns), *(F.percentile_approx(f"_v_{c}", F.array(*ends[c]), F.lit(SKETCH)).alias(f"_q_{c}") for c in columns))
    marks, met = [], dict.fromkeys(columns, 0)
    for i, (c, p) in enumerate(picks.values()):
        rank = F.greatest(F.expr(f"(`_n_{c}` * {round(p * 1000)} + 99999) div 100000"), F.lit(1))
        marks += [rank.alias(f"_rank_{i}"), F.get(f"_q_{c}", F.lit(met[c])).alias(f"_low_{i}"), F.get(f"_q_{c}", F.lit(met[c] + 1)).alias(f"_high_{i}")]
        met[c] += 2
    known = first.select(*(F.col(k).alias(f"_g_{k}") for k in keys), *marks)
    # a level of -1 counts the group's rows; a null value stands for all rows below the bracket
    level = lambda i, rank, at, ok: F.struct(F.lit(i).alias("_level"), rank.alias("_rank"), at.alias("_at"), ok.alias("_ok"))
    each = [level(-1, F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(True))]
    each += [level(i, F.col(f"_rank_{i}"), F.when(F.col(f"_v_{c}") >= F.col(f"_low_{i}"), F.col(f"_v_{c}")), F.col(f"_v_{c}") <= F.col(f"_high_{i}")) for i, (c, _) in enumerate(picks.values())]
    hits = own.join(F.broadcast(known), _same(own, known, keys, "_g_")).select(*keys, F.explode(F.array(*each)).alias("_h")).where("_h._ok")
    counts = hits.groupBy(*keys, *(F.col(f"_h.{c}").alias(c) for c in ("_level", "_rank", "_at"))).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_level").orderBy(F.asc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto)
    here = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))
    found = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_level") == -1, F.col("_c"))), F.lit(0)).alias("n"),
        *(F.max(F.when((F.col("_level") == i) & here, F.col("_at"))).alias(f"_x_{i}") for i in range(len(picks))), *(F.max(F.when(F.col("_level") == i, 1)).alias(f"_y_{i}") for i in range(len(picks))),
    )
    value = lambda i: F.when(F.col(f"_y_{i}") == 1, F.coalesce(f"_x_{i}", F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
    return found.select(*keys, "n", *(value(i).alias(n) for i, n in enumerate(picks)))


def with_quantiles(groups: DataFrame, rows: DataFrame, by: Sequence[str], picks: dict[str, tuple[str, float]]) -> DataFrame:
    """``groups``, a row each, with the quantiles of their ``rows``."""
    found = quantiles(rows, by, picks)
    found = found.select(*(F.col(c).alias(f"_g_{c}") for c in by), *picks)
    return groups.join(F.broadcast(found), _same(groups, found, by, "_g_"), "left").select(*groups.columns, *picks)
