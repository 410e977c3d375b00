"""URL filters: a sort-merge range join of page addresses with nested host rules.

A host's labels in reverse order make every rule's host an interval of keys: ``example.org``
covers all keys from ``org.example.`` up to the last one with that prefix. Pages and rules are
dealt out together by ranges of their keys: a page goes to its range, a rule to every range that
its interval meets, so that each range begins with the rules that are still open there. Rows of a
range are sorted, a rule before the keys it covers; a sweep keeps a stack of the rules whose
intervals hold the current key. Intervals are nested or disjoint, so the stack is exact.

Hot hosts: a range's bounds also hold the path and the page, so one host may fill many ranges.
Only as many rules of different hosts as a host has labels cross a bound, so copies of rules are
few. Bounds come from about ``PER_RANGE`` sampled keys a range; they decide who does the work, and
nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

#: verdict, host, path
Rule = tuple[str, str, str]
#: Sampled keys of a range.
PER_RANGE = 20
#: Follows every character of a key.
LAST = "\U0010ffff" * 4


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_after(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _after(url: Column) -> Column:
    at = F.instr(whole_text(url), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_key(host: Column) -> Column:
    """``a.example.org`` becomes ``org.example.a.``"""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


class Sweep:
    """The rules whose host intervals hold the current key, outermost first."""

    def __init__(self):
        self.range, self.stack = None, []

    def move(self, range_: int, key: str) -> None:
        """To a key that isn't before the last one of its range."""
        if range_ != self.range:
            self.range, self.stack = range_, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, text: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, []))
        self.stack[-1][1].append((len(text), path, text, verdict))

    def best(self, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits; of two alike, ``block`` wins."""
        fit = [(n, verdict, text) for _, found in self.stack for n, start, text, verdict in found if path.startswith(start)]
        return max(fit, key=lambda x: x[:2])[1:][::-1] if fit else (None, None)


def bounds(rows: DataFrame, ranges: int) -> list[tuple]:
    """Least ``_k, path, _id`` of each range but the first, from a sample by hash."""
    n = rows.count()
    share = min(1.0, PER_RANGE * ranges / max(1, n))
    place = F.pmod(F.xxhash64("_k", "path", "_id"), F.lit(1 << 20)) / float(1 << 20)
    got = sorted(tuple(r) for r in rows.where(place < share).select("_k", "path", F.coalesce("_id", F.lit(""))).collect())
    return [got[i] for i in sorted({len(got) * r // ranges for r in range(1, ranges)})] if got else []


def range_of(bound: list[tuple], k: Column, path: Column, id_: Column) -> Column:
    """Number of bounds at or before a place."""
    if not bound:
        return F.lit(0)
    here = F.struct(k.alias("a"), path.alias("b"), F.coalesce(id_, F.lit("")).alias("c"))
    at = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in bound))
    return F.size(F.filter(at, lambda b: b <= here))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row; ``default`` where no rule fits.

    Null or odd addresses have an empty host and path and get the default, unless a rule has an
    empty host. Repeated rows each give a row; other columns are left out; no rules or no rows
    are fine. Rules with a null part fit nothing.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    kind = pages.schema[key].dataType
    rows = pages.select(F.col(key).cast("string").alias("_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("_k", host_key(F.col("host")))
    bound = bounds(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(range_of(bound, F.col("_k"), F.col("path"), F.col("_id")).alias("_r"), "_k", F.lit(1).alias("_kind"), "path", "_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    own = rules.where("verdict is not null and host is not null and path is not null").withColumn("_k", host_key(F.col("host")))
    none = F.lit("")
    met = F.sequence(range_of(bound, F.col("_k"), none, none), range_of(bound, F.concat("_k", F.lit(LAST)), none, none))
    own = own.select(F.explode(met).alias("_r"), "_k", F.lit(0).alias("_kind"), "path", none.alias("_id"), "host", F.concat("host", "path").alias("rule"), "verdict")
    both = rows.union(own).repartition("_r").sortWithinPartitions("_r", "_k", "_kind", "path")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = Sweep()
        for batch in batches:
            found = []
            for r, k, kind, path, id_, host, rule, verdict in zip(*(batch[c] for c in ("_r", "_k", "_kind", "path", "_id", "host", "rule", "verdict")), strict=True):
                at.move(r, k)
                if kind:
                    found.append((id_, host, path, *at.best(path)))
                else:
                    at.open(k, path, rule, verdict)
            yield pd.DataFrame(found, columns=["_id", "host", "path", "rule", "verdict"], dtype=object)

    out = both.mapInPandas(sweep, "_id string, host string, path string, rule string, verdict string")
    return out.select(F.col("_id").cast(kind).alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
