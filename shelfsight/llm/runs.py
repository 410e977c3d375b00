"""Periodic runs of words: maximal stretches that repeat with a period, four times or more.

A run of period p is a stretch whose words p apart are equal, with smallest period p, at least
``max(LEAST, TIMES * p)`` words long, that no neighbouring word extends.

Its words i with w[i] = w[i + p] are a stretch of 3p or more, so three neighbours of the grid 0,
p, 2p, ... lie in it. All periods are probed on their grids: word jp against word (j + 1)p. Small
periods are walked period by period, large ones place by place (word jp for all p is a slice of
the text with stride j), so a text of n words takes about 2 sqrt(n) array comparisons and n log n
probes. Where three probes in a row hold, some words between them are tested too; survivors are
extended both ways by comparing chunks that double.

Periods go upwards. Grid points within a run that was found with the same period, or with a
period that divides this one, are skipped: there the stretch is no run of this period, since its
smallest period is less. Runs of other periods hide nothing: two runs of periods d and p overlap
by less than d + p words, which a test pair inside a run of a dividing period would exceed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, unused, whole_text

#: A run has at least six words and four periods.
LEAST, TIMES = 6, 4
#: Words compared at once when a stretch is extended: the first and the largest chunk.
CHUNK, LARGEST = 16, 1 << 16
#: Probes of large periods that are held at once.
PROBES = 1 << 20


def _reach(w: np.ndarray, p: int, at: int) -> int:
    """The first place from ``at`` whose word differs from the one ``p`` later, or the last possible place."""
    end, size = len(w) - p, CHUNK
    while at < end:
        stop = min(at + size, end)
        same = w[at:stop] == w[at + p : stop + p]
        k = int(same.argmin())
        if not same[k]:
            return at + k
        at, size = stop, min(2 * size, LARGEST)
    return end


def _back(w: np.ndarray, p: int, at: int) -> int:
    """The first place of the stretch of words equal to the ones ``p`` later that ends with ``at``."""
    size = CHUNK
    while at > 0:
        start = max(at - size, 0)
        same = (w[start:at] == w[start + p : at + p])[::-1]
        k = int(same.argmin())
        if not same[k]:
            return at - k
        at, size = start, min(2 * size, LARGEST)
    return 0


def _between(w: np.ndarray, p: np.ndarray | int, g: np.ndarray) -> np.ndarray:
    """Whether words between three probes that hold are equal to those one period later too, as in a stretch they must be."""
    same = w[g + 1] == w[g + 1 + p]
    for off in (p // 2, p + p // 2, 2 * p - 1):
        same &= w[g + off] == w[g + off + p]
    return same


def _survivors(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each period, upwards, with the grid points from which three probes in a row hold."""
    n = len(w)
    root = min(isqrt(n), n // TIMES)
    for p in range(1, root + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
        if len(at):
            at = at[_between(w, p, at)]
        if len(at):
            yield p, at
    # periods above the root, a block of them at once for each place j of the grid: words jp are a strided slice
    low = root + 1
    while low <= n // TIMES:
        high = min(low + max(1, PROBES * low // n), n // TIMES)
        periods, places = [], []
        for j in range((n - 1) // low - 2):
            p = np.arange(low, min((n - 1) // (j + 3), high) + 1)
            words = [w[k * low : k * int(p[-1]) + 1 : k] if k else np.broadcast_to(w[0], len(p)) for k in range(j, j + 4)]
            same = words[0] == words[1]
            if same.any():
                hit = p[same & (words[1] == words[2]) & (words[2] == words[3])]
                hit = hit[_between(w, hit, j * hit)]
                if len(hit):
                    periods.append(hit)
                    places.append(j * hit)
        low = high + 1
        if not periods:
            continue
        p, g = np.concatenate(periods), np.concatenate(places)
        order = np.lexsort((g, p))
        p, g = p[order], g[order]
        cuts = np.flatnonzero(np.diff(p, prepend=0)).tolist()
        for k, stop in zip(cuts, [*cuts[1:], len(p)], strict=True):
            yield int(p[k]), g[k:stop]


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of an integer array, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    if len(w) < LEAST:
        return runs
    cover: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # starts and ends of the runs of a period, and its longest
    for p, grid in _survivors(w):
        for d, (starts, ends, longest) in cover.items():
            if longest > p and p % d == 0:
                k = np.searchsorted(starts, grid, "right") - 1
                grid = grid[(k < 0) | (ends[k] <= grid + p)]
        done, found = -1, []
        for g in grid.tolist():
            if g < done:
                continue
            done = _reach(w, p, g)
            start = _back(w, p, g)
            if done + p - start >= max(LEAST, TIMES * p):
                found.append((start, done + p - start, p))
        if found:
            starts = np.array([r[0] for r in found])
            ends = np.array([r[0] + r[1] for r in found])
            cover[p] = starts, ends, int((ends - starts).max())
            runs += found
    return sorted(runs, key=lambda r: (r[0], r[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number = {word: k for k, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs array<struct<start, length, period>>, collapsed`` of every row.

    Words are what ASCII white space separates, compared as they stand; runs come by start, then
    period; ``collapsed`` is the text's words without repeats, joined by one space. A null or empty
    text has no words, no runs and an empty ``collapsed``. Repeated rows each give a row; other
    columns are left out, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"n_words": [], "runs": [], "collapsed": []}
            for x in b[text]:
                words = x.encode().split()  # of bytes: splits at ASCII white space only
                runs = find_runs(word_numbers(words))
                if runs:
                    words_left = [words[i] for i in np.flatnonzero(without_repeats(len(words), runs))]
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                out["collapsed"].append(b" ".join(words_left if runs else words).decode())
            yield pd.DataFrame({key: b[key], **out})

    kind = docs.schema[key].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(key), whole_text(F.col(text)).alias(text))
    return rows.mapInPandas(run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_text(key: Column, text: Column) -> Column:
    """The text, where a tenth of the keys get a repeated tail.

    With h the CRC-32 of the key in decimal, g = floor(h / 10), n words: where h % 10 = 0, word
    i >= a becomes word a + (i - a) % p for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Texts without words and rows without a key stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    planted = F.get(F.transform(F.array(words), tail), F.lit(0))
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), planted).otherwise(text)


def run_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and the digests of runs and collapsed text."""
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = unused(docs, "_best")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = docs.withColumn(best, longest)
    return top.select(
        key,
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col(best)["start"]).alias("start"),
        F.col(best)["length"].alias("length"),
        (-F.col(best)["period"]).alias("period"),
        F.floor(F.lit(1000) * F.col(best)["length"] / -F.col(best)["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
        "n_words",
    )
