"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts and items are lower-cased with single spaces. A text holds an item if some part of it is
within ``TOLERANCE`` of the item's length in edit distance.

1. Item-sized windows. An item of m characters is cut into floor(m / q) pieces of q; each edit spoils
   one at most, so floor(m / q) - edits of them stand in the text unchanged, their places shifted
   against each other by no more than the edits. Runs of q characters at all offsets of a text are
   looked up; where so many pieces of an item stand within such a band, each of them aligns a
   window of the item's size, from the piece to the item's end and back to its beginning. No
   occurrence is without its windows, with or without words and blanks.
2. CGK embedding. Window and item go through the same random walk, which turns edit distance into
   Hamming distance: at each step the character under the pointer is written, and a random bit of
   step and character says whether the pointer moves. Walks run forward and backward from the piece.
3. Bit-sampling LSH. A sample is a few steps of a walk, near the piece or spread over the window;
   a window that agrees with its item on all steps of one of ``REPEATS`` samples is a candidate.
   Several windows and samples meet each occurrence; the recall that results is measured in the
   tests for random, even and clustered edits up to the tolerance (target: 0.99).
4. Candidates are verified by the exact edit distance between the item and the best part of the
   text around.

One pass over the texts, no shuffle. Items travel to the tasks in blocks of ``block_chars``
characters; a larger benchmark takes one pass a block. Offsets are worked off in slices, so memory
is bounded for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TOLERANCE = 0.1
#: Steps of a walk in each direction, samples (half of them forward), steps of a sample.
STEPS, REPEATS, SAMPLED = 96, 16, 4
#: A sample's steps lie within so many of the piece's end, by turns.
SPANS = (12, 24, 48, 78)
#: Windows of items of fewer characters are verified at once: a walk over them has too few steps to sample.
SHORT = 64
BLOCK_CHARS = 2_000_000
#: Length of pieces for items of at least so many and of fewer than so many characters; it leaves one piece or more beyond the edits.
PIECES = ((8, 80, 1 << 31), (5, 10, 80), (4, 4, 10))
#: Offsets of a text at which pieces are looked up together.
OFFSETS = 50_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xC2B2AE3D27D4EB4F))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def run_keys(text: np.ndarray, q: int) -> np.ndarray:
    """A key for each run of q characters, 4, 5 or 8."""
    if len(text) < q:
        return np.empty(0, dtype=np.uint64)
    c = text.astype(np.uint64)
    two = c[:-1] * MIX[0] + c[1:]
    out = two[:-2] * MIX[1] + two[2:]
    if q == 5:
        out = out[:-1] * MIX[2] + c[4:]
    elif q == 8:
        out = out[:-4] * MIX[2] + out[4:]
    return out * MIX[3]


class Walk:
    """The random walk and its samples; the same for all texts and items."""

    def __init__(self, q: int, seed: int = 1):
        rng = np.random.default_rng([seed, q])
        self.moves = rng.integers(0, 2, (STEPS, 256)).astype(np.int64)
        first = 2 * q
        spans = [min(SPANS[r // 2 % len(SPANS)], STEPS - first) for r in range(REPEATS)]
        samples = [first + rng.choice(span, SAMPLED, replace=False) for span in spans]
        self.at_step = [[[r for r in range(way, REPEATS, 2) if t in samples[r]] for t in range(STEPS)] for way in range(2)]

    def agree(self, text: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, q: int) -> np.ndarray:
        """Which windows agree with their item on all steps of one sample.

        at, place: where the piece begins in the text and in the joined items; first, last: the item's
        ends there. Steps beyond an item's ends agree with nothing.
        """
        text, item = np.pad(text, (STEPS + 1, STEPS + q + 1)), np.pad(item, (STEPS + 1, STEPS + q + 1))
        out = np.zeros(len(at), dtype=bool)
        for way, step in ((0, 1), (1, -1)):
            lead = 0 if step > 0 else q - 1
            p, r = at + STEPS + 1 + lead, place + STEPS + 1 + lead
            fine = np.ones((REPEATS, len(at)), dtype=bool)
            for t in range(STEPS):
                a, b = text[p], item[r]
                if here := self.at_step[way][t]:
                    same = (a == b) & (r - STEPS - 1 >= first) & (r - STEPS - 1 < last)
                    fine[here] &= same
                p, r = p + step * self.moves[t][a & 255], r + step * self.moves[t][b & 255]
            out |= fine[way::2].any(axis=0)
        return out


class Pieces:
    """Windows of some items, aligned on their pieces of ``q`` characters."""

    def __init__(self, q: int, items: list[tuple[int, str, int]]):
        self.q, self.walk = q, Walk(q)
        keys = [run_keys(codes(t), q)[::q] for _, t, _ in items]
        self.joined = codes("".join(t for _, t, _ in items))
        ends = np.cumsum([len(t) for _, t, _ in items])
        per = list(map(len, keys))
        self.keys = np.concatenate(keys)
        self.owner = np.repeat(np.array([n for n, _, _ in items], dtype=np.int64), per)
        self.offset = np.concatenate([np.arange(len(k)) * q for k in keys])
        self.first, self.last = np.repeat(ends - [len(t) for _, t, _ in items], per), np.repeat(ends, per)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner, self.offset, self.first, self.last = (x[order] for x in (self.keys, self.owner, self.offset, self.first, self.last))
        self.most, self.need = np.zeros(items[-1][0] + 1, dtype=np.int64), np.ones(items[-1][0] + 1, dtype=np.int64)
        for (n, _, most), k in zip(items, keys, strict=True):
            self.most[n], self.need[n] = most, len(k) - most
        self.overlap = max(len(t) + 2 * most for _, t, most in items)
        self.shift = np.uint64(64 - max(16, min(24, (8 * len(self.keys)).bit_length())))
        self.maybe = np.zeros(1 << 64 - int(self.shift), dtype=bool)
        self.maybe[self.keys >> self.shift] = True

    def windows(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of pieces, and their numbers, that stand in a band with enough others."""
        h = run_keys(text, self.q)
        at = np.flatnonzero(self.maybe[h >> self.shift])
        h = h[at]
        low = np.searchsorted(self.keys, h)
        many = np.searchsorted(self.keys, h, side="right") - low
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        n, start = self.owner[entry], at - self.offset[entry]
        order = np.lexsort((start, n))
        n, start, at, entry = n[order], start[order], at[order], entry[order]
        place = np.arange(len(n))
        last = place + self.need[n] - 1
        inside = np.minimum(last, len(n) - 1)
        begins = (last < len(n)) & (n[inside] == n) & (start[inside] - start <= self.most[n])
        # all pieces of such a band align a window
        cover = np.zeros(len(n) + 1, dtype=np.int64)
        np.add.at(cover, place[begins], 1)
        np.add.at(cover, last[begins] + 1, -1)
        held = np.cumsum(cover[:-1]) > 0
        return at[held], entry[held]

    def candidates(self, text: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (item, supposed start in the text)."""
        out: set[tuple[int, int]] = set()
        for s in range(0, len(text), OFFSETS):
            part = text[s : s + OFFSETS + self.overlap]
            at, entry = self.windows(part)
            if not len(at):
                continue
            first, last = self.first[entry], self.last[entry]
            keep = (last - first < SHORT) | self.walk.agree(part, at, self.joined, first + self.offset[entry], first, last, self.q)
            out.update(zip(self.owner[entry[keep]].tolist(), (at[keep] + s - self.offset[entry[keep]]).tolist(), strict=True))
        return out


def fitting_distance(item: str, text: str, most: int) -> int:
    """Least edit distance between the item and any part of the text; ``most + 1`` if it is more.

    Bit-parallel dynamic programming over the columns of the distance matrix.
    """
    m = len(item)
    mask, high = (1 << m) - 1, 1 << m - 1
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & mask, plus & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best = score
    return min(best, most + 1)


class Benchmark:
    """Windows and exact distances of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        named = [(item_id, line) for item_id, text in items if (line := normalised(text))]
        self.ids, self.texts = [i for i, _ in named], [t for _, t in named]
        self.most = [int(TOLERANCE * len(t)) for t in self.texts]
        self.pieces = []
        for q, least, below in PIECES:
            if chosen := [(n, t, self.most[n]) for n, t in enumerate(self.texts) if least <= len(t) < below]:
                self.pieces.append(Pieces(q, chosen))
        self.tiny = [(n, t) for n, t in enumerate(self.texts) if len(t) < PIECES[-1][1]]

    def candidates(self, line: str) -> set[tuple[int, int]]:
        """Pairs (item, supposed start of the item in the normalised text); items of up to three characters stand as they are."""
        text = codes(line)
        out = {(n, line.index(t)) for n, t in self.tiny if t in line}
        for pieces in self.pieces:
            out |= pieces.candidates(text)
        return out

    def find(self, text: str | None) -> dict[int, int]:
        """Least edit distance of each item that the text holds, by the item's number."""
        line = normalised(text)
        out: dict[int, int] = {}
        done: dict[int, int] = {}
        for n, at in sorted(self.candidates(line)):
            item, most = self.texts[n], self.most[n]
            if out.get(n) == 0 or at < done.get(n, at):
                continue
            end = at + len(item) + 2 * most
            done[n] = at + max(1, most)
            if line.startswith(item, max(0, at)):
                out[n] = 0
                continue
            # the supposed start is off by as many characters as were added or lost before the piece
            d = fitting_distance(item, line[max(0, at - 2 * most) : end + max(1, most)], most)
            if d <= most:
                out[n] = min(d, out.get(n, d))
        return out


def _blocks(items: DataFrame, item: str, text: str, block_chars: int) -> Iterator[Benchmark]:
    part, size = [], 0
    for r in items.where(F.col(text).isNotNull()).select(item, text).distinct().orderBy(item, text).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield Benchmark(part)
            part, size = [], 0
    if part:
        yield Benchmark(part)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, item, distance`` of every item that a row's text holds, with the least edit distance.

    Null and empty texts hold nothing, null and empty items are held by nothing; of rows with one
    id each gives its own rows. Items with one id and several texts count as several. Other
    columns are left out.
    """
    schema = f"`{key}` long, `{item}` long, distance int"
    out = docs.sparkSession.createDataFrame([], schema)
    for bench in _blocks(items, item, "text", block_chars):

        def run(batches: Iterator[pd.DataFrame], bench=bench) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, bench.ids[n], x) for d, t in zip(b[key], b[text], strict=True) for n, x in bench.find(t).items()]
                yield pd.DataFrame(rows, columns=[key, item, "distance"])

        out = out.union(bounded_batches(docs).select(key, text).mapInPandas(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all columns."""
    for bench in _blocks(items, item, "text", block_chars):
        docs = bounded_batches(docs).where(~holds_any(bench)(F.col(text)))
    return docs


def holds_any(bench: Benchmark):
    """A column function of a text column: whether it holds any item of the block."""

    @F.pandas_udf("boolean")
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([bool(bench.find(t)) for t in texts], dtype=bool)

    return leaks
