"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on at least ``agree`` of
``radius + agree`` blocks of bits, so pairs are sought only among fingerprints with equal keys of
``agree`` blocks: nothing within the radius is missed. Within a key, bit planes are stored vertically
(one row of machine words for each bit of the fingerprint) and the distances from many
fingerprints to all others are counted at once with carry-save counters: a plane at a time, 64
distances a word. Counters start so that they overflow just beyond the radius; rows of words
whose distances have all overflowed are abandoned.

Copies: equal fingerprints are one row before any comparison. Hot keys: rows of a key with more
than ``TILE`` fingerprints are dealt to pairs of tiles, so no task holds an unbounded group, and
each tile gives the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, FEW, WORD, Scratch, bounded_batches, by_runs, few, materialise, numbered, repeated, unused
from .graph import components
from .line_dedup import candidates, leads, overlap, rest_pairs

WORDS = re.compile(WORD)
SEED = 42
TILE = 256
#: Groups of one key are compared together up to so many rows.
PACK = 512


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(ASCII_LOWER))


def shingles(words: list[str], size: int) -> list[str]:
    """Runs of ``size`` words, repeats included; fewer words give the whole sequence, none none."""
    if not words:
        return []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s, SEED) for s in shingles(words, size)), dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def shingle_print(words: list[str], size: int) -> bytes:
    return majority_bits(shingle_hashes(words, size)).to_bytes(8, "big")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (8 bytes) of every row; a text without words has fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "fp": [shingle_print(words_of(t), shingle) for t in b[text]]})

    return bounded_batches(docs).select(key, text).mapInPandas(run, f"`{key}` long, fp binary")


# --- bit-sliced comparison


def bits_of(fps: list[bytes]) -> np.ndarray:
    width = len(fps[0])
    return np.unpackbits(np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(-1, width), axis=1)


def within(bits: np.ndarray, radius: int, rows: slice) -> np.ndarray:
    """Whether each of ``rows`` is within the radius of each fingerprint, as packed little-endian words.

    bits: fingerprints x bit planes, of 0 and 1.
    """
    n, width = bits.shape
    lanes = -(-n // 64)
    padded = np.zeros((width, lanes * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    own = bits[rows]
    flip = own.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)
    q = len(own)
    counters = max(1, int(radius + 1).bit_length() - ((radius + 1) & radius == 0))
    start = (1 << counters) - 1 - radius
    state = [np.full((q, lanes), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> c & 1 else np.uint64(0)) for c in range(counters)]
    over = np.zeros((q, lanes), dtype=np.uint64)
    alive = np.arange(q)
    out = np.full((q, lanes), np.uint64(0xFFFFFFFFFFFFFFFF))
    for p in range(width):
        carry = planes[p][None] ^ flip[alive, p][:, None]
        for c in range(counters):
            state[c], carry = state[c] ^ carry, state[c] & carry
        over |= carry
        if p % 16 == 15:
            open_ = ~(over == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            if not open_.all():
                alive, over, state = alive[open_], over[open_], [s[open_] for s in state]
                if not len(alive):
                    break
    out[alive] = over
    return ~out


def near_pairs(bits: np.ndarray, radius: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one group within the radius, for a block of at most a few hundred rows."""
    n = len(bits)
    near = np.unpackbits(within(bits, radius, slice(0, n)).view(np.uint8), axis=1, bitorder="little", count=n).astype(bool)
    near &= group[:, None] == group[None]
    return np.nonzero(np.triu(near, 1))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def blocks_of(width: int, blocks: int) -> list[tuple[int, int]]:
    edges = [round(width * k / blocks) for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def keyed(prints: DataFrame, radius: int, agree: int) -> DataFrame:
    """``key, id, fp`` for every choice of ``agree`` blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            bits = bits_of(list(b["fp"]))
            spans = blocks_of(bits.shape[1], radius + agree)
            value = [bits[:, s:e].astype(np.int64) @ (1 << np.arange(e - s)[::-1].astype(np.int64)) for s, e in spans]
            for t, chosen in enumerate(combinations(range(len(spans)), agree)):
                mixed = np.zeros(len(b), dtype=np.int64)
                for c in chosen:
                    mixed = (mixed << (spans[c][1] - spans[c][0])) | value[c]
                yield pd.DataFrame({"key": (t << 40) | mixed, "id": b["id"], "fp": b["fp"]})

    return prints.select("id", "fp").mapInPandas(run, "key long, id long, fp binary")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that share their key with others, with the pair of tiles ``lo, hi`` they are compared in."""
    count = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.join(materialise(count, "keys"), "key").withColumn("_tiles", tiles).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return rows.select(*[c for c in rows.columns if c[0] != "_" and c != "n"], F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"))


def compare(rows: DataFrame, radius: int, links: Callable, schema: str) -> DataFrame:
    """Runs ``links(block, i, j, group)`` on blocks of whole groups of ``key, lo, hi``."""
    keys = ["key", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in by_runs(batches, keys):
            group = (whole[keys].ne(whole[keys].shift())).any(axis=1).cumsum().to_numpy()
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(whole))
            at = 0
            while at < len(whole):
                fit = ends[(ends > at) & (ends <= at + PACK)]
                end = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
                block, g = whole.iloc[at:end].reset_index(drop=True), group[at:end]
                i, j = near_pairs(bits_of(list(block["fp"])), radius, g)
                if len(i):
                    yield links(block, i, j, g)
                at = end

    rows = rows.select(*keys, "id", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, schema)


def forest(block: pd.DataFrame, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> pd.DataFrame:
    """One link for each row that isn't the first of its local component."""
    root = roots(len(block), i, j)
    moved = np.flatnonzero(root != np.arange(len(block)))
    ids = block["id"].to_numpy()
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` of ids that connect all fingerprints ``id, fp`` within the radius."""
    return compare(dealt(keyed(prints, radius, 2)), radius, forest, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` of every row.

    Fingerprints link at ``radius`` differing bits or fewer; a component's id is its least key. A
    null text, or one without words, has fingerprint zero, which links like any other. Repeated
    rows each give a row; rows without a key have no component of their own: theirs is that of
    their fingerprint, or null.
    """
    prints = materialise(fingerprints(docs, shingle, key, text), "prints")
    groups = materialise(prints.groupBy("fp").agg(F.min(key).alias("id"), F.count("*").alias("n")), "groups")
    found = components(near_links(groups.where("id is not null"), radius), "a", "b")
    linked = groups.join(found, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("component_id"), F.col("component").isNotNull().alias("linked"))
    shared = materialise(linked.where("n > 1 or linked").select("fp", "component_id"), "shared")
    return prints.join(shared, "fp", "left").select(key, F.lower(F.hex("fp")).alias("fingerprint"), F.coalesce("component_id", key).alias("component_id"))


# --- near-duplicates by similarity, with SimHash to find the pairs

#: Shingles of the similarity and its least value.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: Shingles in the prefixes of more texts are hot; at most so many of them come last in the order of shingles.
HOT, LATE = 200, 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose hashes a task remembers.
REMEMBERED = 150_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def run_hashes(words: list[str], size: int, known: WordHashes) -> np.ndarray:
    """A hash of each shingle, repeats included, from the hashes of its words."""
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    out = np.zeros(max(n, 1) if len(h) else 0, dtype=np.uint64)
    for part in [h[j : j + n] for j in range(size)] if n > 0 else h:
        out = (out ^ (out >> np.uint64(29))) * MIX + part
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether sorted distinct hashes have that Jaccard similarity."""
    if not len(a) or not len(b):
        return not len(a) and not len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def prefix(hashes: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first of sorted distinct hashes in the common order, ``late`` ones last: sets with the similarity share one."""
    n = len(hashes)
    if len(late) and n:
        place = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        hashes = hashes[np.argsort(late[place] == hashes, kind="stable")]
    return hashes[: n - -(-n * 4 // 5) + 1 if n else 0].view(np.int32)


def as_set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint32)


def parity_map(own: np.ndarray) -> int:
    """64 parities of a set's hashes by their last bits, as a signed number: two maps differ in no more bits than the sets in members."""
    return int(np.bitwise_xor.reduce(np.int64(1) << (own & np.uint32(63)).astype(np.int64), initial=np.int64(0)))


def wide_map(own: np.ndarray) -> bytes:
    """The same with two to four bits a member, at least 64; a power of two, so a longer map folds to a shorter one."""
    width = 1 << max(6, (2 * len(own) - 1).bit_length())
    odd = np.bincount(own & np.uint32(width - 1), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide maps differ, at the length of the shorter one: no more than their sets do in members."""
    a, b, long, short = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x), len(y)
    if long < short:
        a, b, long, short = b, a, short, long
    while long > short:
        long //= 2
        a = (a >> 8 * long) ^ (a & ((1 << 8 * long) - 1))
    return (a ^ b).bit_count()


def text_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, whole, fp, b, m, n, s``: a digest of the words in order, fingerprint, and of the distinct shingles a parity map, a wide one, their number and sorted 32-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            out = []
            for d, t in zip(b["id"], b[text], strict=True):
                words = words_of(t)
                hashes = run_hashes(words, SIMILAR_WORDS, known)
                bits = majority_bits(hashes)
                own = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
                out.append((d, xxhash.xxh3_128_digest(" ".join(words)), bits.to_bytes(8, "big"), parity_map(own), wide_map(own), len(own), own.tobytes()))
            yield pd.DataFrame(out, columns=["id", "whole", "fp", "b", "m", "n", "s"])

    return bounded_batches(docs).select(F.col(key).alias("id"), text).mapInPandas(run, "id long, whole binary, fp binary, b long, m binary, n int, s binary")


def hot_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles in the prefixes of about ``HOT`` texts or more, sorted; a task sends those it meets more than twice.

    Only the order of shingles depends on them, and any common order is exact.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                k, c = np.unique(np.concatenate([prefix(as_set(x), np.empty(0, dtype=np.uint32)) for x in b["s"]]), return_counts=True)
                yield pd.DataFrame({"k": k[c > 2], "c": c[c > 2]})

    count = sets.select("s").mapInPandas(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") > HOT)
    return np.sort(np.array([r[0] for r in count.orderBy(F.desc("c"), "k").limit(LATE).select("k").collect()], dtype=np.int32).view(np.uint32))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets have the similarity.

    Wide parity maps, a sixteenth of a set, drop nearly all pairs that aren't alike, and none that are, before the sets themselves are joined.
    """

    def may(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fine = [apart(x, y) <= n + m - 2 * -(-(n + m) * 4 // 9) for x, y, n, m in zip(b["ma"], b["mb"], b["na"], b["nb"], strict=True)]
            yield b.loc[np.array(fine, dtype=bool), ["a", "b"]]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fine = [alike(as_set(x), as_set(y)) for x, y in zip(b["sa"], b["sb"], strict=True)]
            yield b.loc[np.array(fine, dtype=bool), ["a", "b"]]

    def beside(pairs: DataFrame, columns: list[str], name: str) -> DataFrame:
        wanted = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-wanted")
        own = few(sets.select("id", *columns), wanted, "id")
        side = lambda n: own.select(F.col("id").alias(n), *(F.col(c).alias(f"{c}{n}") for c in columns))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    with Scratch(sets.sparkSession) as scratch:
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        close = materialise(beside(pairs, ["n", "m"], "map").mapInPandas(may, "a long, b long"), "near-close")
        return scratch.keep(beside(close, ["s"], "set").mapInPandas(test, "a long, b long"), "near-links")


def with_component(rows: DataFrame, links: DataFrame, id_: str = "id", name: str = "o") -> DataFrame:
    """Rows with the component of their id by the links, the id itself without any."""
    part = materialise(components(links, "a", "b"), "near-parts").select(F.col("id").alias(id_), F.col("component").alias("_c"))
    joined = rows.drop(name).join(F.broadcast(part) if part.count() <= FEW else part, id_, "left")
    return joined.withColumn(name, F.coalesce("_c", id_)).drop("_c")


def _may_be_alike(x: str, y: str) -> Column:
    """Different components, parity maps no further apart than alike sets, and room for the overlap from a shared shingle on."""
    n, m, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}i"), F.col(f"{y}i")
    need = overlap(n, m)
    near = F.bit_count(F.col(f"{x}b").bitwiseXOR(F.col(f"{y}b"))) <= n + m - 2 * need
    return (F.col(f"{x}o") != F.col(f"{y}o")) & (m * 5 >= n * 4) & (n * 5 >= m * 4) & (F.least(n - i, m - j) >= need) & near


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("xd").alias("a"), F.col("yd").alias("b"))


def remaining_links(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Verified links ``a, b`` that connect all alike texts which ``links`` doesn't connect yet.

    An exact prefix join, as for lines: in any common order of shingles, sets with the similarity
    share one of their first n - ceil(0.8 n) + 1, and the first shared one leaves room for the
    overlap. The order is by hash; shingles that many texts share come last, so that a passage
    common to different texts seldom makes pairs. Sizes, places and parity maps sift the pairs before their
    sets are joined; none of them drops a pair that is alike. First one pair of each text is verified, which connects most of a group of copies,
    then those that are still apart.
    """
    late = hot_shingles(sets)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[prefix(as_set(x), late) for x in b["s"]]).drop(columns="s")

    posted = with_component(sets.select("id", "n", "b", "s"), links).mapInPandas(heads, "id long, n int, b long, o long, p array<int>")
    pairs, crowd = candidates(posted.select(F.col("id").alias("d"), F.lit(0).alias("l"), "n", "b", "o", "p"), _may_be_alike, "near-candidates")
    hot = not crowd.isEmpty()
    if hot:
        pairs = pairs.union(leads(crowd, _may_be_alike, "near-leads"))
    pairs = _pairs(pairs)
    out = verified(pairs.groupBy("a").agg(F.min("b").alias("b")), sets)
    links = materialise(links.union(out), "near-linked")
    more = with_component(with_component(pairs, links, "a", "ca"), links, "b", "cb").where("ca <> cb").select("a", "b")
    if hot:
        apart = with_component(crowd.withColumnRenamed("d", "id"), links).withColumnRenamed("id", "d")
        mixed = apart.groupBy("k").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where("lo <> hi").select("k")
        apart = materialise(apart.join(mixed, "k", "left_semi"), "near-apart")
        more = more.union(_pairs(rest_pairs(apart, apart, _may_be_alike)))
    return out.union(verified(more, sets))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``id, whole`` of every row, and ``whole, keep``: the id that stays of each group of texts.

    Texts are alike if their sets of five-word shingles have Jaccard similarity of 0.8 or more,
    or if they have the same words in order. SimHash links (64 bits over the shingles, three bits
    or fewer apart, compared bit-sliced) give the first pairs, an exact prefix join of shingles those
    between texts that are not connected by then; every pair is verified on the sets. Copies are one
    row before that. Shingles are told by 32 bits of their hashes: two texts of n shingles have a
    false common one with odds of n^2 / 2^32.
    """
    with Scratch(docs.sparkSession) as scratch:
        sets = materialise(text_sets(docs, key, text), "text-sets")
        ids = scratch.keep(sets.select("id", "whole"), "text-ids")
        copies = scratch.keep(ids.where("id is not null").groupBy("whole").agg(F.min("id").alias("id")), "text-groups")
        # a repeated row gives its id twice, with equal sets
        own = few(sets.drop("whole").where("n > 0"), copies.select("id"), "id")
        own = scratch.keep(own.dropDuplicates(["id"]) if repeated(ids, "id") else own, "text-own")
    links = verified(near_links(own, 3), own)
    links = materialise(links.union(remaining_links(own, links)), "near-all")
    keep = with_component(copies, links, name="keep").select("whole", "keep")
    return ids, materialise(keep, "near-keep")


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of alike texts, the one with the least key, and all columns.

    Texts without words are one group. Of repeated rows with the least key one stays; a different
    text with a repeated key is a row of its own. Rows without a key stay.
    """
    row = unused(docs, "_row")
    known = numbered(docs.where(F.col(key).isNotNull()), key, text, row)
    with Scratch(docs.sparkSession) as scratch:
        _, keep = similar_groups(known, row, text)
        stays = scratch.keep(keep.select(F.col("keep").alias(row)).distinct(), "near-stays")
    known = few(known, stays, row)
    if repeated(known, row):
        known = known.dropDuplicates([row])
    return known.select(*docs.columns).union(docs.where(F.col(key).isNull()))
