import random

import numpy as np
import xxhash

from shelfsight.llm.graph import components
from shelfsight.llm.simhash import WORDS, apart, bits_of, near_pairs, parity_map, roots, simhash_groups, wide_map, within


def union(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def brute_print(text, k):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_bit_slices_count_exactly():
    rng = np.random.default_rng(1)
    for n, radius, width in ((1, 3, 8), (70, 3, 8), (200, 0, 8), (130, 7, 16), (90, 12, 16), (64, 1, 8)):
        base = rng.integers(0, 256, (n, width), dtype=np.uint8)
        base[n // 2 :] = base[0]
        flips = rng.integers(0, width * 8, (n, 6))
        for r in range(n):
            for f in flips[r, : rng.integers(0, 7)]:
                base[r, f // 8] ^= 1 << f % 8
        bits = bits_of([x.tobytes() for x in base])
        want = (bits[:, None] != bits[None]).sum(axis=2) <= radius
        got = np.unpackbits(within(bits, radius, slice(0, n)).view(np.uint8), axis=1, bitorder="little", count=n).astype(bool)
        assert (got == want).all()
        i, j = near_pairs(bits, radius, np.arange(n) % 2)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(n) for b in range(a + 1, n) if want[a, b] and a % 2 == b % 2}
        assert roots(n, i, j).tolist() == union(n, zip(i, j, strict=True))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 260), rng.randint(100, 260)) for _ in range(120)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    want = {i: r for i, r in enumerate(union(600, pairs)) if any(i in p and p[0] != p[1] for p in pairs)}
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "é", "THE", "the"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    for _ in range(240):
        words = rng.choice(texts).split(" ")
        if rng.random() < 0.8 and len(words) > 3:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [None, "", " \n", "x", "X", "long " * 30000]
    rows = [(i * 3 % 1009, t, "z") for i, t in enumerate(texts)]
    got = simhash_groups(spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, fp string")).collect()
    prints = [brute_print(t, 3) for _, t, _ in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    want = sorted((d, f"{p:016x}", least[r]) for (d, _, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted({tuple(r) for r in got}) == want and len(got) == len(rows) + 1
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parity_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for _ in range(800):
        a = np.unique(rng.integers(0, 2**32, int(rng.integers(1, 900)), dtype=np.uint32))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**32, int(rng.integers(1, 300)), dtype=np.uint32)]))
        d = len(np.setxor1d(a, b))
        assert apart(wide_map(a), wide_map(b)) == apart(wide_map(b), wide_map(a)) <= d
        assert (parity_map(a) ^ parity_map(b)).__and__((1 << 64) - 1).bit_count() <= d
