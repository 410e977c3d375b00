import random
import string

from shelfsight.llm.decontaminate import TOLERANCE, Benchmark, fitting_distance, find_leaks, normalised, without_leaks


def slow_fit(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_against_the_matrix():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choices("abé", k=rng.randint(1, 70)))
        text = "".join(rng.choices("abé", k=rng.randint(0, 90)))
        want = slow_fit(item, text)
        assert fitting_distance(item, text, 1000) == want
        assert fitting_distance(item, text, 2) == min(want, 3)


def words(rng, n):
    return ["".join(rng.choices(string.ascii_lowercase[:12], k=min(9, 1 + int(rng.expovariate(0.3))))) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "is"]) for _ in range(n)]


def edit(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        what = rng.randrange(3)
        if what == 0:
            t[at] = rng.choice("xyz ")
        elif what == 1:
            t.insert(at, rng.choice("xyz"))
        elif len(t) > 1:
            del t[at]
    return "".join(t)


def test_recall_and_precision(spark):
    rng = random.Random(2)
    items = [" ".join(words(rng, rng.randint(14, 55))) for _ in range(40)] + ["abc", "two words", "a short one of six words"]
    docs, planted = [], []
    for d in range(500):
        body = words(rng, rng.randint(0, 120))
        if d % 2:
            n = rng.randrange(len(items))
            share = rng.choice([0, 0, 0.03, 0.06, 0.085])
            piece = edit(rng, items[n], int(share * len(items[n])))
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice([[piece], [piece.upper()], ["\n" + piece.replace(" ", "  ")]])
            planted.append((d, n))
        docs.append((d, " ".join(body)))
    want = set()
    lines = [normalised(t) for _, t in docs]
    for d, line in enumerate(lines):
        for n, item in enumerate(items):
            item = normalised(item)
            most = int(TOLERANCE * len(item))
            if len(item) >= 40 and fitting_distance(item, line, most) <= most:
                want.add((d, n))
    extra = [(900, None), (901, ""), (902, "q " * 50000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs + extra], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, " ")], "item_id long, text string")
    for block in (2_000_000, 900):
        rows = find_leaks(df, bench, block_chars=block).collect()
        got = {(r.doc_id, r.item_id) for r in rows}
        assert len(rows) == len(got)
        long = {g for g in got if len(items[g[1]]) >= 40}
        assert long <= want and len(long & want) >= 0.99 * len(want), (len(want - long), len(want))
        short = {p for p in planted if len(items[p[1]]) < 40}
        assert short <= got
        for r in rows:
            assert r.distance == fitting_distance(normalised(items[r.item_id]), lines[r.doc_id], 99)
    clean = {r.doc_id for r in without_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs + extra} - {d for d, _ in got}
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


def test_texts_that_begin_or_end_inside_an_item():
    rng = random.Random(3)
    for _ in range(40):
        item = " ".join(["is", *words(rng, rng.randint(20, 40))])
        most = int(TOLERANCE * len(item))
        bench, rest = Benchmark([(5, item)]), " ".join(words(rng, 30))
        for lost in range(most + 1):
            for text in (item[lost:], item[lost:] + " " + rest, item[: len(item) - lost], rest + " " + item[: len(item) - lost]):
                want = fitting_distance(item, normalised(text), most)
                assert bench.find(text) == ({0: want} if want <= most else {}), (lost, want)


def test_edits_that_leave_no_pair_of_words():
    rng = random.Random(4)
    items = [" ".join(words(rng, rng.randint(14, 55))) for _ in range(30)] + ["ab", "abcd", "abcdefghi", "klmn opqrst uv", "漢字仮名交じり文" * 3, "漢字仮名交じり文" * 15]
    lines = [normalised(t) for t in items]
    bench = Benchmark(list(enumerate(items)))
    met = 0
    for line in lines:
        w = line.split()
        around = "".join(rng.choices("qrz", k=40))
        second = " ".join(x if k % 2 else x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for k, x in enumerate(w))
        joined = "".join(x + ("" if k % 2 else " ") for k, x in enumerate(w)).strip()
        spread = list(line)
        for k in range(4, 10 * (len(line) // 10), 10):
            spread[k] = "#"
        for text in (second, joined, "".join(spread), line):
            for whole in (text, around + text + around, "x " * 49990 + around + text + around):
                whole = normalised(whole)
                want = {n: fitting_distance(x, whole, len(x) // 10) for n, x in enumerate(lines)} if len(whole) < 9000 else None
                got = bench.find(whole)
                if want is None:
                    assert set(seen) <= set(got)
                else:
                    seen = {n: d for n, d in want.items() if d <= len(lines[n]) // 10}
                    assert got == seen
                    met += len(seen)
    assert met > 200
