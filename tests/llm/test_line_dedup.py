import random

from shelfsight.llm.line_dedup import line_report, remove_repeated_lines, repeated_lines


def sets_of(text):
    return [set(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line.lower()) if w) for line in (text or "").split("\n")]


def brute(rows):
    lines = sorted({(d, n): s for d, t in rows for n, s in enumerate(sets_of(t))}.items(), key=lambda x: x[0])
    gone = {}
    for at, (place, s) in enumerate(lines):
        if s and any(t and 5 * len(s & t) >= 4 * len(s | t) for _, t in lines[:at]):
            gone.setdefault(place[0], []).append(place[1])
    return {d: (len(t), ",".join(map(str, sorted(gone.get(d, []))))) for d, t in {d: sets_of(t) for d, t in rows}.items()}


def make(rng, n):
    words = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(400)] + ["É", "é", "The", "the"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n // 2)]
    hot = "one hot line that very many documents hold with one word of it changed here and there again".split()
    out = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "\t", "  "]).join(line))
        if rng.random() < 0.6:
            h = hot.copy()
            for _ in range(rng.choice([1, 1, 1, 2, 4])):
                h[rng.randrange(len(h))] = "v%d" % rng.randrange(500)
            lines.append(" ".join(h))
        out.append((d * 7 % 1009, "\n".join(lines)))
    return out


def test_against_brute_force(spark):
    rows = [*make(random.Random(1), 220), (2000, None), (2001, ""), (2002, "\n\n"), (2003, "a b c d"), (2004, "d c b a e"), (2005, "x " * 20000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in [*rows, rows[3]]], "doc_id long, text string, l int")
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_report(df).collect()}
    want = brute(rows)
    assert got == want
    assert sum(len(w[1]) > 0 for w in want.values()) > 100
    cleaned = {r.doc_id: r.text for r in remove_repeated_lines(df).collect()}
    for d, t in rows:
        gone = set(want[d][1].split(","))
        assert cleaned[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in gone))


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_report(none).count() == 0 and remove_repeated_lines(none).count() == 0
    df = spark.createDataFrame([(None, "a b c\nq"), (1, "A  b c"), (None, "z")], "doc_id long, text string")
    assert sorted((r.d, r.l) for r in repeated_lines(df)[1].collect()) == [((1 << 63) - 1, 0)]


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    a, b, c, d, e = ("one two three", "four five six", "seven eight nine", "ten eleven twelve", "p q r")
    rows = [(1, f"{a}\n{b}", 0), (None, f"{c}\n{a}", 1), (None, f"{d}\nclean words here", 2), (1, f"{e}\n{e}", 3), (1, "s t u\nv w x", 4), (None, None, 5)]
    got = {r.n: r.text for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert got == {0: f"{a}\n{b}", 1: c, 2: f"{d}\nclean words here", 3: e, 4: "s t u\nv w x", 5: None}


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c\nq", 7, "x", "d", 9), (1, "z", 8, "y", "d", 9), (2, "c b a\nr", 9, None, "e", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _gone string, _d string, _h1 int")
    got = sorted(map(tuple, remove_repeated_lines(df).collect()))
    assert got == [(1, "a b c\nq", 7, "x", "d", 9), (1, "z", 8, "y", "d", 9), (2, "r", 9, None, "e", 9)]
