import random
import re

from shelfsight.llm.licenses import KEYWORDS, PHRASES, RULES, scan_licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    line = " " + " ".join(words) + " "
    named = {k for k in KEYWORDS if f" {k} " in line}
    hits = [(m.start(), m.end(), n, r) for n, r in enumerate(RULES) if r.keyword in named for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", line)]

    def beats(b, a):
        lb, la = b[1] - b[0], a[1] - a[0]
        return b[0] <= a[0] and b[1] >= a[1] and (b[3].priority > a[3].priority or b[3].priority == a[3].priority and (lb > la or lb == la and b[2] < a[2]))

    kept = [a for a in hits if not any(beats(b, a) for b in hits)]
    base_labels = sorted({x[1] for x in base})
    labels = sorted({h[3].label for h in kept} | set(base_labels))
    score = 1.0
    for label in labels:
        score *= 1 - max([h[3].weight for h in kept if h[3].label == label] + [0.6] * (label in base_labels))
    at = [x[0] for x in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), 1 - score


def test_rules_compile_and_are_hundreds():
    assert len(RULES) >= 200
    for r in RULES:
        re.compile(r.pattern)


def test_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "cc by", "CC-BY", "General Public License", "GNU Lesser General Public License v3", "version 3 or later", "Copyright (c) 2001", "copyright 2001-2004", "mit", "reserved", "é", "ß中", "\U0001f600", "\n", "x", "all rights", "public domain", "SPDX-License-Identifier: MIT License", "license", "for non-commercial use only"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(200)] + [None, "", "...", "cc", "by cc", "cc by" * 3, "cc by " * 500]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c")], "doc_id long, text string, labels string")
    got = scan_licenses(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:7] == want[:6], texts[r.doc_id]
        assert abs(r.score - want[6]) < 1e-9
    assert scan_licenses(df.limit(0)).count() == 0


def any_match(rng, parsed):
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            kind, what = rng.choice(arg)
            out.append({"LITERAL": lambda: chr(what), "RANGE": lambda: chr(rng.randint(*what)), "CATEGORY": lambda: "7"}[str(kind)]())
        elif name == "BRANCH":
            out.append(any_match(rng, rng.choice(arg[1])))
        elif name == "SUBPATTERN":
            out.append(any_match(rng, arg[-1]))
        else:
            assert name == "MAX_REPEAT", name
            least, most, part = arg
            out += [any_match(rng, part) for _ in range(rng.randint(least, min(most, least + 2)))]
    return "".join(out)


def test_every_match_contains_the_keyword():
    rng = random.Random(9)
    for r in RULES:
        for _ in range(40):
            text = any_match(rng, re._parser.parse(r.pattern))
            assert re.fullmatch(r.pattern, text) and r.keyword in text.split(), (r, text)


def test_names_without_their_short_form(spark):
    texts = {"Licensed under the Open Software License 3.0": "osl-3.0", "under the Expat license": "mit", "for noncommercial use only": "non-commercial", "Neither the name of X nor the names of its contributors": "bsd"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in scan_licenses(df).collect()}
    assert all(label in got[i] for i, label in enumerate(texts.values())), got
