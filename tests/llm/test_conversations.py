import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from shelfsight.llm.conversations import Layers, damaged, repair, repair_report

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_edits(turns):
    """Cheapest (cost, audit) by a search that carries whole audit strings and up to three inserts in a row."""
    need, after = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state):
        def ends(state, k):
            if state in ("", "a"):
                yield 5 * k, "I" * k
            elif k < 3:
                yield from ends(after[state], k + 1)

        if i == len(turns):
            return min(ends(state, 0))
        initial, fault = turns[i]
        more = 5 if fault == 3 else 0
        options, s = [], state
        for k in range(4):
            moves = [(2, "D", s)]
            if fault not in (1, 2):
                moves.append((1 + more, "R", after[s]))
                if initial == need[s]:
                    moves.append((more, "K", after[s]))
                if initial == "s" and s == "" and not k:
                    moves.append((more, "K", "s"))
            for cost, edit, to in moves:
                c, a = best(i + 1, to)
                options.append((5 * k + cost + c, "I" * k + edit + a))
            s = after[s]
        return min(options)

    return best(0, "")


def plain(rows):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = plain_edits(tuple(zip(initials, faults, strict=True)))
        lines, state, rest = [], "", iter(own)
        for edit in audit:
            need = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if edit == "I":
                lines.append(f"{need}:")
                state = need[0]
                continue
            _, role, text = next(rest)
            if edit != "D":
                own_role = role if edit == "K" else need
                lines.append(f"{own_role}:{text}")
                state = own_role[0]
        assert GOOD.fullmatch("".join(line[0] for line in lines))
        turns = [r[0] for r in own if r[0] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations(rng, n):
    rows = []
    texts = ["Yes.", "No", "", " \t", "Why?", "a\x1c", " ", "Well!  \n", "x. y", "é", None]
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            row = conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"]), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."
            if row[1] is None and any(r[0] == conv and r[1] is None and r[2] == row[2] for r in rows):
                continue
            rows += [row] * rng.choice([1, 1, 1, 1, 2, 3])
    return rows


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_against_the_contract(spark):
    rng = random.Random(5)
    rows = conversations(rng, 250)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit(7)).withColumn("copies", F.lit("x"))
    want = plain(rows)
    assert got(repair_report(damaged(df))) == want
    assert got(repair_report(damaged(df), parts=40)) == want  # conversations lie across partitions


def test_long_conversation_in_many_partitions(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Same.", "open", "", f"t{t}."])) for t in range(900)]
    rows += [(2, 5, "user", "Again.")] * 400 + [(3, 2**40, "user", "Only.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for parts in (1, 7, 60):
        assert got(repair_report(damaged(df), parts=parts)) == want
    pieces = repair(damaged(df), parts=7).where("c = '1'").orderBy("piece").collect()
    assert len(pieces) > 3
    assert "".join(p.audit for p in pieces) == want[1][6]
    assert hashlib.sha256("\n".join(p.repaired for p in pieces if p.n_lines).encode()).hexdigest() == want[1][7]


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = got(repair_report(damaged(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_report(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_whole_audits_against_layers():
    rng, layers = random.Random(7), Layers()
    for _ in range(3000):
        turns = tuple((rng.choice("ssuuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14)))
        from shelfsight.llm.conversations import ENDS, best_end, symbol

        marks = "".join(symbol(*t) for t in turns)
        total, layer = layers.through(marks, 0)
        end = best_end(layer)
        assert (total + layer[end][0] + 5 * len(ENDS[end]), "".join(layers.macros(marks, 0, end)) + ENDS[end]) == plain_edits(turns)
    assert len(layers.known) < 3000  # few layers, however long the conversations
