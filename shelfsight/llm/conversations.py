"""Conversation structure repair: the cheapest edits that make the turns of each conversation alternate.

Turns are kept (K, cost 0), re-roled to user or assistant (R, 1), deleted (D, 2; blank turns and
repeats of an earlier turn must go), and empty turns are inserted (I, 5); a truncated turn that
stays adds 5. The initials of the roles left must be ``(s?(ua)+)?``. Of the cheapest edits the
ones whose initials come first in ASCII order are taken.

Dynamic programme. A layer stands for the turns so far and holds, for each of the four states of
the pattern (nothing yet, after s, after u, after a), the cheapest cost and the rank of its audit
string among the layer's. A turn takes one macro edit, a run of inserts and the turn's own edit:
D, ID, IK, IR, K or R, in that order. These codes are prefix-free, so audit strings of a layer
compare by their first different macro, and (rank before, place of the macro) orders them: no
string is kept. A run of two inserts never pays: it comes back to its state, or leads from the
start to a state that needs nothing more than the start did. Costs count from the cheapest state's, and
a state that costs ``FAR`` more can't win (any state does what another does for 15 more, at most), so there are a
few hundred layers: each is worked out once a task and found again in a table. Audit strings come
from parent pointers afterwards.

Size. Turns are sorted by range over (conversation, turn, role, hash of role and text), so a long conversation lies in
several partitions. The programme is associative: a portion of a conversation is summed up by
cost and rank from each state to each, portions are combined (as many rows as partitions, for any
conversation), and then each portion, now with its first and last state, is repaired on its own.
Equal rows are one row with a count before they are sorted; the first of equal turns is
found by an aggregation. A task holds one portion, never a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RETYPE, DELETE, INSERT, MEND = 1, 2, 5, 5
#: States of the pattern, the role that may follow each, and the state after it.
START, SYSTEM, USER, DONE = range(4)
NEEDS, NEXT = ("u", "u", "a", "u"), (USER, USER, DONE, USER)
#: Macro edits in ASCII order.
MACROS = ("D", "ID", "IK", "IR", "K", "R")
#: Edits after the last turn.
ENDS = {START: "", SYSTEM: "II", USER: "I", DONE: ""}
FAR = 20
#: Rows and characters of a long conversation that travel as one row.
CHUNK_ROWS, CHUNK_CHARS = 10_000, 1 << 20

#: cost and rank of each state, or None where it can't be or can't win
Layer = tuple[tuple[int, int] | None, ...]


def symbol(initial: str, fault: int) -> str:
    """What the programme sees of a turn: ``-`` must go, else its role's initial (``?`` for others), upper case if truncated."""
    if fault in (BLANK, DUPLICATE):
        return "-"
    own = initial if initial and initial in "sua" else "?"
    return own if fault != TRUNCATED else "!" if own == "?" else own.upper()


def _moves(mark: str, state: int) -> Iterator[tuple[int, int, int]]:
    """Place of the macro, its cost and the state after it, for a turn in a state."""
    after = NEXT[state]
    yield 0, DELETE, state
    yield 1, INSERT + DELETE, after
    if mark == "-":
        return
    own, more = mark.lower(), MEND if mark.isupper() or mark == "!" else 0
    if own == NEEDS[after]:
        yield 2, INSERT + more, NEXT[after]
    yield 3, INSERT + RETYPE + more, NEXT[after]
    if own == NEEDS[state]:
        yield 4, more, after
    elif own == "s" and state == START:
        yield 4, more, SYSTEM
    yield 5, RETYPE + more, after


def _ranked(best: dict[int, tuple[int, tuple]]) -> tuple[int, Layer]:
    """Lowest cost, and the layer of states that have a cost and a key that orders their audit strings."""
    low = min(cost for cost, _ in best.values())
    kept = {s: (cost - low, key) for s, (cost, key) in best.items() if cost - low <= FAR}
    rank = {s: k for k, s in enumerate(sorted(kept, key=lambda s: kept[s][1]))}
    return low, tuple((kept[s][0], rank[s]) if s in kept else None for s in range(4))


class Layers:
    """Layers that were worked out, by the layer before and the turn."""

    def __init__(self):
        self.known: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}

    def step(self, layer: Layer, mark: str) -> tuple[Layer, int, tuple]:
        """The next layer, what its cheapest state costs more, and each state's parent: (state, macro)."""
        found = self.known.get((layer, mark))
        if found is None:
            best: dict[int, tuple[int, tuple]] = {}
            for state, held in enumerate(layer):
                if held is not None:
                    for macro, cost, to in _moves(mark, state):
                        new = held[0] + cost, (held[1], macro, state)
                        if to not in best or new < best[to]:
                            best[to] = new
            low, after = _ranked(best)
            parents = tuple((best[s][1][2], best[s][1][1]) if after[s] else None for s in range(4))
            found = self.known[layer, mark] = after, low, parents
        return found

    def through(self, marks: str, entry: int) -> tuple[int, Layer]:
        """Cost of the cheapest state and the layer after the marks, from one state."""
        layer, total = _alone(entry), 0
        for mark in marks:
            layer, more, _ = self.step(layer, mark)
            total += more
        return total, layer

    def macros(self, marks: str, entry: int, exit_: int) -> list[str]:
        """The macro of each mark on the best way from one state to another."""
        layer, parents = _alone(entry), []
        for mark in marks:
            layer, _, back = self.step(layer, mark)
            parents.append(back)
        out = []
        for back in reversed(parents):
            exit_, macro = back[exit_]
            out.append(MACROS[macro])
        return out[::-1]


def _alone(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def best_end(layer: Layer) -> int:
    """The state from which the conversation ends best."""
    return min((held[0] + INSERT * len(ENDS[s]), held[1], s) for s, held in enumerate(layer) if held is not None)[2]


def apply(state: int, macros: Iterable[str], roles: list[str], texts: list[str]) -> tuple[int, list[str]]:
    """The state after the macros and the repaired turns, as ``role:text``."""
    lines = []
    for macro, role, text in zip(macros, roles, texts, strict=True):
        for edit in macro:
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                lines.append(f"{role}:{text}")
                state = SYSTEM
                continue
            own = role if edit == "K" else ROLES[NEEDS[state]]
            lines.append(f"{own}:{'' if edit == 'I' else text}")
            state = NEXT[state]
    return state, lines


def end_lines(state: int) -> list[str]:
    """The turns inserted after the last one."""
    out = []
    for _ in ENDS[state]:
        out.append(f"{ROLES[NEEDS[state]]}:")
        state = NEXT[state]
    return out


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns damaged by CRC-32 of ``key:turn`` modulo 20, with the column ``copies`` (0: the turn is gone, 2: it repeats).

    0 drops the turn, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's.
    Null ids and turns count as one space in the sum, null roles and texts become one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(key), F.lit(":"), space("turn")).cast("binary")) % 20
    return rows.select(
        F.col(key),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _fault(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)


def _sorted_turns(turns: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Turns and marks of first turns, sorted by range; equal rows are one row with their number."""
    rows = turns.select(
        F.col(key).cast("string").alias("c"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"),
        F.col("role").alias("role"), F.col("text").alias("text"), F.col("copies").alias("copies"),
    )
    gone = F.col("copies") == 0
    rows = rows.select("c", *(F.when(gone, F.lit(z)).otherwise(F.col(c)).alias(c) for c, z in (("timed", False), ("turn", 0), ("role", ""), ("text", ""))), "copies")
    hashes = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1))}
    whole = rows.groupBy("c", "timed", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns(hashes | {"fault": _fault(F.col("text")), "row": F.lit(1)})
    live = rows.where("copies > 0").select("c", "timed", "turn", "role", *(h.alias(n) for n, h in hashes.items()))
    firsts = live.groupBy("c", "role", "h1", "h2").agg(F.min("timed").alias("timed"), F.min(F.when(F.col("timed"), F.col("turn"))).alias("turn"))
    marks = firsts.select("c", "timed", F.when(F.col("timed"), F.col("turn")).otherwise(0).alias("turn"), "role", "h1", "h2", F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("fault"), F.lit(0).alias("row"))
    both = whole.unionByName(marks)
    order = ["c", "timed", "turn", "role", "h1", "h2"]
    dealt = both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order, "row").select("c", "timed", "turn", "role", "text", "copies", "fault", "row")


class Portion:
    """The rows of one conversation in one partition."""

    def __init__(self, key: str | None):
        self.key, self.roles, self.texts, self.faults = key, [], [], []
        self.low = self.high = None
        self.n_turns = 0
        self.mark = None

    def add(self, timed: bool, turn: int, role: str, text: str, copies: int, fault: int, row: int) -> None:
        if not row:
            self.mark = timed, turn, role
            return
        if not copies:
            return
        first, self.mark = self.mark == (timed, turn, role), None
        if timed and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.n_turns += 1
        again = BLANK if fault == BLANK else DUPLICATE
        self.roles += [role] * copies
        self.texts += [text] * copies
        self.faults += [fault if first else again] + [again] * (copies - 1)

    def record(self, part: int) -> dict:
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = {n: self.faults.count(f) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        return {"c": self.key, "part": part, "n_rows": len(self.roles), "low": self.low, "high": self.high, "n_turns": self.n_turns, **counts, "illegal": illegal,
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "marks": "".join(map(symbol, initials, self.faults))}


PORTION = (
    "c string, part int, n_rows long, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, marks string, "
    "chunk int, done boolean, cost long, audit string, repaired string, roles array<string>, texts array<string>, costs array<long>, ranks array<int>"
)
FIELDS = [f.split()[0] for f in PORTION.split(", ")]


def _finished(portion: Portion, layers: Layers, part: int) -> dict:
    """A conversation that lies in one partition, repaired."""
    row = portion.record(part)
    total, layer = layers.through(row["marks"], START)
    end = best_end(layer)
    macros = layers.macros(row["marks"], START, end)
    state, lines = apply(START, macros, portion.roles, portion.texts)
    return row | {"chunk": 0, "done": True, "cost": total + layer[end][0] + INSERT * len(ENDS[end]), "audit": "".join(macros) + ENDS[end], "repaired": "\n".join(lines + end_lines(state)), "marks": None}


def _open(portion: Portion, layers: Layers, part: int) -> Iterator[dict]:
    """A portion whose conversation may go on elsewhere: its sums, and its rows in chunks."""
    row = portion.record(part)
    costs, ranks = [], []
    for entry in range(4):
        total, layer = layers.through(row["marks"], entry)
        costs += [None if held is None else total + held[0] for held in layer]
        ranks += [None if held is None else held[1] for held in layer]
    at, chunk = 0, 0
    while not chunk or at < len(portion.roles):
        stop, chars = at, 0
        while stop < len(portion.roles) and stop - at < CHUNK_ROWS and (chars < CHUNK_CHARS):
            chars += len(portion.texts[stop])
            stop += 1
        sums = row | {"costs": costs, "ranks": ranks} if not chunk else {"c": row["c"], "part": part}
        yield sums | {"chunk": chunk, "done": False, "roles": portion.roles[at:stop], "texts": portion.texts[at:stop]}
        at, chunk = stop, chunk + 1


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    layers, part = Layers(), TaskContext.get().partitionId()
    portion, edge = None, True
    frame = lambda rows: pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in FIELDS})
    for b in batches:
        out = []
        for c, *row in zip(*(b[x] for x in ("c", "timed", "turn", "role", "text", "copies", "fault", "row")), strict=True):
            if portion is None or c != portion.key:
                if portion is not None and edge:
                    out += _open(portion, layers, part)
                    edge = False
                elif portion is not None:
                    out.append(_finished(portion, layers, part))
                portion = Portion(c)
            portion.add(*row)
        if out:
            yield frame(out)
    if portion is not None:
        yield frame(list(_open(portion, layers, part)))


WAY = "c string, part int, entry int, exit int, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _way(rows: pd.DataFrame) -> pd.DataFrame:
    """First and last state of every portion of one conversation, and the conversation's figures beside its first portion."""
    rows = rows.sort_values("part")
    sums = rows.to_dict("records")
    layer, total, parents = _alone(START), 0, []
    illegal, n_turns, last, high = 0, 0, None, None
    for p in sums:
        best: dict[int, tuple[int, tuple]] = {}
        for entry, held in enumerate(layer):
            for exit_ in range(4):
                cost, rank = p["costs"][4 * entry + exit_], p["ranks"][4 * entry + exit_]
                if held is not None and cost is not None and cost == cost:
                    new = held[0] + int(cost), (held[1], int(rank), entry)
                    if exit_ not in best or new < best[exit_]:
                        best[exit_] = new
        low, layer = _ranked(best)
        total += low
        parents.append({s: key[2] for s, (_, key) in best.items()})
        illegal += int(p["illegal"])
        if p["n_rows"]:
            illegal += last is not None and last + p["first"] not in ("su", "ua", "au")
            last = p["last"]
        if not pd.isna(p["low"]):
            n_turns += int(p["n_turns"]) - (high == int(p["low"]))
            high = int(p["high"])
    end = best_end(layer)
    cost, exit_, ways = total + layer[end][0] + INSERT * len(ENDS[end]), end, []
    for back in reversed(parents):
        ways.append((back[exit_], exit_))
        exit_ = back[exit_]
    lows = [int(p["low"]) for p in sums if not pd.isna(p["low"])]
    figures = {"gaps": high - min(lows) + 1 - n_turns if lows else 0, "illegal": illegal, "cost": cost} | {f: int(rows[f].sum()) for f in ("blank", "duplicate", "truncated")}
    none = dict.fromkeys(figures, 0)
    n = len(sums)
    out = [{"c": p["c"], "part": p["part"], "entry": a, "exit": b, "tail": int(k == n - 1)} | (none if k else figures) for k, (p, (a, b)) in enumerate(zip(sums, ways[::-1], strict=True))]
    return pd.DataFrame(out, columns=[f.split()[0] for f in WAY.split(", ")])


PIECE = "c string, piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, n_lines long"
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of portions, in order, as repaired pieces."""
    layers = Layers()
    macros: list[str] = []
    state = at = 0
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            if r["chunk"] == 0:
                macros, at, state = layers.macros(r["marks"], r["entry"], r["exit"]), 0, r["entry"]
            own = macros[at : at + len(r["roles"])]
            at += len(own)
            state, lines = apply(state, own, r["roles"], r["texts"])
            audit = "".join(own)
            if r["tail"] and at == len(macros):
                audit, lines = audit + ENDS[state], lines + end_lines(state)
            figures = {f: r[f] if r["chunk"] == 0 else 0 for f in FIGURES}
            out.append({"c": r["c"], "piece": (r["part"] << 32) + r["chunk"], **figures, "audit": audit, "repaired": "\n".join(lines), "n_lines": len(lines)})
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECE.split(", ")])


def repair(turns: DataFrame, key: str = "conv_id", parts: int | None = None) -> DataFrame:
    """Repaired conversations in pieces: ``c, piece, n_lines, repaired, audit`` and the figures.

    turns: ``key, turn long, role, text, copies``; rows of no copies only name their conversation.
    A conversation is one piece, a long one several: its repaired turns are the lines of its pieces
    in the order of ``piece``, its audit string their ``audit`` in a row; its figures are those of its
    first piece (the others hold zeros). ``c`` is the key as text. Turns come null first; turns of one number come by
    role, then by hashes of role and text. A null key is a conversation of its own. Roles
    count by their first character; an empty text is blank. Roles, texts and copies must not be null (``damaged`` sees to it).
    """
    portions = materialise(bounded_batches(_sorted_turns(turns, key, parts)).mapInPandas(_portions, PORTION), "portions")
    done = portions.where("done").select("c", F.lit(0).cast("long").alias("piece"), (F.col("high") - F.col("low") + 1 - F.col("n_turns")).alias("gaps"), *FIGURES[1:], "audit", "repaired", F.length(F.translate("audit", "D", "")).cast("long").alias("n_lines"))
    done = done.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    rest = portions.where("not done")
    sums = rest.where("chunk = 0").select("c", "part", "n_rows", "low", "high", "n_turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "ranks")
    ways = sums.groupBy("c").applyInPandas(_way, WAY).alias("w")
    rows = rest.select("c", "part", "chunk", "marks", "roles", "texts").alias("r")
    joined = rows.join(ways, F.col("r.c").eqNullSafe(F.col("w.c")) & (F.col("r.part") == F.col("w.part"))).select("r.*", "entry", "exit", "tail", *FIGURES)
    dealt = joined.repartition("c", "part").sortWithinPartitions("c", "part", "chunk")
    return done.unionByName(dealt.mapInPandas(_pieces, PIECE))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation from its pieces in order; holds the audit strings and a running digest."""
    now, key, begun = None, None, False

    def row() -> dict:
        return {"c": key, **figures, "audit": "".join(audit), "repaired_sha256": now.hexdigest()}

    for b in batches:
        out = []
        for r in b.to_dict("records"):
            if now is None or r["c"] != key:
                if now is not None:
                    out.append(row())
                key, now, begun, audit, figures = r["c"], hashlib.sha256(), False, [], dict.fromkeys(FIGURES, 0)
            figures = {f: figures[f] + r[f] for f in FIGURES}
            audit.append(r["audit"])
            if r["n_lines"]:
                now.update((("\n" if begun else "") + r["repaired"]).encode())
                begun = True
        if out:
            yield pd.DataFrame(out)
    if now is not None:
        yield pd.DataFrame([row()])


def repair_report(turns: DataFrame, key: str = "conv_id", parts: int | None = None) -> DataFrame:
    """One row for every conversation: figures, audit string and the digest of its repaired turns, joined by line feeds.

    SHA-256 takes its bytes in order, so the pieces of a conversation pass through one task, a chunk at a time.
    """
    pieces = repair(turns, key, parts).repartition("c").sortWithinPartitions("c", "piece")
    kind = turns.schema[key].dataType
    out = bounded_batches(pieces).mapInPandas(_digests, f"c string, {', '.join(f'{f} long' for f in FIGURES)}, audit string, repaired_sha256 string")
    return out.select(F.col("c").cast(kind).alias(key), *FIGURES, "audit", "repaired_sha256")
