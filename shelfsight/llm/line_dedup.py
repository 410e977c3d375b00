"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its lower-cased words. It goes if an earlier line of the corpus, by document
id and place, has Jaccard similarity of NUM/DEN or more with it, whether or not that one stays.

1. Rarity: words are counted over all documents in a fixed number of hash classes; a line's words
   are ordered by the size of their class's count, in a class longer words first, then by hash.
   Any fixed order is exact.
2. Lines of equal sets are one row after a partial minimum; all but the first occurrence go.
3. A first occurrence of n words puts its n - ceil(tn) + 1 rarest words into an index. Two lines
   of similarity t share one of them. Length, position and a parity map of the words (64 bits,
   128 for long lines; its difference is at most that of the sets) filter pairs before any words
   are joined to them.
4. Words shared by more than ``CROWD`` lines: a line first meets the earliest line of each class of
   lengths only, and a line that is gone needs no other partner. What is left then meets all.
5. Candidate lines are read again from their documents, and their words themselves are compared.

Equal sets (step 2) are told by 128 bits of hashes: among N sets the odds that any two differ and
agree are below N^2 / 2^129. No list of lines is gathered for a key, pairs are never expanded
within a group of equal lines, and no step depends on one task or the driver; the driver sees the
counts of the classes only, a fixed number. Their table is part of one plan, which has no exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few, materialise, numbered, unused, whole_text

#: Similarity 4/5.
NUM, DEN = 4, 5
#: Hash classes in which words are counted; the table has one byte for each, whatever the corpus.
SLOTS, CHUNK = 1 << 18, 1 << 12
#: Ranks of a doubling of the count.
FINE = 4
CROWD = 200
#: Lines of more words have a parity map of 128 bits.
LONG = 64
#: A line of fewer words has no partner but its equals.
LEAST_WORDS = NUM
END = (1 << 63) - 1


def _spaced(text: Column) -> Column:
    """Lower-cased, with spaces for the other white space of ASCII but line feeds."""
    low = F.lower(text)
    out = low
    for c in "\t\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(text.rlike(r"[\t\x0B-\r]"), out).otherwise(low)


def word_class(hash_: Column) -> Column:
    return hash_.bitwiseAND(SLOTS - 1).cast("int")


def rarity(docs: DataFrame, text: str) -> Column:
    """A table of bytes by word class: the logarithm of the class's count in all documents.

    Counts come to the driver as lists of at most ``CHUNK`` classes. Words that only other white
    space parts are counted together: that makes another order, as exact as any.
    """
    words = docs.select(F.explode(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(word_class(F.xxhash64("w")).alias("h")).count()
    entry = F.struct((F.col("h") % CHUNK).alias("at"), F.least(F.floor(F.log2("count") * FINE) + 1, F.lit(127)).cast("int").alias("rank"))
    table = bytearray(SLOTS)
    for r in counts.groupBy(F.floor(F.col("h") / CHUNK).cast("int").alias("chunk")).agg(F.collect_list(entry).alias("e")).select("chunk", F.col("e.at").alias("at"), F.col("e.rank").alias("rank")).collect():
        for at, rank in zip(r["at"], r["rank"], strict=True):
            table[r["chunk"] * CHUNK + at] = rank
    return F.lit(bytes(table))


def word_keys(line: Column, rank: Column) -> Column:
    """Sorted numbers of a spaced line's distinct words, rare words first."""

    def key(h: Column) -> Column:
        order = F.ascii(F.substr(rank, word_class(h) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(order.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key))


def _up(a: Column, b: int) -> Column:
    """a / b, rounded up."""
    return F.floor((a + (b - 1)) / b).cast("int")


def overlap(n: Column, m: Column) -> Column:
    """Least overlap of sets of n and m words with the similarity."""
    return _up((n + m) * NUM, NUM + DEN)


def probe_length(n: Column) -> Column:
    """Rarest words of n that a partner of any size shares one of."""
    return n - _up(n * NUM, DEN) + 1


def index_length(n: Column) -> Column:
    """The same for partners of no fewer words."""
    return n - overlap(n, n) + 1


def parity(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))))


def odd_parity(n: Column, keys: Column) -> Column:
    """Of long lines the part of the map that comes from half of all words; else zero."""
    return F.when(n > LONG, parity(F.filter(keys, lambda k: k.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("long"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``d, l, line``, spaced; documents without an id come last."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(END)).alias("d"), F.posexplode(F.split(_spaced(whole_text(F.col(text))), "\n")).alias("l", "line"))


def _may_match(x: str, y: str) -> Column:
    """Length, position and parity filters of two rows of one key."""
    n, m, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}i"), F.col(f"{y}i")
    need = overlap(n, m)
    whole, odd = F.col(f"{x}b").bitwiseXOR(F.col(f"{y}b")), F.col(f"{x}o").bitwiseXOR(F.col(f"{y}o"))
    apart = F.when((n > LONG) & (m > LONG), F.bit_count(odd) + F.bit_count(whole.bitwiseXOR(odd))).otherwise(F.bit_count(whole))
    return (m * DEN >= n * NUM) & (n * DEN >= m * NUM) & (F.least(n - i, m - j) >= need) & (F.bit_count(whole) <= n + m - 2 * need) & (apart <= n + m - 2 * need)


def _shorter(y: str, x: str) -> Column:
    return (F.col(f"{y}n") < F.col(f"{x}n")) | ((F.col(f"{y}n") == F.col(f"{x}n")) & _earlier(y, x))


def _earlier(y: str, x: str) -> Column:
    return (F.col(f"{y}d") < F.col(f"{x}d")) | ((F.col(f"{y}d") == F.col(f"{x}d")) & (F.col(f"{y}l") < F.col(f"{x}l")))


def length_class(n: Column) -> Column:
    """Classes of lengths, a tenth apart."""
    return F.floor(F.log(n) / F.log(F.lit(1.1))).cast("int")


POSTED = ("d", "l", "n", "i", "b", "o")


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select("k", *(F.col(c).alias(f"{side}{c}") for c in POSTED))


def candidates(sets: DataFrame, may_match: Callable[[str, str], Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs ``xd, xl, yd, yl`` that pass the filters, and rows of crowded words.

    sets: ``d, l`` (who), ``n, b, o`` (size, and what else the filters need) and ``p``, the rarest words. One join gives the pairs of words with few lines and keeps the rows of crowds, so that the
    words are dealt out once.
    """
    post = sets.where("p is not null").select("d", "l", "n", "b", "o", F.posexplode("p").alias("i", "k")).where("k is not null")
    # size and place travel as one number
    post = post.select("k", "d", "l", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("ni"), "b", "o").repartition("k")
    post = post.withColumn("c", F.count("*").over(Window.partitionBy("k"))).where("c > 1")
    post = post.select("k", "c", "d", "l", F.shiftright("ni", 32).cast("int").alias("n"), F.col("ni").bitwiseAND(0x7FFFFFFF).cast("int").alias("i"), "b", "o")
    x = post.select("k", F.col("c").alias("xc"), *(F.col(c).alias(f"x{c}") for c in POSTED))
    y = _named(post.where((F.col("c") <= CROWD) & (F.col("i") < index_length(F.col("n")))), "y").withColumnRenamed("k", "yk")
    met = x.join(y, (F.col("k") == F.col("yk")) & (F.col("xc") <= CROWD) & _shorter("y", "x") & may_match("x", "y"), "left")
    met = materialise(met.where((F.col("xc") > CROWD) | F.col("yd").isNotNull()).select("xc", "k", *(f"x{c}" for c in POSTED), "yd", "yl"), name)
    crowd = met.where(F.col("xc") > CROWD).select("k", *(F.col(f"x{c}").alias(c) for c in POSTED))
    return met.where(F.col("xc") <= CROWD).select("xd", "xl", "yd", "yl"), crowd


def leads(crowd: DataFrame, may_match: Callable[[str, str], Column], name: str) -> DataFrame:
    """Pairs of each row of a crowd with the first of each class of lengths."""
    lead = crowd.groupBy("k", length_class(F.col("n")).alias("_n")).agg(F.min(F.struct("d", "l", "n", "i", "b", "o")).alias("s")).select("k", "s.*")
    led = _named(crowd, "x").join(materialise(_named(lead, "y"), name), "k")
    return led.where(_earlier("y", "x") & may_match("x", "y")).select("xd", "xl", "yd", "yl")


def rest_pairs(left: DataFrame, crowd: DataFrame, may_match: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of the rows that are left with all earlier rows of their crowd."""
    both = _named(left, "x").join(_named(crowd, "y"), "k")
    return both.where(_earlier("y", "x") & may_match("x", "y")).select("xd", "xl", "yd", "yl")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The later lines ``d, l`` of pairs ``xd, xl, yd, yl`` whose sets have the similarity."""
    pairs = materialise(pairs.distinct(), "line-pairs")
    wanted = materialise(pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl")).distinct(), "line-wanted")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(END)).alias("_key"), F.col(text).alias("_text"))
    texts = few(texts, wanted.select(F.col("d").alias("_key")).distinct(), "_key")
    words = few(lines_of(texts, "_key", "_text"), wanted, "d", "l").select("d", "l", F.array_remove(F.array_distinct(F.split("line", " ")), "").alias("w"))
    words = materialise(words, "line-words")
    side = lambda s: words.select(*(F.col(c).alias(f"{s}{c}") for c in ("d", "l", "w")))
    both = pairs.join(side("x"), ["xd", "xl"]).join(side("y"), ["yd", "yl"])
    shared = F.size(F.array_intersect("xw", "yw"))
    alike = shared * (NUM + DEN) >= (F.size("xw") + F.size("yw")) * NUM
    later = _earlier("y", "x")
    return both.where(alike & (F.size("xw") > 0)).select(F.when(later, F.col("xd")).otherwise(F.col("yd")).alias("d"), F.when(later, F.col("xl")).otherwise(F.col("yl")).alias("l")).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines ``d, l, n`` and those that go ``d, l``."""
    lines = lines_of(docs, key, text).select("d", "l", word_keys(F.col("line"), rarity(docs, text)).alias("w"))
    n = F.size("w")
    lines = lines.select(
        "d", "l", n.alias("n"), parity(F.col("w")).alias("b"), odd_parity(n, F.col("w")).alias("o"),
        F.when(n > 0, F.xxhash64("w")).alias("h1"), F.when(n > 0, F.xxhash64("w", F.lit(1))).alias("h2"),
        F.when(n >= LEAST_WORDS, F.transform(F.slice("w", F.lit(1), F.greatest(probe_length(n), F.lit(0))), lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int"))).alias("p"),
    )
    lines = materialise(lines, "lines")
    named = lines.where("n > 0").withColumn("place", (F.col("d").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(20,0)") + F.col("l")).cast("decimal(38,0)"))
    # a repeated row has lines with the same place twice; both are firsts, and equal
    sets = named.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("c"), F.min_by(F.struct("d", "l", "n", "b", "o", "p"), "place").alias("s"))
    sets = materialise(sets.select("h1", "h2", "first", "c", "s.*"), "line-sets")
    gone = materialise(named.select("d", "l", "h1", "h2", "place").join(sets.where("c > 1").select("h1", "h2", "first"), ["h1", "h2"]).where("first < place").select("d", "l"), "line-copies")

    pairs, crowd = candidates(sets, _may_match, "line-candidates")
    hot = not crowd.isEmpty()
    if hot:
        pairs = pairs.union(leads(crowd, _may_match, "line-leads"))
    similar = materialise(_verified(pairs, docs, key, text), "line-similar")
    if hot:
        rest = materialise(rest_pairs(few(crowd, similar, "d", "l", how="left_anti"), crowd, _may_match), "line-rest")
        if not rest.isEmpty():
            similar = similar.union(_verified(rest, docs, key, text))
    return lines.select("d", "l", "n"), gone.union(similar).distinct()


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_lines, n_removed, removed`` of every id: numbers of the removed lines, from 0, comma-joined.

    A null text counts as empty: one line without words. Lines without words stay. Rows with one
    id are one document whose lines count once each; rows without an id are one document, the
    last. Other columns are left out.
    """
    lines, gone = repeated_lines(docs, key, text)
    per_doc = lines.groupBy("d").agg((F.max("l") + 1).cast("long").alias("n_lines"))
    removed = gone.groupBy("d").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l.cast("string")), ",").alias("removed"))
    out = per_doc.join(removed, "d", "left")
    return out.select(F.when(F.col("d") != END, F.col("d")).alias(key), "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, texts without the lines that go.

    Rows with one id and different texts, and rows without an id, are documents of their own here;
    those without an id come last. Rows with one id and one text are one document.
    """
    row, lines_gone = unused(docs, "_row"), unused(docs, "_gone")
    rows = numbered(docs, key, text, row)
    with Scratch(docs.sparkSession) as scratch:
        _, gone = repeated_lines(rows, row, text)
        removed = scratch.keep(gone.groupBy(F.col("d").alias(row)).agg(F.collect_set("l").alias(lines_gone)), "line-gone")
    out = rows.join(removed, row, "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda s, i: ~F.array_contains(lines_gone, i)), "\n")
    return out.withColumn(text, F.when(F.col(lines_gone).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
