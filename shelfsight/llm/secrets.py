"""Secret scans: fixed patterns and a battery of randomness tests, in built-in functions only.

Fixed kinds: ``assign`` (a named value), ``access`` (an access key id) and ``hex``. The method
adds ``random``: runs of 20 or more characters that mix letters and digits. The encoding is
inferred from the characters (hexadecimal, base 32, base 62, base 64) and gives the alphabet.
Three tests ask whether the run looks like uniform draws from it: chi-squared of the character
counts, Wald-Wolfowitz runs about the middle of the alphabet, and lag-1 serial correlation; one
that fails at ``ALPHA`` drops the run. What is left must be told from text: under the null that
the run is text-like its chi-squared is non-central, with the excess that natural letters (or
digits) have, which grows with the length; the lower tail gives a p-value, and Benjamini-Hochberg
over the whole corpus, for each class of lengths, keeps the false-discovery rate at ``FDR``.
Short runs thus need stronger evidence, and a run too short to tell is never reported.

One pass over the texts writes a small table of spans and tests. The corpus statistics are counts
in fixed bins of p (the upper edge of a bin counts, which is on the safe side), a few hundred
rows for any input. No joins, and no shuffle but that of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_text
from .spans import NO_SPANS, match_spans, spans_where

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAME = r"(?i:passw(?:ord|d)|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Whether there is a run at all.
MAYBE_RUN = r"[A-Za-z0-9+/_-]{20}"
ALPHA, FDR = 0.001, 0.05
#: encoding: alphabet in order of its values, what its runs look like, coincidence index of the text-like null
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^[0-9a-f]+$|^[0-9A-F]+$", 0.1),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$", 0.0667),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+$", 0.0667),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"", 0.0667),
}
#: Least lengths of the classes in which discoveries are controlled, and bins of -ln p.
LENGTHS = (20, 32, 48, 80, 160)
BIN, BINS = 0.1, 400


def two_sided(z: Column) -> Column:
    """Two-sided normal tail by a logistic approximation (absolute error under 0.0002)."""
    a = F.least(F.abs(z), F.lit(20.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + a * a * a * 0.07056))


def lower_tail(z: Column) -> Column:
    half = two_sided(z) / 2
    return F.when(z <= 0, half).otherwise(1 - half)


def _of(encoding: Column, value) -> Column:
    out = F.lit(value("base64"))
    for name in ("hex", "base32", "base62"):
        out = F.when(encoding == name, F.lit(value(name))).otherwise(out)
    return out


def encoding_of(run: Column) -> Column:
    out = F.lit("base64")
    for name in ("base62", "base32", "hex"):
        out = F.when(run.rlike(ENCODINGS[name][1]), name).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """struct<encoding, len, p_uniform, p_runs, p_serial, p_text> of one run of characters."""
    enc = encoding_of(run)
    alphabet = _of(enc, lambda e: ENCODINGS[e][0])
    k = _of(enc, lambda e: float(len(ENCODINGS[e][0])))
    excess = _of(enc, lambda e: len(ENCODINGS[e][0]) * ENCODINGS[e][2] - 1)
    plain = F.when(enc == "hex", F.lower(run)).otherwise(F.translate(run, "-_", "+/"))
    n = F.length(run).cast("double")

    def tests(chars: Column) -> Column:
        return F.transform(F.array(F.struct(chars.alias("c"), F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1).alias("x"))), stats)[0]

    def stats(s: Column) -> Column:
        chars, x = s["c"], s["x"]
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(chars, lambda c: c == d)).cast("double"), F.lit(2.0)))
        chi = k / n * squares - n
        up = F.transform(x, lambda v: v >= k / 2)
        above = F.size(F.filter(up, lambda u: u)).cast("double")
        runs = F.lit(1.0) + F.size(F.filter(F.arrays_zip(F.slice(up, F.lit(1), F.size(up) - 1).alias("a"), F.slice(up, F.lit(2), F.size(up) - 1).alias("b")), lambda p: p["a"] != p["b"]))
        mean_runs = 2 * above * (n - above) / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean))
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / F.greatest(var, F.lit(1e-9))
        text_mean, text_sd = k - 1 + n * excess, F.sqrt(2 * (k - 1) + 4 * n * excess)
        return F.struct(
            enc.alias("encoding"), F.length(run).alias("len"),
            two_sided((chi - (k - 1)) / F.sqrt(2 * (k - 1))).alias("p_uniform"),
            F.when(var_runs > 0, two_sided((runs - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-9))))).otherwise(0.0).alias("p_runs"),
            two_sided((serial + 1 / n) * F.sqrt(n)).alias("p_serial"),
            lower_tail((chi - text_mean) / text_sd).alias("p_text"),
        )

    return tests(F.filter(F.split(plain, ""), lambda c: c != ""))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _kept(spans: Column, kind: str, least: int) -> Column:
    rank = KINDS.index(kind)
    long = F.filter(spans, lambda s: F.length(s["found"]) >= least)
    return F.transform(long, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, base spans, and tested runs that no base span holds.

    ``base`` array<struct<start, rank, end>>, ``runs`` array<struct<start, end, class, bin>> with
    runs that pass the battery; ``bin`` counts steps of -ln p_text.
    """
    rows = docs.select(F.col(key), whole_text(F.col(text)).alias("_t"))
    t = F.col("_t")
    rows = rows.select(
        key, t,
        _kept(spans_where(t.rlike(ASSIGN_NAME), t, ASSIGN, 1), "assign", 12).alias("_assign"),
        _kept(spans_where(F.contains(t, F.lit("AKIA")), t, ACCESS), "access", 18).alias("_access"),
        _kept(spans_where(t.rlike(HEX), t, HEX), "hex", 16).alias("_hex"),
        F.when(t.rlike(MAYBE_RUN), match_spans(t, F.lit(RUN))).otherwise(F.array().cast(NO_SPANS)).alias("_runs"),
    )
    rows = rows.select(key, F.concat("_assign", "_access", "_hex").alias("base"), F.filter("_runs", lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]")).alias("_runs"))
    free = F.filter("_runs", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    tested = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["found"]).alias("t")))
    passed = F.filter(tested, lambda s: (s["t"]["p_uniform"] >= ALPHA) & (s["t"]["p_runs"] >= ALPHA) & (s["t"]["p_serial"] >= ALPHA))
    p_bin = lambda s: F.least(F.floor(-F.log(F.greatest(s["t"]["p_text"], F.lit(1e-300))) / BIN), F.lit(BINS)).cast("int")
    binned = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _length_class(s["t"]["len"]).alias("class"), p_bin(s).alias("bin"))
    return rows.select(key, "base", F.transform(tested, binned).alias("tested"), F.transform(passed, binned).alias("runs"))


def discovery_bins(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The least bin that counts as a discovery, for each class of lengths that has one.

    Benjamini-Hochberg on bins: all tested runs count as hypotheses. At most a few hundred rows.
    """
    hist = scanned.select(F.explode("tested").alias("s")).groupBy(F.col("s.class").alias("class"), F.col("s.bin").alias("bin")).count()
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    seen = hist.select("class", "bin", F.sum("count").over(above).alias("seen"), F.sum("count").over(Window.partitionBy("class")).alias("all"))
    good = seen.where(F.exp(-F.col("bin") * BIN) <= fdr * F.col("seen") / F.col("all"))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. A null or
    empty text has none. Repeated rows each give a row; other columns are left out.
    """
    found = materialise(scan(docs, key, text), "secrets")
    least = discovery_bins(found)
    passes = F.lit(False)
    s_class, s_bin = (lambda s: s["class"]), (lambda s: s["bin"])

    def random(s: Column) -> Column:
        out = passes
        for c, b in sorted(least.items()):
            out = out | ((s_class(s) == c) & (s_bin(s) >= b))
        return out

    extra = F.transform(F.filter("runs", random), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        key, *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", extra)).alias("spans"),
    )
