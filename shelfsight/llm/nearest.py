"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks of rows. Every block of queries meets every block of candidates
once, as a grid of (query block, candidate block) keys. In a tile the int8 product gives each
inner product to within a bound: with q = q' + e and c = c' + f,
``|q.c - q'.c'| <= |e| |c| + |q'| |f|`` (norms of the residuals are kept with the rows). Pairs
whose upper bound reaches the k-th best lower bound survive and are recomputed in double
precision. Each tile leaves k rows a query; heaps merge them, first over groups of tiles, then
over all. The result is exact: nothing is approximated but the pruning test.

Growth: blocks have a fixed number of rows, so a task's memory doesn't depend on the input. The
work is queries x candidates, as for any stated query set.
"""

from __future__ import annotations

import heapq
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, materialise

K = 20
QUERY_BLOCK = 16384
BLOCK = 8192
#: Candidate blocks whose results are merged at the first level, and queries merged by one call.
FAN_IN = 64
MERGE_QUERIES = 512


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm and residual norm of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt((x * x).sum(axis=1)), np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; sums of 1000 products of int8 stay exact in single precision."""
    out = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], 1000):
        out += a[:, j : j + 1000].astype(np.float32) @ b[:, j : j + 1000].astype(np.float32).T
    return out


def tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """The k best rows of one candidate block for each query of one query block."""
    qid, q = queries
    cid, c = rows
    qc, qs, qn, qe = quantise(q)
    cc, cs, cn, ce = quantise(c)
    out = []
    for at in range(0, len(qid), 256):
        s = slice(at, at + 256)
        near = int8_product(qc[s], cc) * qs[s, None] * cs[None]
        bound = (qe[s, None] * cn[None] + (qn[s] + qe[s])[:, None] * ce[None]) * (1 + 1e-9) + 1e-12 * qn[s, None] * cn[None]
        near[qid[s, None] == cid[None]] = -np.inf
        low = near - bound
        kk = min(k, len(cid))
        least = np.partition(low, len(cid) - kk, axis=1)[:, len(cid) - kk]
        i, j = np.nonzero((near + bound >= least[:, None]) & np.isfinite(near))
        score = exact_dot(q[s][i], c[j])
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append(pd.DataFrame({"query_id": qid[s][i[keep]], "vec_id": cid[j[keep]], "score": score[keep]}))
    return pd.concat(out, ignore_index=True)


def _block(rows: Column, name: str) -> Column:
    """Each row gets the number of a block of about so many rows of its length, by a hash of its id."""
    return F.pmod(F.xxhash64("id", F.lit(7)), rows).cast("int").alias(name)


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query row.

    ``is_query`` is a condition on the column ``id``. Null, zero and non-finite vectors are left out;
    products are defined between vectors of one length only, so each meets those of its own length.
    A vector isn't its own neighbour. Of rows with one id the smallest vector counts. Ties go to the
    smaller id; fewer candidates give fewer rows.
    """
    fit = materialise(valid_vectors(vectors, key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.size("v")), "vectors")
    up = lambda count, rows: F.greatest(F.ceil(F.col(count) / rows), F.lit(1)).cast("int")
    sizes = fit.groupBy("n").agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked")).select("n", up("asked", query_block).alias("qbs"), up("all", block).alias("cbs"), "asked")
    sizes = materialise(sizes, "vector-sizes")
    total = sizes.agg(F.sum("asked").alias("asked"), F.max("cbs").alias("cbs")).first()
    if not total["asked"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_asked, c_blocks = total["asked"], total["cbs"]
    fit = fit.join(F.broadcast(sizes.drop("asked")) if sizes.count() <= FEW else sizes.drop("asked"), "n")
    asked = fit.where(is_query).select(F.col("n").alias("qn"), F.col("id").alias("query_id"), F.col("v").alias("query_v"), _block(F.col("qbs"), "qb"), F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"))
    rows = fit.select("n", "id", "v", _block(F.col("cbs"), "cb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"))

    def run(key_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "part": []}).astype({"query_id": "int64", "vec_id": "int64", "part": "int32"})
        unpack = lambda x, i, v: (x[i].to_numpy(), np.stack(x[v].to_numpy()).astype(np.float64))
        return tile(unpack(a, "query_id", "query_v"), unpack(b, "id", "v"), k).assign(part=np.int32(key_[2] // FAN_IN))

    found = asked.groupBy("qn", "qb", "cb").cogroup(rows.groupBy("n", "qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score double, part int")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, rows_ in groupby(sorted(zip(pdf["query_id"], -pdf["score"], pdf["vec_id"], strict=True)), itemgetter(0)):
            out += [(q, r, x[2], -x[1], pdf["part"].iloc[0]) for r, x in enumerate(heapq.nsmallest(k, rows_, key=itemgetter(1, 2)), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score", "part"])

    schema = "query_id long, rank int, vec_id long, score double, part int"
    bucket = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(max(1, -(-n_asked // MERGE_QUERIES)))).alias("bucket")
    if c_blocks > FAN_IN:
        found = found.groupBy(bucket, "part").applyInPandas(merge, schema).drop("rank")
    return found.groupBy(bucket).applyInPandas(merge, schema).drop("part")
