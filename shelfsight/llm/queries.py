"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_digests
from .common import LOWER, UPPER, table
from .conversations import damaged, repair_report
from .language_model import score_language
from .licenses import scan_licenses
from .decontaminate import find_leaks
from .line_dedup import line_report
from .nearest import nearest
from .pieces import piece_digests
from .quality import score_quality
from .runs import periodic_runs, planted_text, run_report
from .secrets import find_secrets
from .simhash import simhash_groups
from .url_filter import judge_urls

#: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_report(periodic_runs(docs.withColumn("text", planted_text(F.col("doc_id"), F.col("text")))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_RANKS), token_pattern())


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a
), f AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS n
  FROM u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.n = 1
"""

QUERIES = {
    "op1_quality": op1_quality, "op2_nearest": op2_nearest, "op3_simhash": op3_simhash, "op4_decontaminate": op4_decontaminate, "op5_line_dedup": op5_line_dedup,
    "op6_language_model": op6_language_model, "op7_licenses": op7_licenses, "op8_url_filter": op8_url_filter, "op9_pieces": op9_pieces, "op10_secrets": op10_secrets,
    "op11_runs": op11_runs, "op12_byte_bpe": op12_byte_bpe, "op13_conversations": op13_conversations,
}
ORACLES = {"op2_nearest": OP2_SQL, "op8_url_filter": OP8_SQL}
