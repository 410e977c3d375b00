"""The corpus pipeline: documents through quality, line dedup, near-dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; it is written as
Parquet and read again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import materialise, table
from shelfsight.llm.decontaminate import without_leaks
from shelfsight.llm.line_dedup import remove_repeated_lines
from shelfsight.llm.pieces import piece_digests
from shelfsight.llm.quality import fit_quality, quality_score
from shelfsight.llm.queries import PIECE_MODEL, tokenizer_path
from shelfsight.llm.simhash import drop_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(model)(F.col("text")) >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line of the corpus is like; ``n_chars`` follows the text."""
    out = remove_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the documents, as digests."""
    return piece_digests(docs, tokenizer_path(PIECE_MODEL))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("sentencepiece", pieces)]

#: No SQL expresses the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
