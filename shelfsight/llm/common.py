"""Helpers shared by the corpus operators: text rules, shared-folder tables, grouped batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def native_words(text: Column) -> Column:
    """Words of a lower-cased text as an array, in order; empty for a text without words."""
    return F.filter(F.split(ascii_lower(whole_text(text)), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfsight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written within a ``with`` block; all but those that are kept go with it.

    What the block gives back may read kept tables only. Blocks nest: what an inner one
    keeps belongs to the outer one.
    """

    open_: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        self.open_.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.open_.pop()
        if self.open_:
            self.open_[-1].paths += [p for p in self.paths if p in self.kept]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            if path not in self.kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that outlives the block."""
        out = materialise(df, name)
        self.kept.add(self.paths[-1])
        return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    A lost executor then costs a re-read, never a re-run, and a table that several later
    steps read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if Scratch.open_:
        Scratch.open_[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether a key occurs twice."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(docs: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """``docs`` with the column ``row``, a long for each pair of key and text, in the order of the keys, null last.

    It is the key itself where no key is null or repeated.
    """
    if not repeated(docs, key) and docs.where(F.col(key).isNull()).isEmpty():
        return docs.withColumn(row, F.col(key).cast("long"))
    marks = [unused(docs, m) for m in ("_h1", "_h2", "_none")]
    own = docs.select("*", *(c.alias(m) for m, c in zip(marks, (F.xxhash64(text), F.xxhash64(text, F.lit(1)), F.col(text).isNull()), strict=True)))
    id_ = unused(own, "_key")
    rows = own.select(F.col(key).alias(id_), *marks).distinct().orderBy(F.asc_nulls_last(id_), *marks).withColumn(row, F.monotonically_increasing_id())
    rows = materialise(rows, "rows")
    same = own[key].eqNullSafe(rows[id_])
    for m in marks:
        same = same & (own[m] == rows[m])
    return own.join(rows, same).select(*(own[c] for c in docs.columns), row)


#: Rows of a table that every task may hold.
FEW = 1_000_000


def few(rows: DataFrame, ids: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose keys are in ``ids`` (or aren't): the ids go to every task while they are few, else both sides are shuffled.

    ids: a written table, as it is counted first.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, list(keys), how)


#: Rows that go to Python at a time: texts can be long, so a batch of Spark's 10,000 could fill a worker.
BATCH_ROWS = 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that hands at most ``BATCH_ROWS`` rows to Python at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by their keys.

    Holds one group and the current batch, so callers bound the size of a group.
    Consecutive groups of one batch come together; a group never comes in two parts.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = (batch[keys] == last).all(axis=1).to_numpy()
        cut = len(batch) - int(same[::-1].argmin()) if not same.all() else 0
        if same.all():
            if held and not (held[-1][keys].iloc[-1] == last).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch)
            continue
        yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
        held = [batch.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def per_text(score: Callable[[list[str]], dict[str, Iterable]], key: str, text: str) -> Callable:
    """A mapInPandas function that gives whole texts to ``score`` and keeps the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch[text]]
            yield pd.DataFrame({key: batch[key], **score(texts)})

    return run
