"""Phase tables: what several later phases read is written once into the shared folder.

A phase is written by the first query of a session that needs it and read by all others, so a
long chain of phases stays a chain of short plans, and a lost executor costs a re-read. A phase
holds for the tables as they were: once a table changes, it is written anew. What was
written goes when the driver's JVM ends, or by ``drop_written``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_PHASES: dict[tuple[str, str, str, str], str] = {}
_WRITTEN: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfsight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _at(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(at)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written into the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key as the buckets of a table are, so that joins and windows on it and on the table move nothing."""
    return df.repartition(buckets(df.sparkSession), key)


def _write_buckets(df: DataFrame, name: str, key: str) -> str:
    """The table's name. Rows should come as ``dealt`` gives them, so that a bucket is one file."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    at, files = _at(spark, path)
    df.write.format("parquet").bucketBy(buckets(spark), key).option("path", path).saveAsTable(table)
    files.deleteOnExit(at)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def written_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """The table, written in buckets of a key: windows and groups by the key and others read it without a shuffle."""
    return df.sparkSession.table(_write_buckets(df, name, key))


def drop_written(spark: SparkSession) -> int:
    """Delete every table of this session in the shared folder; their number."""
    own = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in own:
        at, files = _at(spark, path)
        files.delete(at, True)
    for key in [k for k in _PHASES if k[0] == spark.sparkContext.applicationId]:
        del _PHASES[key]
    return len(own)


def tables_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the tables of a folder: one listing. A table in several files changes its folder's time."""
    at, files = _at(spark, sf_dir)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files.listStatus(at)))


def phase(name: str, key: str | None = None) -> Callable[[Query], Query]:
    """Marks a function of (spark, sf_dir) as a phase table, in buckets of a key where one is given."""

    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            at = (spark.sparkContext.applicationId, sf_dir, name, tables_state(spark, sf_dir))
            if at not in _PHASES:
                _PHASES[at] = _write_buckets(build(spark, sf_dir), name, key) if key else _write(build(spark, sf_dir), name)
            return spark.table(_PHASES[at]) if key else spark.read.parquet(_PHASES[at])

        run.__name__ = name
        return run

    return wrap
