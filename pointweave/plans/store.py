"""Where stages meet: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError, Kind


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; an own one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError(Kind.INVALID_DIR, "spark.checkpoint.dir names no folder that the executors share")
        path = f"file://{tempfile.mkdtemp(prefix='pointweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: With it, a stage's shuffle files go when it is written and not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Without it, rows that are dealt by some of a join's keys are not dealt again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Partitions of shuffles, and the bytes that adaptive execution puts together in a task.
PARTITIONS, TASK_BYTES = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Rows that a task of wide joins and sums is meant to get.
TASK_ROWS = 1 << 18
_open: list[list[str]] = []


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings, named by the constants of this module, for a while."""
    names = {globals()[k]: v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_stage(spark: SparkSession, name: str) -> str:
    """A folder for a stage's result."""
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def append(df: DataFrame, path: str) -> None:
    """Write rows into a stage's folder beside what is there."""
    with settings(df.sparkSession, CLEAN_UP="true"):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's result and read it again: cuts lineage, and a lost executor costs no more than the stage."""
    spark = df.sparkSession
    path = new_stage(spark, name)
    append(df, path)
    return spark.read.schema(df.schema).parquet(path)


def staged_evenly(df: DataFrame, name: str, rows: int) -> DataFrame:
    """staged, with shuffles in as many partitions as `rows` need, and few bytes put together in a task, whose memory then doesn't grow with the table.

    Rows of small numbers are packed to a tenth or less in shuffle files, so that Spark's own limit on a task's bytes lets it have gigabytes.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get(PARTITIONS)), -(-rows // TASK_ROWS))
    with settings(spark, PARTITIONS=str(tasks), TASK_BYTES="4m"):
        return staged(df, name)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stages/" in path:
            drop(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at the end; a result that is to stay is staged after it or made by `outlast`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop(spark, path)


def outlast(df: DataFrame, name: str) -> DataFrame:
    """A stage that isn't dropped with the others of the `passing` around it, but with those of the one around that."""
    own = _open.pop() if _open else None
    try:
        return staged(df, name)
    finally:
        if own is not None:
            _open.append(own)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows with the same keys in one of as many tasks as shuffles have: where work is heavy for its bytes, few keys must not be put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def save(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A stage's table at a path of its own, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved stage; a missing one is an error."""
    return spark.read.parquet(path)
