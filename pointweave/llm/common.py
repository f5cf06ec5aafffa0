"""What the operators share: the shared work folder, Arrow batch helpers and small column rules.

Every operator reads only the columns it names, so extra columns of the input, whatever they
are called, neither reach it nor clash with its own.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; an own one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        path = f"file://{tempfile.mkdtemp(prefix='pointweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: With it, a query's shuffle files go when it ends and not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df in the shared folder and read it again: cuts lineage, survives lost executors, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/pointweave/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_parts(df: DataFrame, tag: str, key: str, parts: int) -> list[DataFrame]:
    """keep, in parts by a number modulo parts (null: 0), each of which can be dropped by itself."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/pointweave/{tag}-{uuid.uuid4().hex}"
    df.withColumn("_part", F.coalesce(F.pmod(key, F.lit(parts)), F.lit(0))).write.option("compression", "zstd").partitionBy("_part").parquet(path)
    out = []
    for i in range(parts):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={i}")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        out.append(spark.read.schema(df.schema).parquet(f"{path}/_part={i}") if found else spark.createDataFrame([], df.schema))
    return out


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a kept table that no later plan reads."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if "/pointweave/" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids up to which they may be broadcast, about 32 MB in memory; more are joined by shuffling.
MOST_IDS = 1 << 20


def few(ids: DataFrame) -> DataFrame:
    """A kept table of ids, marked for broadcast if its counted size is within the bound."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system, as a worker process is reused by later tasks and would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library(), "malloc_trim"):
        _c_library().malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a slice holds about `most` bytes of the column, of texts or of arrays of 64-bit values, and one row at least."""
    values = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = sizes.fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, fn: Callable[[list, dict], dict], schema: str) -> DataFrame:
    """mapInArrow over slices of rows. fn gets the texts (null as "") and the other columns, and returns a column each."""
    fields = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch, column):
                texts = [x or "" for x in part.column(column).to_pylist()]
                rest = {n: part.column(n) for n in part.schema.names if n != column}
                out = fn(texts, rest)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=t) for (_, t), v in zip(types, out.values(), strict=True)],
                    names=[n for n, _ in types],
                )
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))
    types = [(f.name, f.type) for f in fields]
    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, without any other."""
    return docs.select("doc_id", "text", *more)
