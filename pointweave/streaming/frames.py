"""Slices as a stream: frames in order of time, decoded with one state per patch.

Frames may come in any order within `late` of each other. Rows wait in a patch's state until the watermark has
passed their ts, which a timer tells, and are then released in order of ts; what a patch carries on (its latest
intra slice, from which the tree and the reference colours are rebuilt, or the number of its group) is a state
of its own, so a result does not depend on how frames fall into triggers. A second as an event time stands for
one unit of ts. A row at CLOSING ends a stream: it moves the watermark past all frames. Rows that come after the
watermark are left out by Spark, which the query's progress counts; `drain` makes an error of them.
How many files a trigger takes bounds what is in flight.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import EngineError, Kind
from ..operators.codec import POINT_SCHEMA, Decoder, decode_rows
from ..plans.store import shared_folder
from ..schemas import CLOSING, SLICES
from ..sources.formats import slice_of
from ..sources.registered import register

NAMES = SLICES.fieldNames()
STATE = "ts int, patch int, type short, size long, qp short, mv array<float>, geometry binary, color binary"
#: Keyed states with timers need it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What makes an event time of the least ts positive.
SHIFT = 1 << 31


def slice_stream(spark: SparkSession, path: str, files: int = 60) -> DataFrame:
    """A stream of slice rows from Parquet files as they appear."""
    return spark.readStream.schema(SLICES).option("maxFilesPerTrigger", files).parquet(path)


def slice_files_stream(spark: SparkSession, folder: str, frames: int = 60, last: int | None = None) -> DataFrame:
    """A stream of the slices in a folder of .slice files, whole frames in order of ts; it closes after the frame `last`."""
    register(spark)
    return spark.readStream.format("slice").options(framesPerTrigger=frames, **({} if last is None else {"last": last})).load(folder)


def closing(spark: SparkSession, like: DataFrame) -> DataFrame:
    """The row that ends a stream of rows with ts and patch."""
    known = {"ts": F.lit(CLOSING), "patch": F.lit(-1)}
    return spark.range(1).select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def _second(ts: int) -> int:
    return 1000 * (ts + SHIFT)


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them; subclasses say what becomes of rows in order."""

    def __init__(self, row: str, state: str):
        self.row, self.state = row, state
        self.names = [c.split()[0] for c in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "ts int", self.row)
        self.carried = handle.getValueState("carried", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch[batch["ts"] != CLOSING][self.names].to_dict("records"):
                ts = int(row["ts"])
                self.early.updateValue((ts,), tuple(_plain(row[n]) for n in self.names))
                self.handle.registerTimer(_second(ts))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first = expiredTimerInfo.getExpiryTimeInMs() // 1000 - SHIFT
        if not self.early.containsKey((first,)):
            return  # released with an earlier one
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.early.keys() if _second(k[0]) <= passed)
        out = self.release(key, [self.early.getValue((ts,)) for ts in due])
        for ts in due:
            self.early.removeKey((ts,))
        yield out

    def release(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _plain(value):
    """A value of a data frame as a state takes it."""
    if value is None or isinstance(value, (bytes, int, float)):
        return value
    if isinstance(value, bytearray):
        return bytes(value)
    return [float(v) for v in value] if hasattr(value, "__len__") else value.item()


class SliceDecoder(Ordered):
    """Points of a patch's slices; carries the latest intra slice."""

    def __init__(self):
        super().__init__(STATE, STATE)

    def release(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        decoder = Decoder()
        carried = self.carried.get() if self.carried.exists() else None
        if carried is not None:
            decoder.decode(slice_of(dict(zip(NAMES, carried, strict=True))))
        out = decode_rows(pd.DataFrame([tuple(r) for r in rows], columns=NAMES).astype({"geometry": object, "color": object}), decoder)
        intra = [r for r in rows if not r[NAMES.index("type")] & 2]
        if intra:
            self.carried.update(tuple(intra[-1]))
        return out


class GroupNumbers(Ordered):
    """Numbers of a patch's groups of pictures; carries the number so far."""

    def __init__(self):
        super().__init__("ts int, type int", "gop int")

    def release(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        gop = self.carried.get()[0] if self.carried.exists() else None
        out = []
        for ts, kind in rows:
            gop = 0 if gop is None else gop + (kind == 0)
            out.append((key[0], ts, gop))
        self.carried.update((gop,))
        return pd.DataFrame(out, columns=["patch", "ts", "gop"]).astype("int32")


def _in_order(rows: DataFrame, processor: Ordered, schema: str, late: int) -> DataFrame:
    rows.sparkSession.conf.set(*STATE_STORE)
    at = rows.withColumn("at", F.timestamp_seconds(F.col("ts").cast("long") + SHIFT)).withWatermark("at", f"{late} seconds")
    return at.groupBy("patch").transformWithStateInPandas(processor, schema, "append", "EventTime")


def decoded_stream(slices: DataFrame, late: int = 0) -> DataFrame:
    """Points of a stream of slices, by patch. late: how many units of ts a frame may come after a later one."""
    return _in_order(slices, SliceDecoder(), POINT_SCHEMA, late)


def gop_stream(patches: DataFrame, late: int = 0) -> DataFrame:
    """Numbers the groups of pictures of a stream of (patch, ts, type): type 0 starts one."""
    return _in_order(patches, GroupNumbers(), "patch int, ts int, gop int", late)


def windowed_counts(events: DataFrame, length: str, late: str, *keys: str, ts: str = "ts", value: Column | str = "value", slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window, with a watermark; works on batches and streams."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return at.groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def drain(stream: DataFrame, name: str, mode: str = "append", at_once: bool = True) -> DataFrame:
    """Runs a stream over what is there, and gives its results as a table in the shared folder.

    A trigger's rows are a folder of its own, written anew if the trigger is; in mode complete the last one is the result.
    at_once: sources that say how much a trigger takes are asked so; others go on, trigger by trigger, until nothing is left.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    each = "batch=0" if mode == "complete" else "batch={}"
    dropped = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{each.format(batch)}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", f"{path}-offsets")
    query = (writer.trigger(availableNow=True) if at_once else writer).start()
    try:
        query.awaitTermination() if at_once else query.processAllAvailable()
        dropped = [o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]]
    finally:
        query.stop()
    if sum(dropped):
        raise EngineError(Kind.BAD_TIME_STAMP, f"{sum(dropped)} rows came after the watermark")
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")


def stage_times(query) -> dict[str, float]:
    """Mean milliseconds per trigger of a stream's phases."""
    sums: dict[str, list[float]] = {}
    for progress in query.recentProgress:
        for phase, ms in progress["durationMs"].items():
            sums.setdefault(phase, []).append(ms)
    return {phase: sum(v) / len(v) for phase, v in sums.items()}
