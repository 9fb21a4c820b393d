"""Growing inputs: new uploads, micro-batch title runs, job states. State is kept by key and ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark.functions import texts as x
from foliospark.operators.regions import title_regions
from foliospark.operators.report import TERMINAL

_EVENT = "job_id long, seq_id long, ts timestamp_ntz, status string, msg string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that keyed, expiring state needs; the session's own setting comes back after."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, own) if own else spark.conf.unset(_PROVIDER)


def new_uploads(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of path, name, ext of images as they arrive; other files are ignored."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "modificationTime", "length")
    return files.withColumn("name", x.base_name(F.col("path"))).withColumn("ext", x.ext(F.col("name"))).filter(F.col("ext").isin(*x.IMAGE_SUFFIXES))


# -- titles of pages whose detections come bit by bit


class PageDetections(StatefulProcessor):
    """What is known of a page: its detections by number, the last of each. Emits all of them when some arrive."""

    def __init__(self, value: T.StructType, keep_ms: int | None):
        self.value, self.keep_ms = value, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("detections", "det_idx long", self.value, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.value.fieldNames()
        for batch in rows:
            for det_idx, *rest in batch[["det_idx", *names]].itertuples(index=False, name=None):
                self.known.updateValue((int(det_idx),), tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in rest))
        all_of = [(key[0], k[0], *v) for k, v in self.known.iterator()]
        yield pd.DataFrame(all_of, columns=["page_id", "det_idx", *names]).convert_dtypes(dtype_backend="pyarrow")

    def close(self) -> None:
        pass


def page_detections(detections: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of (page_id, det_idx, ...): whenever detections of a page arrive, all that is known of it. A page's state ends ``keep_ms`` after its detections were written (None: never)."""
    value = T.StructType([f for f in detections.schema if f.name not in ("page_id", "det_idx")])
    out = T.StructType([*(f for n in ("page_id", "det_idx") for f in detections.schema if f.name == n), *value])
    return detections.groupBy("page_id").transformWithStateInPandas(PageDetections(value, keep_ms), out, "Update", "ProcessingTime" if keep_ms else "None")


def run_titles(detections: DataFrame, path: str, checkpoint: str, every: str | None = None, keep_ms: int | None = None) -> StreamingQuery:
    """The title regions of pages as their detections arrive, a page's detections maybe in several micro-batches.

    The pages' detections are keyed state, so a batch costs what its own pages do, however many batches came before; it
    writes the regions of its pages to the folder batch=N below path/titles, and over itself if it runs again. Read with
    ``read_titles``; ``compact_titles`` folds old batches into one. By default it takes what is there and ends; with ``every`` ("10 seconds")
    it goes on, and may let a page's state end ``keep_ms`` after it was written (a clock keeps such a query from ending by itself). A page whose state has ended starts anew.
    """
    if keep_ms and not every:
        raise ValueError("state that ends by the clock needs a query that goes on: name every")

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            title_regions(batch).write.mode("overwrite").parquet(f"{path}/titles/batch={batch_id}")

    with keyed_state(detections.sparkSession):
        out = page_detections(detections, keep_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def _folders(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, str]]]:
    """The last batch that the newest whole base holds (-1: none), and (batch, folder) of what counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/titles")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(kind, int(n), f"{path}/titles/{kind}={n}") for s in fs.listStatus(place) for kind, _, n in [s.getPath().getName().partition("=")] if kind in ("batch", "base") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    base = max((n for kind, n, _ in found if kind == "base"), default=-1)
    return base, [(n, p) for kind, n, p in found if (kind == "base" and n == base) or (kind == "batch" and n > base)]


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """The latest title regions of each page: of the newest base and the batches after it."""
    base, found = _folders(spark, path)
    later = [p for n, p in found if n > base]
    parts = [spark.read.option("basePath", f"{path}/titles").parquet(*later).withColumnRenamed("batch", "_batch")] if later else []
    if base >= 0:
        parts.append(spark.read.parquet(f"{path}/titles/base={base}").withColumn("_batch", F.lit(base)))
    titles = reduce(DataFrame.unionByName, parts)
    latest = titles.groupBy("page_id").agg(F.max("_batch").alias("_batch"))
    return titles.join(latest, ["page_id", "_batch"]).drop("_batch")


def compact_titles(spark: SparkSession, path: str) -> None:
    """Folds all batches so far into a base; older folders go once it is whole. For one caller at a time, beside a running stream."""
    base, found = _folders(spark, path)
    last = max(n for n, _ in found)
    if last == base:
        return
    read_titles(spark, path).write.mode("overwrite").parquet(f"{path}/titles/base={last}")
    for _, old in found:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# -- jobs that end


class UntilTerminal(StatefulProcessor):
    """Lets a job's events through up to its first terminal one. State: whether it is over, until a timer frees it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.over = handle.getValueState("over", "over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            for _ in rows:
                pass
            return
        found = pd.concat(list(rows)).sort_values(["ts", "seq_id"])
        ends = found["status"].isin(TERMINAL).to_numpy()
        if ends.any():
            at = int(ends.argmax())
            self.over.update((True,))
            self.handle.registerTimer(int(found["event_time"].iloc[at].timestamp() * 1000) + self.keep_ms)
            found = found.iloc[: at + 1]
        yield found.drop(columns="event_time")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.over.clear()
        yield from ()

    def close(self) -> None:
        pass


def until_terminal_stream(events: DataFrame, late: str = "1 hour", keep_ms: int = 24 * 3_600_000) -> DataFrame:
    """A stream of events less what comes after a job's first terminal state. Start it inside ``keyed_state``.

    Only jobs that are over have state, and theirs ends ``keep_ms`` of event time after the terminal event. What is older than the newest event by more
    than ``late`` is dropped as any late event is, so what belongs to an ended job stays out; an event newer than that for a job
    whose state has ended begins a new run of it.
    """
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("job_id").transformWithStateInPandas(UntilTerminal(keep_ms), _EVENT, "Append", "EventTime")
