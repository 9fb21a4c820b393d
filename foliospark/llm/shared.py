"""What the operators of this subpackage share: shared-folder tables and small column idioms."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths made inside the innermost scratch.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: By operator: how to drop what its tasks keep in a worker. And the operator whose tasks this worker ran last.
_KEPT: dict[str, tuple[Callable[[], object], ...]] = {}
_LATEST = [""]
#: ASCII letters, as the contracts lower-case A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word of the alphanumeric kind: runs of ASCII digits, lower-case letters and all beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable is bound, not repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Local sessions without one get a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-foliospark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends or the ``scratch`` around it does."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, place = _place(spark, path)
    system.deleteOnExit(place)
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at its end; what comes of them has to be written by then."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        made = _SCRATCH.get()
        _SCRATCH.reset(token)
        delete(spark, *made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uri_of(table: DataFrame) -> str:
    """Where a stored table is written, for workers that read it by pyarrow.fs."""
    return table.inputFiles()[0].rpartition("/")[0]


def read_back(uri: str, columns: list[str] | None = None, where=None) -> pa.Table:
    """A stored table, or the rows of it that ``where`` (a pyarrow expression) selects, inside a worker."""
    from pyarrow import dataset, fs

    system, path = fs.FileSystem.from_uri(uri)
    return dataset.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=True).to_table(columns=columns, filter=where)


def keeps(owner: str, *drops: Callable[[], object]) -> None:
    """What an operator's tasks leave in a worker for the next ones, by how to drop it."""
    _KEPT[owner] = drops


def make_room(owner: str) -> None:
    """In a worker whose last task was another operator's: drops what all others keep there."""
    if _LATEST[0] == owner:
        return
    _LATEST[0] = owner
    for other, drops in _KEPT.items():
        if other != owner:
            for drop in drops:
                drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it: gives freed pages back
        ctypes.CDLL(None).malloc_trim(0)


def alone(owner: str, run):
    """``run`` for mapInArrow. Spark passes workers on from job to job, so without this several operators in one application take the memory of all together."""

    def task(batches):
        make_room(owner)
        yield from run(batches)

    return task


def by_place(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names: inside they are numbered, as Spark can't say some names there."""
    places = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def numbered(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=places.fieldNames())

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(numbered, places).toDF(*schema.fieldNames())


def in_slices(batches, rows: int = 256, text: int | None = None, most: int = 2**21):
    """Arrow batches in slices of at most ``rows``, so that long texts don't pile up in a worker. text: a column of which a slice holds ``most`` bytes at most, or one row."""
    for batch in batches:
        ends = None if text is None else pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0)).to_numpy()
        i = 0
        while i < batch.num_rows:
            stop = min(i + rows, batch.num_rows)
            if ends is not None:
                before = ends[i - 1] if i else 0
                stop = max(i + 1, min(stop, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(i, stop - i)
            i = stop


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
