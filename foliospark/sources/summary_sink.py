"""A sink of page summaries that leaves each record once, whatever tasks fail and batches repeat.

Tasks write files of their own below ``data``; what counts is named by a manifest a
batch, put in place by one rename when all tasks are done. A file of a failed or
doubled task is in no manifest; a batch that comes again finds its manifest and
leaves nothing. Works for batch writes (option ``batch`` names it) and for streams.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliospark.sources.files import SUMMARY

FORMAT = "page_summaries"


@dataclass
class Written(WriterCommitMessage):
    name: str | None  # none where a task had no rows
    rows: int


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else f"/{path}")


class _Manifested:
    """Shared by both writers: ``write`` runs in tasks, the rest in the driver."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        system, root = _place(self.path)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        system.create_dir(f"{root}/data", recursive=True)
        with system.open_output_stream(f"{root}/data/{name}") as out:
            for row in chain([first], iterator):
                record = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                out.write((json.dumps(record, ensure_ascii=False, separators=(",", ":"), default=lambda v: v.isoformat()) + "\n").encode())
                rows += 1
        return Written(name, rows)

    def manifest(self, batch: str, messages: list) -> None:
        from pyarrow import fs

        system, root = _place(self.path)
        place = f"{root}/manifests/{batch}.json"
        if system.get_file_info(place).type != fs.FileType.NotFound:  # the batch is there already
            return self.discard(messages)
        system.create_dir(f"{root}/manifests", recursive=True)
        staged = f"{root}/manifests/.{batch}-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as out:
            out.write("".join(json.dumps({"file": m.name, "rows": m.rows}) + "\n" for m in messages if m and m.name).encode())
        system.move(staged, place)

    def discard(self, messages: list) -> None:
        system, root = _place(self.path)
        for m in (m for m in messages if m and m.name):
            system.delete_file(f"{root}/data/{m.name}")


class BatchWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.files, self.batch = _Manifested(path), batch

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages):
        self.files.manifest(self.batch, messages)

    def abort(self, messages):
        self.files.discard(messages)


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.files = _Manifested(path)

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages, batchId):
        self.files.manifest(str(batchId), messages)

    def abort(self, messages, batchId):
        self.files.discard(messages)


class PageSummaries(DataSource):
    """df.write.format("page_summaries").option("batch", ...).mode("append").save(path), or writeStream likewise."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options["path"])


def write_summaries_once(pages: DataFrame, path: str, batch: str) -> None:
    """Page summaries as the batch of that name; if it is there, nothing changes."""
    pages.sparkSession.dataSource.register(PageSummaries)
    pages.write.format(FORMAT).option("batch", batch).mode("append").save(path)


def read_summaries_once(spark: SparkSession, path: str) -> DataFrame:
    """The records of all whole batches. Files are chosen by a join with the manifests, so their number does not matter."""
    named = spark.read.schema("file string, rows long").json(f"{path}/manifests/*.json").select(F.col("file").alias("_file")).distinct()
    found = spark.read.schema(SUMMARY).json(f"{path}/data").withColumn("_file", F.col("_metadata.file_name"))
    return found.join(named, "_file", "left_semi").drop("_file")
