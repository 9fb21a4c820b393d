"""WARC archives with a two-level capture index.

Write: each task streams its captures into one archive of gzip members, one a
record; payloads seen under a smaller id become revisit records. The manifest
(key, file, offset, length) is a table in the shared folder, so that only files
of tasks that succeeded count. Index: the manifest is range-partitioned and
sorted by reversed-host key; a task writes its range as compressed blocks of
lines, then a sparse directory with the first key of each block. Look-up: the
list of index files (one row an index task) leads to a file, a binary search in
its directory to a block, which is read by range; a binary search in its lines
leads to a record, which is read by range again.

Scale: payloads are shuffled once, by id, to meet the revisit decision; digests
are counted in narrow rows with map-side combining, so a payload that a third of
all pages share is no hot group. Index keys hold the capture id, so that a hot
url or host splits over ranges. Index files follow the captures, about FILE_LINES
lines a file; only their list is broadcast, a row for so many captures. Workers
reach the shared folder by pyarrow.fs.

Defined cases: null html is the empty payload, null urls have the key ")/".
Rows that repeat an id and payload are all responses if that id is the smallest.
Null ids are never the smallest and never revisits. Payloads of any length are
stored whole; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import struct
import uuid
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import fresh_path, in_slices, lower_ascii, stored

LEAST_BYTES, BLOCK_LINES, FILE_LINES = 100, 512, 1_000_000
_DATE = "2024-01-01T00:00:00Z"  # captures carry no time of their own; a fixed one keeps files reproducible


def surt(url: Column) -> Column:
    """Reversed-host key: 'http://a.b.org/x?y' is 'org,b,a)/x?y'."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^(?:.*?://)?([^#]*)", 1), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    clean = F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))), r"[\x00-\x20]", "%20")
    return clean


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str):
    """An output stream under a name that no other attempt uses, and its uri."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, fs.open_output_stream(path, compression=None)


@lru_cache(maxsize=8)
def _open(uri: str):
    fs, path = _fs(uri)
    return fs.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    return _open(uri).read_at(length, offset)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, but its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat a payload of a smaller id."""
    html = F.coalesce("html", F.lit(""))
    digests = stored(pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).filter(F.col("bytes") >= LEAST_BYTES).select("page_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return digests.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives under folder; returns the manifest: key, page_id, file, offset, length."""
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload"), F.sha2(html, 256).alias("digest"), surt(F.col("url")).alias("key"))
    marked = full.join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "key", "refers_to")

    def run(batches):
        uri = out = None
        at = 0
        for b in in_slices(batches):
            rows = []
            for page_id, url, payload, digest, key, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    uri, out = _put(f"{folder}/archive", "part.warc.gz")
                data = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
                out.write(data)
                rows.append((f"{key} {-1 if page_id is None else page_id:020d}", page_id, uri, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(marked.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "manifest")


def write_index(manifest: DataFrame, folder: str, file_lines: int = FILE_LINES) -> DataFrame:
    """Sorted index files of compressed blocks with a block directory at their end; returns their list: first_key, file, offset, length of the directory."""

    def run(batches):
        out, directory, lines, at, uri = None, [], [], 0, None

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append(f"{lines[0].rpartition(chr(9))[0]}\t{at}\t{len(data)}")
            out.write(data)
            at += len(data)
            lines.clear()

        for b in in_slices(batches, 4096):
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    uri, out = _put(f"{folder}/index", "part.cdx")
                lines.append(f"{key}\t{file.rpartition('/')[2]} {offset} {length}")
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data + struct.pack("<QQ", at, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([uri]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], names=["first_key", "file", "offset", "length"])

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // file_lines))
    spread = manifest.select("key", "file", "offset", "length").repartitionByRange(n, "key").sortWithinPartitions("key")
    return stored(spread.mapInArrow(run, "first_key string, file string, offset long, length long"), "index-files")


@lru_cache(maxsize=16)
def _directory(uri: str, offset: int, length: int) -> tuple[list[str], list[tuple[int, int]]]:
    rows = [line.split("\t") for line in zlib.decompress(read_range(uri, offset, length)).decode().split("\n")]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


@lru_cache(maxsize=16)
def _block(uri: str, offset: int, length: int) -> tuple[list[str], list[str]]:
    rows = [line.split("\t") for line in zlib.decompress(read_range(uri, offset, length)).decode().split("\n")]
    return [r[0] for r in rows], [r[1] for r in rows]


def find(index: list[tuple[str, str, int, int]], key: str) -> list[tuple[str, int, int]]:
    """(archive, offset, length) of all captures with this key: binary searches in the file list, a directory and a block. index: sorted."""
    firsts = [r[0] for r in index]
    at = max(0, bisect.bisect_left(firsts, key) - 1)
    out: list[tuple[str, int, int]] = []
    for first, uri, offset, length in index[at:]:
        if first > key:
            break
        keys, places = _directory(uri, offset, length)
        for i in range(max(0, bisect.bisect_left(keys, key) - 1), len(keys)):
            if keys[i] > key:
                break
            names, rows = _block(uri, *places[i])
            for j in range(bisect.bisect_left(names, key), bisect.bisect_right(names, key)):
                file, a, b = rows[j].split(" ")
                out.append((file, int(a), int(b)))
    return out


def look_up(keys: DataFrame, index_files: DataFrame, folder: str) -> DataFrame:
    """keys: distinct key. One row a capture found: page_id, url, payload_bytes, payload_digest (of what was read), record_type, refers_to, whole."""
    held = keys.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in index_files.collect()))  # a row an index file, so one for FILE_LINES captures or a shuffle partition

    def run(batches):
        index = held.value
        for b in in_slices(batches, 1024):
            rows = []
            for key in b.column(0).to_pylist():
                for file, offset, length in find(index, key):
                    fields, body = parse_record(gzip.decompress(read_range(f"{folder}/archive/{file}", offset, length)))
                    page, said = fields["WARC-Record-ID"][10:-1], fields["WARC-Payload-Digest"].partition(":")[2]
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = said if revisit else hashlib.sha256(body).hexdigest()
                    n = int(fields["WARC-Payload-Length"]) if revisit else len(body)
                    rows.append((None if page == "None" else int(page), fields["WARC-Target-URI"], n, digest, fields["WARC-Type"], int(fields["WARC-Refers-To"][10:-1]) if revisit else None, digest == said))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"])

    # sorted keys: neighbours share directories, blocks and archives; a fixed number, as keys are small but each is a read
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean")


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives page_id, url, html; indexes the archives; reads every capture back through the index."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    index = write_index(manifest, folder)
    return look_up(manifest.select("key").distinct(), index, folder)
