"""SimHash near-duplicates by anchor-point covering, and connected components.

Fingerprints within four bits are within one bit in at least one of three
segments (21, 21, 22 bits). In a segment the anchors are a covering code of
radius one: the perfect Hamming code on 15 bits times all words on the rest.
Each fingerprint goes to every anchor within two bits (covering radius plus
the segment's threshold), so two linked fingerprints meet at the home anchor
of either; full distances are compared per anchor. No link is lost.

Scale: exact copies collapse first, so a hot group of copies is one
fingerprint. About 45 narrow rows a distinct fingerprint are shuffled by
anchor. Anchors with more than ``crowd`` fingerprints are dealt out as pairs of
chunks. Within an anchor, links come out as a spanning forest once a bucket is
large, not as all pairs. Components: alternating large-star and small-star
rounds over tables in the shared folder.

Defined cases: null texts are empty; texts without words have fingerprint 0 and
link like any other. Null document ids count for nothing in the minimum.
Repeated rows come out repeated. Empty tables give empty results; texts of any
length are read whole; other columns are left out, but pass ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import alone, in_slices, stored, unused

BITS = 4
#: Keys of rows to leave out that are broadcast at most, some 30 MB.
BROADCAST_KEYS = 1_000_000
#: (lowest bit, width) of the segments; BITS // len(SEGMENTS) is the threshold in one, 1.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, size: int = 4) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    k = min(size, n)
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches):
        for b in in_slices(batches, 256, 1):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(alone(__name__, run), "doc_id long, fp long")


def _syndrome(u: np.ndarray) -> np.ndarray:
    out = np.zeros_like(u)
    for i in range(15):
        out ^= np.where((u >> i) & 1, i + 1, 0)
    return out


def anchors_within_two(x: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of x, anchors) for all anchors within two bits of each segment value; the first pair holds home anchors."""
    u, free = x & 0x7FFF, width - 15
    s, rows, out = _syndrome(u), np.arange(len(x)), []
    near = np.where(s > 0, x ^ np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0), x)
    out.append((rows, near))
    out += [(rows, near ^ (1 << (15 + i))) for i in range(free)]
    on, off = rows[s == 0], rows[s > 0]
    out += [(on, x[on] ^ (1 << (15 + i)) ^ (1 << (15 + j))) for i in range(free) for j in range(i)]
    for i in range(1, 16):  # two flips on the code's side: positions i < j with i ^ j the syndrome
        j = s[off] ^ i
        ok = (j > i) & (j <= 15)
        out.append((off[ok], x[off[ok]] ^ (1 << (i - 1)) ^ np.left_shift(1, j[ok] - 1)))
    return out


def _replicate(batches):
    for b in in_slices(batches, 8192):
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, (low, width) in enumerate(SEGMENTS):
            x = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            found = anchors_within_two(x, width)
            rows = np.concatenate([r for r, _ in found])
            home = np.zeros(len(rows), dtype=bool)
            home[: len(x)] = True
            keys = (np.concatenate([a for _, a in found]) * len(SEGMENTS) + k).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _small_buckets(key, fp, home, start):
    """All links in buckets of at most 64, by comparing rows at each shift."""
    us, vs, live = [], [], np.arange(len(key))
    for shift in range(1, 64):
        live = live[live + shift < len(key)]
        live = live[key[live] == key[live + shift]]
        if not len(live):
            break
        other = live + shift
        ok = (home[live] | home[other]) & (np.bitwise_count(fp[live] ^ fp[other]) <= BITS)
        us.append(fp[live[ok]])
        vs.append(fp[other[ok]])
    return us, vs


def _large_bucket(fp, home):
    """A spanning forest: what a seed reaches leaves the pool, so dense groups cost little."""
    order = np.argsort(fp)
    left, left_home, us, vs = fp[order], home[order], [], []
    while left_home.any():
        at = int(np.argmax(left_home))
        root, todo = left[at], [left[at]]
        left, left_home = np.delete(left, at), np.delete(left_home, at)
        while todo and len(left):
            hit = np.bitwise_count(left ^ todo.pop()) <= BITS
            if hit.any():
                got = left[hit]
                us.append(np.full(len(got), root))
                vs.append(got)
                todo.extend(got)
                left, left_home = left[~hit], left_home[~hit]
    return us, vs


def _links(batches):
    """Rows sorted by bucket; a bucket may go over several batches."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table):
        key = t.column(0).to_numpy() * 4096 * 4096 + t.column(1).to_numpy() * 4096 + t.column(2).to_numpy()
        fp, home = t.column(3).to_numpy().view(np.uint64), t.column(4).to_numpy()
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(key)]
        big = np.flatnonzero(ends - starts > 64)
        small = np.repeat(ends - starts <= 64, ends - starts)
        us, vs = _small_buckets(key[small], fp[small], home[small], starts)
        for i in big:
            a, b = _large_bucket(fp[starts[i] : ends[i]], home[starts[i] : ends[i]])
            us += a
            vs += b
        if us and sum(map(len, us)):
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
        return None

    for b in batches:
        if not b.num_rows:
            continue
        same = (b.column(0).to_numpy() == b.column(0)[-1].as_py()) & (b.column(1).to_numpy() == b.column(1)[-1].as_py()) & (b.column(2).to_numpy() == b.column(2)[-1].as_py())
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            out = solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
            if out:
                yield out
        held.append(b.slice(cut))
    if held and (out := solve(pa.Table.from_batches(held))):
        yield out


def fingerprint_links(distinct: DataFrame, crowd: int = 20_000) -> DataFrame:
    """distinct: fp. Edges (u < v) that join all fingerprints within BITS, as a forest in large buckets."""
    spread = distinct.select("fp").mapInArrow(alone(__name__, _replicate), "anchor int, fp long, home boolean")
    crowded = spread.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor", F.least(F.lit(4000), F.ceil(F.col("count") / crowd) + 1).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        spread.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("c", chunk)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.col("anchor").cast("long").alias("anchor"), F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp", "home")
    )
    return dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(alone(__name__, _links), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes that have an edge. edges: u, v. Rounds go on until none changes an edge."""
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(now)
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = stored(small, "edges")
        got = mark(now)
        if got == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = got


def _grouped(fps: DataFrame) -> DataFrame:
    """fps: fp and others. (fp, root) of each distinct fingerprint: root is the same all over a component."""
    each = stored(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = components(fingerprint_links(each))
    return each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id."""
    fps = stored(fingerprints(docs), "fingerprints")
    rooted = stored(_grouped(fps), "roots")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = low.join(rooted, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, or of a null one if no row has any.

    Rows are told apart by id and text (a 64-bit hash of both), so rows that share an id but not a group are judged each
    on its own. Of rows that repeat an id and text one stays. No text is shuffled up to ``broadcast_keys`` rows to leave out.
    """
    key = unused("_key", docs)
    keyed = docs.select("*", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias(key))
    fps = stored(fingerprints(keyed.select(F.col(key).alias("doc_id"), "text")), "fingerprints").withColumnRenamed("doc_id", "key")
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = stored(fps.groupBy("key", "fp").agg(F.count("*").alias("n")).join(ids.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "key"), "rows")
    rooted = stored(_grouped(rows), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "key")
    first = rows.groupBy("fp").agg(F.min(order).alias("first")).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    judged = stored(rows.join(rooted.join(first, "root").select("fp", F.col("first.key").alias("stays")), "fp").filter("key <> stays or n > 1").select(F.col("key").alias(key), (F.col("key") == F.col("stays")).alias("again")), "judged")
    n, again = judged.agg(F.count("*"), F.count_if("again")).first()
    held = (lambda df: F.broadcast(df)) if n <= broadcast_keys else (lambda df: df)
    kept = keyed.join(held(judged.select(key)), key, "left_anti").drop(key)
    if again:
        kept = kept.unionByName(keyed.join(held(judged.filter("again").select(key)), key, "left_semi").dropDuplicates([key]).drop(key))
    return kept
