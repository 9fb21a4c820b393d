"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so plain Jaccard of the two is tiny. Items are
partitioned by their number of shingles (a class holds sizes up to a power of
two, u). For each class a document is seen through windows of 1.5 u shingles that
start every u/2: a copied passage lies whole in one of them, where its Jaccard
similarity is about a quarter at least, so one of PERMUTATIONS single-row MinHash
bands agrees with probability 1 - 1e-6. Candidates are verified by exact
containment of the item's shingles in the whole document.

Shingles are five words (of fewer words: the whole sequence), words the runs of
letters and digits with A-Z lower-cased, so case and punctuation don't hide a copy.

Scale: one narrow pass over the documents a block of items; distinct item texts
are dealt to blocks by a running total of their shingles, which bounds what is
broadcast whatever copies or huge items the benchmark holds. Only found pairs
leave a task; the items' ids join them after that.

Defined cases: null texts have no shingles and match nothing; items without words
are left out. Repeated items or documents give repeated pairs. Null and repeated
ids are reported as they stand; ``decontaminate`` judges each row by its own text
and passes all columns. Empty tables give empty results (an empty benchmark finds
nothing); texts of any length are read whole.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import ALNUM, alone, by_place, in_slices, keeps, stored

SIZE, PERMUTATIONS = 5, 48
#: Runs of ASCII letters and digits and of bytes beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class _WordHashes(dict):
    """word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 1)
        return h


_HASHES = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").encode().lower())  # bytes: only A-Z are lower-cased
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of fewer words the whole sequence."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, 0x9E3779B97F4A7C15 + k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i : n - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


#: Odd multipliers; x -> a * x is a permutation of the 64-bit numbers.
_A = (np.random.RandomState(7).randint(0, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class ItemIndex:
    """MinHash signatures of a block of items by size class, with their shingles for the exact check."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.sets, classes = [], [], {}
        for item_id, text in items:
            s = np.unique(shingles(word_hashes(text)))
            if len(s):
                u = 2
                while u < len(s):
                    u *= 2
                classes.setdefault(u, []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(s)
        self.classes = {}
        for u, members in classes.items():
            bands = []
            for a in _A:
                low = np.array([(self.sets[i] * a).min() for i in members], dtype=np.uint64)
                order = np.argsort(low, kind="stable")
                maybe = np.zeros(1 << 16, dtype=bool)  # leading bits that occur at all
                maybe[low >> np.uint64(48)] = True
                bands.append((low[order], np.array(members)[order], maybe))
            self.classes[u] = bands

    def search(self, texts: list[str | None], least: float) -> list[tuple[int, object, int, int]]:
        """(place in texts, item id, shingles shared, shingles of the item) of the items contained. Windows of all texts go together."""
        sets = [shingles(word_hashes(t)) for t in texts]
        sizes = np.array([len(s) for s in sets])
        if not sizes.sum() or not self.ids:
            return []
        flat, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
        steps = {}
        for u in self.classes:  # a window is three half-class steps of one text, fewer at its end
            n = -(-sizes // (u // 2))
            owner = np.repeat(np.arange(len(sizes)), n)
            starts = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (u // 2)
            at, last = np.arange(len(owner)), np.repeat(np.cumsum(n) - 1, n)
            steps[u] = starts, owner, np.minimum(at + 1, last), np.minimum(at + 2, last)
        candidates: set[tuple[int, int]] = set()
        for j, a in enumerate(_A):
            h = flat * a
            for u, (starts, owner, second, third) in steps.items():
                low = np.minimum.reduceat(h, starts)
                low = np.minimum(low, np.minimum(low[second], low[third]))
                keys, members, maybe = self.classes[u][j]
                hits = np.flatnonzero(maybe[low >> np.uint64(48)])
                left, right = np.searchsorted(keys, low[hits]), np.searchsorted(keys, low[hits], "right")
                for k in np.flatnonzero(right > left):
                    candidates.update((int(owner[hits[k]]), int(m)) for m in members[left[k] : right[k]])
        out, of, have = [], -1, None
        for d, i in sorted(candidates):
            if d != of:
                of, have = d, np.unique(sets[d])
            own = self.sets[i]
            n = int((have[np.minimum(np.searchsorted(have, own), len(have) - 1)] == own).sum())
            if n >= least * len(own):
                out.append((d, self.ids[i], n, len(own)))
        return out


def _blocks(benchmark: DataFrame, block_shingles: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Distinct item texts (key, text) by block, and the blocks: each holds about ``block_shingles`` item shingles at most, or one text.

    A hash deals texts to buckets of about a block's size; in a bucket the running total of shingles cuts blocks.
    """
    texts = benchmark.filter(F.lower("text").rlike(ALNUM)).select("text").distinct().select(F.xxhash64("text").alias("key"), "text", (F.length("text") / 5 + 1).cast("long").alias("size"))
    texts = stored(texts, "items")
    buckets = 1 + (texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // block_shingles)
    so_far = F.sum("size").over(Window.partitionBy("bucket").orderBy("size", "key"))  # by size: a huge text comes last, on its own
    dealt = texts.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).withColumn("part", F.floor((so_far - 1) / block_shingles).cast("int"))
    dealt = stored(dealt, "item-blocks")
    return dealt, [(r.bucket, r.part) for r in dealt.groupBy("bucket", "part").count().select("bucket", "part").orderBy("bucket", "part").collect()]  # a row a block


def _held(spark, dealt: DataFrame, block: tuple[int, int]):
    """A block of items for the workers; its size is bounded by how blocks are cut."""
    rows = dealt.filter((F.col("bucket") == block[0]) & (F.col("part") == block[1])).select("key", "text").toLocalIterator()
    return spark.sparkContext.broadcast([(r.key, r.text) for r in rows])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for documents (doc_id, text) that hold at least ``least`` of an item's (item_id, text) shingles."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt, blocks = _blocks(benchmark, block_shingles)
    found = None
    for block in blocks:
        one = own.mapInArrow(alone(__name__, _searcher(_held(docs.sparkSession, dealt, block), least)), "doc_id long, key long, n_shared long, n_item long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return own.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item")).filter("false")
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("key"))
    return found.join(ids, "key").select("doc_id", "item_id", "n_shared", "n_item")


_INDEX: dict[str, ItemIndex] = {}
keeps(__name__, _INDEX.clear, _HASHES.clear)


def _index(token: str, held) -> ItemIndex:
    """One index a worker."""
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = ItemIndex(held.value)
    return _INDEX[token]


def _searcher(held, least: float):
    token = uuid.uuid4().hex

    def run(batches):
        for b in in_slices(batches, 256, 1):
            ids = b.column(0).to_pylist()
            rows = [(ids[d], *rest) for d, *rest in _index(token, held).search(b.column(1).to_pylist(), least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "key", "n_shared", "n_item"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_shingles: int = 2_000_000) -> DataFrame:
    """The rows of docs whose text holds no item, whatever their ids: a narrow filter a block of items, no shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    dealt, blocks = _blocks(benchmark, block_shingles)
    for block in blocks:
        held, token = _held(docs.sparkSession, dealt, block), uuid.uuid4().hex

        def run(batches, held=held, token=token):
            for b in in_slices(batches, 256, at):
                bad = np.zeros(b.num_rows, dtype=bool)
                bad[[d for d, *_ in _index(token, held).search(b.column(at).to_pylist(), least)]] = True
                yield b.filter(pa.array(~bad))

        docs = by_place(docs, alone(__name__, run), schema)
    return docs
