"""Ranked lexical search: the best documents for each item of a query set, by presence masks.

A slice of documents holds a bitmap for each query term. For an item the bitmaps
of its terms group the documents by which terms they hold, their presence mask. No
document of a mask can score more than the mask's terms give at most in that slice,
so masks are taken by descending maximum until the next one is under the score of
the item's k-th best document so far; that score is kept from slice to slice, and
later ones leave most masks untouched.

Scale: one pass over the texts counts terms and keeps, for each document, its
length and how often each query term occurs; corpus figures (documents, length,
document frequencies) are Spark aggregates of that. A task returns k documents for
an item at most and these are merged in two steps, so no item gathers more than
k rows for each task. Items are read in blocks of ``block_terms`` distinct terms;
each block is a pass of its own, so the vocabulary in a worker is bounded.

Defined cases: null and empty texts have no terms and are not counted. Documents are
rows: rows that repeat an id are ranked each, a null id stands after all others. An
item without terms has no rows; an item row that is wholly repeated counts once, and
rows that share an item_id but not the text are ranked each on their own. Other
columns are not read. Equal scores go by ascending doc_id, and a mask whose maximum
equals the k-th score is still looked into. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import in_slices, stored

#: Bytes that are part of a term, A-Z lower-cased; any other is a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Cells of the table of contributions that a worker holds at a time, 9 bytes each.
_CELLS = 2**22
#: Groups in which the tasks' results are merged first.
_MERGE = 64
_POSTINGS = "doc_id long, n long, term array<int>, tf array<int>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text) and, of the vocabulary's terms that it holds, their numbers and how often, for each document with a term."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(batches):
        known = vocabulary.__contains__
        for b in in_slices(batches, 1024, 1):
            ids, sizes, held, often = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    found = Counter(filter(known, words))
                    ids.append(i)
                    sizes.append(len(words))
                    held.append([vocabulary[t] for t in found])
                    often.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, sizes, held, often), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


class _Best:
    """The k best documents so far, by descending score and ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        use = score >= self.least
        s, i, z = (np.r_[a, b[use]] for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, z, -s))[: self.k]
        self.score, self.id, self.null = s[order], i[order], z[order]


def _search(best: _Best, own: np.ndarray, weight: np.ndarray, held: np.ndarray, given: np.ndarray, most: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
    """Adds a slice's documents to an item's best. own: rows of its terms in held (bitmaps of documents), given (contributions) and most (their largest). The number of documents scored."""
    bits = np.unpackbits(held[own], axis=1, count=len(ids))
    masks, group = np.unique(np.ascontiguousarray(np.packbits(bits, axis=0).T), axis=0, return_inverse=True)
    bound = np.unpackbits(masks, axis=1, count=len(own)).astype(np.int64) @ (weight * most[own])
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_place = np.argsort(place[group.ravel()], kind="stable")
    ends = np.cumsum(np.bincount(group.ravel(), minlength=len(order))[order])
    bound, at, start, step = bound[order], 0, 0, 16
    while at < len(order) and bound[at] >= best.least:
        stop = min(len(order), at + step)
        stop = at + int(np.searchsorted(-bound[at:stop], -best.least, "right"))  # those under the least are left out
        docs = by_place[start : ends[stop - 1]]
        best.add(weight @ given[np.ix_(own, docs)], ids[docs], null[docs])
        at, start, step = stop, int(ends[stop - 1]), 2 * step
    return start


def _tops(held_docs: DataFrame, items: list[tuple[int, int | None, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """A task's best documents for each item. items: number, item_id, (term, times)."""
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    lists = [(np.array([t for t, _ in ts]), np.array([c for _, c in ts], dtype=np.int64)) for _, _, ts in items]

    def run(batches):
        best = [_Best(k) for _ in items]
        for b in in_slices(batches, max(256, min(4096, _CELLS // max(1, len(weights))))):
            counts = np.diff(b.column(2).offsets.to_numpy())
            rows = np.repeat(np.arange(b.num_rows), counts)
            used, line = np.unique(b.column(2).flatten().to_numpy(), return_inverse=True)
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * b.column(1).to_numpy() * n_docs // length
            given = np.zeros((len(used), b.num_rows), np.int64)
            given[line, rows] = 1_000_000_000 * tf // (1000 * tf + 12 * m[rows])
            there = np.zeros(given.shape, bool)
            there[line, rows] = True
            held, most = np.packbits(there, axis=1), given.max(axis=1, initial=0)
            at = np.full(len(weights), -1)
            at[used] = np.arange(len(used))
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            for (own, times), found in zip(lists, best, strict=True):
                own, times = own[at[own] >= 0], times[at[own] >= 0]
                if len(own):
                    _search(found, at[own], times * weights[own], held, given, most, ids, null)
        for (number, item_id, _), found in zip(items, best, strict=True):
            size = len(found.score)
            yield pa.RecordBatch.from_arrays([pa.array([number] * size, pa.int32()), pa.array([item_id] * size, pa.int64()), pa.array(found.id, pa.int64(), mask=found.null), pa.array(found.score)], schema=schema)

    return held_docs.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def _blocks(items: DataFrame, block_terms: int):
    """Items in blocks of about so many distinct terms: (number, item_id, Counter of terms)."""
    block, seen = [], set()
    for number, r in enumerate(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator()):
        own = Counter(terms(r.text))
        if own:
            if block and len(seen | own.keys()) > block_terms:
                yield block
                block, seen = [], set()
            block.append((number, r.item_id, own))
            seen |= own.keys()
    if block:
        yield block


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy("item", *group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 16_384) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. item_id, rank from 1, doc_id, score of each item's k best documents with a score above 0."""
    parts = []
    for block in _blocks(items, block_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in block for t in own}))}
        held = stored(postings(docs, vocabulary), "postings")
        n_docs, length = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in held.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
            df[r.t] = r.n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        numbered = [(number, i, [(vocabulary[t], c) for t, c in own.items()]) for number, i, own in block]
        parts.append(_tops(held.filter(F.size("term") > 0), numbered, weights, n_docs, length, k))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_MERGE)))
    return _ranked(_ranked(found, k, "part").drop("rank"), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
