"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers cut the same bytes; where a token of each ends, the text is cut
into groups, and every token of one side in a group is linked with every one of the
other. Most groups hold one token each, with equal bytes. For those a table from an
A id to the B id of the same bytes is made beforehand: a link along it needs no
pair, only the A id, and its documents are counted in a vector as long as the
vocabulary. Only the other, irregular links are pairs that a shuffle counts.

Scale: one pass tokenizes and keeps, for each document, its distinct links with their
numbers; a task adds its vector as one more row at its end. Pairs are summed before
the shuffle, so a pair that all documents hold is one row a task. The vector and the
largest count of each A id are as long as A's vocabulary, and no longer. The pair counts, sorted by pair, are looked up by the workers
in blocks of ``block_pairs`` (16 bytes each), one pass over the kept links a
block, so neither memory nor shuffle grows with them; links are never joined.

Defined cases: a null or empty text, and one that either tokenizer doesn't give
back byte by byte, has no tokens: zeros and ''. Special tokens' strings in texts
are plain text. Each row is a document, whatever its id. Other columns are not read.
An empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import PATTERN, byte_letters
from foliospark.llm.shared import in_slices, read_back, stored, uri_of

#: Pair counts that a worker holds, 16 bytes each.
BLOCK_PAIRS = 4 * 2**20
#: Links of one irregular group that are spelt out; larger groups are counted by distinct ids.
_SPELT = 2**20
_LINKS = [("same_ids", "array<int>"), ("same_n", "array<int>"), ("pairs", "array<bigint>"), ("pairs_n", "array<bigint>")]
_KEPT = [("vector", "boolean"), ("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", "string"), *_LINKS]
_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


class Vocabularies:
    """Both tokenizers with the bytes of their tokens, and ``same``: the B id with the bytes of an A id, -1 if none."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for said, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in said) if all(c in letters for c in said) else said.encode()
        self.encode_a = _encoder(a_path, {self.a_bytes[i]: i for said, i in vocab.items() if all(c in letters for c in said)}, model["merges"], vocab)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        of = {}
        for i in range(len(self.b_bytes) - 1, -1, -1):
            if self.b_bytes[i] and not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i):
                of[self.b_bytes[i]] = i
        self.same = np.array([of.get(x, -1) for x in self.a_bytes], dtype=np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.said_a, self.said_b = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.said_same = [f"{i}|{j}" for i, j in enumerate(self.same.tolist())]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none for a text that a side doesn't give back."""
        spaced, out = [f" {t}" for t in texts], []
        for text, a, b in zip(spaced, self.encode_a(spaced), self.b.encode(texts, num_threads=1), strict=True):
            data = text.encode()
            whole = len(data) > 1 and b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
            out.append((a, b) if whole else ([], []))
        return out


def _encoder(path: str, ranks: dict[bytes, int], merges: list, vocab: dict[str, int]):
    """Texts to lists of ids. Where merges come in the order of the ids they make, as in byte-level files of this kind, ids are ranks and the faster library reads them; else the file's own does."""
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if all(i < j for i, j in zip(made, made[1:], strict=False)) and len(ranks) == 256 + len(made):
        import tiktoken

        one = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [one(t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_padding()
    whole.no_truncation()
    return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order, first key first, and the sums of n."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    return tuple(k[new] for k in keys), np.add.reduceat(n[order], np.flatnonzero(new))


def _irregular(a: np.ndarray, b: np.ndarray, a_from, b_from, p, q, doc) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((document, pair), links) of groups with p tokens from a_from on one side and q from b_from on the other."""
    docs, pairs, n = [], [], []
    large = p * q > _SPELT
    for g in np.flatnonzero(large):
        (ua, ca), (ub, cb) = (np.unique(x[i : i + k], return_counts=True) for x, i, k in ((a, a_from[g], p[g]), (b, b_from[g], q[g])))
        pairs.append((ua[:, None] << 32 | ub).ravel())
        n.append((ca[:, None] * cb).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    a_from, b_from, p, q, doc = (x[~large] for x in (a_from, b_from, p, q, doc))
    for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(p * q) // _SPELT)) + 1):
        size = (p * q)[part]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(q[part], size)
        left, right = np.repeat(a_from[part], size) + inner // np.maximum(wide, 1), np.repeat(b_from[part], size) + inner % np.maximum(wide, 1)
        key, sums = _summed((np.repeat(doc[part], size), a[left] << 32 | b[right]), np.ones(len(left), dtype=np.int64))
        docs.append(key[0])
        pairs.append(key[1])
        n.append(sums)
    return _summed((np.concatenate(docs), np.concatenate(pairs)), np.concatenate(n))


def _lists(doc: np.ndarray, values: np.ndarray, size: int, kind: pa.DataType) -> pa.Array:
    """Values, in order of their documents, as a list for each document."""
    offsets = np.searchsorted(doc, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def align(v: Vocabularies, texts: list[str | None]) -> tuple[list[pa.Array], np.ndarray]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, same_ids, same_n, pairs, pairs_n; and how many documents hold each A id's link along the identity map."""
    size = len(texts)
    ids = v.encode([t or "" for t in texts])
    n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in (0, 1))
    all_a, all_b = ([i for x in ids for i in x[k]] for k in (0, 1))
    a, b = np.array(all_a, dtype=np.int64), np.array(all_b, dtype=np.int64)
    a_end, b_end = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_to, b_to = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1
    p, q = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
    a_from, b_from = a_to - p, b_to - q
    doc = np.repeat(np.arange(size), n_a)[a_from] if len(a) else np.empty(0, np.int64)
    single = (p == 1) & (q == 1)
    plain = single & (v.same[a[a_from]] == b[b_from]) if len(a) else single
    rest = np.flatnonzero(~plain)
    (pair_doc, pair), pair_n = _irregular(a, b, a_from[rest], b_from[rest], p[rest], q[rest], doc[rest])
    on_map = v.same[pair >> 32] == (pair & 0xFFFFFFFF)  # in a larger group, but along the map
    same_key, same_n = _summed((np.r_[doc[plain], pair_doc[on_map]], np.r_[a[a_from[plain]], pair[on_map] >> 32]), np.r_[np.ones(plain.sum(), np.int64), pair_n[on_map]])
    pair_doc, pair, pair_n = pair_doc[~on_map], pair[~on_map], pair_n[~on_map]
    said = [v.said_same[i] for i in a[a_from].tolist()] if len(a) else []
    said_a, said_b = v.said_a, v.said_b
    for g, i, j, k, m in zip(rest.tolist(), a_from[rest].tolist(), a_to[rest].tolist(), b_from[rest].tolist(), b_to[rest].tolist(), strict=True):
        said[g] = f"{','.join([said_a[t] for t in all_a[i:j]])}|{','.join([said_b[t] for t in all_b[k:m]])}"
    cuts = np.searchsorted(doc, np.arange(size + 1)).tolist()
    digests = [hashlib.sha256(";".join(said[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:], strict=False)]
    links = np.zeros(size, dtype=np.int64)
    np.add.at(links, doc, p * q)
    counts = [n_a, n_b, np.diff(cuts), links]
    columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), _lists(same_key[0], same_key[1], size, pa.int32()), _lists(same_key[0], same_n, size, pa.int32()), _lists(pair_doc, pair, size, pa.int64()), _lists(pair_doc, pair_n, size, pa.int64())]
    return columns, np.bincount(same_key[1].astype(np.int64), minlength=len(v.same))


def document_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs: doc_id, text. A row a document with its counts, digest and distinct links; and a row a task (vector true) with the documents of each A id in same_ids and same_n."""
    schema = pa.schema([(c, _ARROW[t]) for c, t in _KEPT])

    def run(batches):
        v = vocabularies(a_path, b_path)
        vector = np.zeros(len(v.same), dtype=np.int64)
        for b in in_slices(batches, 256, 1):
            columns, held = align(v, b.column(1).to_pylist())
            vector += held
            yield pa.RecordBatch.from_arrays([pa.array([False] * b.num_rows), b.column(0), *columns], schema=schema)
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_pylist([{"vector": True, "same_ids": ids.tolist(), "same_n": vector[ids].tolist()}], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _KEPT))


def _by_id(rows: DataFrame, size: int) -> np.ndarray:
    """(id, n) rows, one for each A id at most, as a vector."""
    out = np.zeros(size, dtype=np.int64)
    for r in rows.toLocalIterator():
        out[r[0]] = r[1]
    return out


@lru_cache(maxsize=1)
def _counts(uri: str, least: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs from least to under below, and their counts."""
    import pyarrow.compute as pc

    table = read_back(uri, ["pair", "n"], (pc.field("pair") >= least) & (pc.field("pair") < below)).sort_by("pair")
    return table.column("pair").to_numpy(), table.column("n").to_numpy()


def _scored(kept: DataFrame, uri: str | None, least: int, below: int, vector: np.ndarray | None, best: np.ndarray) -> DataFrame:
    """Adds to n_best and count_sum what links along the map (if vector is given) and pairs from least to under below give."""
    schema = pa.schema([(c, _ARROW[t]) for c, t in [*_KEPT, ("n_best", "bigint"), ("count_sum", "bigint")]])
    at = {c: i for i, c in enumerate(schema.names)}

    def run(batches):
        for b in in_slices(batches, 1024):
            add = np.zeros((2, b.num_rows), dtype=np.int64)
            sides = [("same_ids", "same_n")] * (vector is not None) + [("pairs", "pairs_n")] * (uri is not None)
            for ids_of, n_of in sides:
                ids, n = (b.column(at[c]).flatten().to_numpy().astype(np.int64) for c in (ids_of, n_of))
                row = np.repeat(np.arange(b.num_rows), np.diff(b.column(at[ids_of]).offsets.to_numpy()))
                if ids_of == "same_ids":
                    a, count = ids, vector[ids]
                else:
                    use = (ids >= least) & (ids < below)
                    ids, n, row = ids[use], n[use], row[use]
                    known, counts = _counts(uri, least, below)
                    a, count = ids >> 32, counts[np.searchsorted(known, ids)]
                np.add.at(add[0], row, n * (count == best[a]))
                np.add.at(add[1], row, n * count)
            sums = [pa.array(b.column(at[c]).to_numpy() + x) for c, x in zip(("n_best", "count_sum"), add, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *sums], schema=schema)

    return kept.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*_KEPT, ("n_best", "bigint"), ("count_sum", "bigint")]))


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document. a_path: a byte-level BPE file; b_path: a sentencepiece model; every worker has both."""
    kept = stored(document_links(docs, a_path, b_path), "links")
    size = len(vocabularies(a_path, b_path).same)
    rows = kept.filter("not vector").drop("vector").select(F.lit(False).alias("vector"), *[c for c, _ in _KEPT[1:]]).withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    vector = _by_id(kept.filter("vector").select(F.explode(F.arrays_zip("same_ids", "same_n")).alias("x")).groupBy("x.same_ids").agg(F.sum("x.same_n")), size)
    counts = stored(kept.filter("not vector").select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).repartitionByRange("pair").sortWithinPartitions("pair"), "pair-counts")
    by_a = stored(counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"), F.count("*").alias("pairs")), "pair-best")
    best = np.maximum(vector, _by_id(by_a.select("a", "most"), size))
    held = np.cumsum(_by_id(by_a.select("a", "pairs"), size))
    bounds = [0] if held[-1] else []
    while bounds and bounds[-1] < size:  # A ids up to which a block goes
        before = held[bounds[-1] - 1] if bounds[-1] else 0
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(held, before + block_pairs, "right"))))
    blocks = [(uri_of(counts), i << 32, j << 32) for i, j in zip(bounds, bounds[1:], strict=False)] or [(None, 0, 0)]
    for i, (uri, least, below) in enumerate(blocks):
        rows = _scored(rows if not i else stored(rows, "scored"), uri, least, below, None if i else vector, best)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
