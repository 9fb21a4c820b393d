"""Quality rules: plain counts, then n-gram perplexity in bands by language.

The model is a modified Kneser-Ney model of characters, order 5, counted by Spark over
all texts, each distinct text of a language once. A language's texts fall into two
folds by hash, copies together; each fold has a model of its own and scores the
other's texts, so no text is judged by a model that it taught. Characters and not words: a word model
of this corpus has a distinct bigram for every two words and a distinct trigram
for four in five, by estimate more than the disk it is allowed. Its log probabilities and back-off weights are stored as whole multiples
of 1 / UNIT in a table in the shared folder, sorted by the 64-bit hash of the
n-gram; a worker reads it into sorted hash arrays with a directory by the leading
bits. If the arrays would be over ``model_bytes``, scoring joins each document's
n-gram counts with the table instead. Sums of whole numbers don't depend on their
order, so both ways give the same log probabilities to the last bit.

Bands: a language's centre and spread are the median and the scaled median
deviation of its documents' mean log probabilities, over the distinct texts that
pass the plain counts; a language with fewer than LEAST of them has no band. A document's mean may differ by WIDTH spreads and by Z
standard errors of its length; beyond that its perplexity is too high (noise) or
too low (repetition) and it is rejected. Copies move neither model nor band.

Scale: one pass finds the hashes of repeated rows, one counts (n-gram counts are
summed before the shuffle, so a hot language or text is no hot group; a row with
n copies counts 1/n in each, so none must be picked), one scores. No text is
shuffled, unless the repeated hashes are over ``repeat_bytes``: then distinct
texts are made by a shuffle, with the same result.

Defined cases: null text is empty, null lang is the language "". A text whose language
has no text in the other fold is not scored (log_prob null) and kept if it passes the plain counts. Every row counts
on its own; ids may be null or repeated; columns named like own ones pass ``keep_good``.
An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import alone, by_place, in_slices, keeps, stored, unused

ORDER, WIDTH, Z = 5, 3.0, 2.0
#: Steps of a unit of log probability in which medians are taken.
GRID = 4096
#: Steps of a unit of log probability in which the model is stored.
UNIT = 2**20
#: Hashes of repeated rows that a worker loads at most, 16 bytes each.
REPEAT_BYTES = 128 * 2**20
#: A row a language is broadcast up to so many, some hundred kB.
BROADCAST_LANGS, SALTS = 5000, 64
#: Distinct texts that pass the plain counts, from which on a language has bands.
LEAST = 20
#: Stands between a language and the number of its fold in the name of a model.
_FOLD = "\x1f"
_PAD, _END = "\x02", "\x03"
_SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


# -- counts of a text


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()  # ASCII white space only
    blank = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in text.split("\n") if x.encode().strip(_SPACES)] if "\n" in text else []
    return len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes], k: int = 3) -> int:
    """Words in windows of k that the text has twice or more."""
    if len(words) <= k:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(words):
        return 0
    window = np.zeros(len(words) - k + 1, dtype=np.int64)
    for i in range(k):
        window = window * len(ids) + codes[i : len(words) - k + 1 + i]
        if i < k - 1:  # keep numbers small: one id for each run so far
            window = np.unique(window, return_inverse=True)[1]
    _, inverse, n = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[inverse] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for i in range(k):
        covered[hit + i] = True
    return int(covered.sum())


# -- counting and the model


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(f"{_PAD * (ORDER - 1)}{t}{_END}" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)


def _hash(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k codes that end at each position from k - 1 on."""
    n = len(codes) - k + 1
    return _mixed([codes[i : n + i] for i in range(k)], n, seed)


def _hash_at(codes: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k codes from each of the places."""
    return _mixed([codes[starts + i] for i in range(k)], len(starts), seed)


def _mixed(columns, n: int, seed: int) -> np.ndarray:
    """Hash of each of n rows, given a column for each place."""
    h = np.full(n, seed, dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _seed(lang: str, kind: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode(), 17 + kind)


def _clean(text: str | None) -> str:
    return (text or "").replace(_PAD, " ").replace(_END, " ")


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(batch.column(0).to_pylist()):
        out.setdefault(lang or "", []).append(i)
    return out


def row_key() -> Column:
    return F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def _other(name: str) -> str:
    """The model of a language's other fold."""
    return name[:-1] + ("0" if name[-1] == "1" else "1")


def _scored_by(lang: str | None, key: int) -> str:
    """The model that scores a row: that of the fold it is not in."""
    return f"{lang or ''}{_FOLD}{1 - key % 2}"


def distinct_rows(docs: DataFrame, repeat_bytes: int | None = None) -> tuple[DataFrame, str | None]:
    """(key, lang, text) and where the copies of each repeated key are written; None if every row counts whole. lang is the name of the model that the text teaches: language and fold."""
    fold = F.concat(F.coalesce("lang", F.lit("")), F.lit(_FOLD), F.pmod(row_key(), F.lit(2)).cast("string"))
    rows = docs.select(row_key().alias("key"), fold.alias("lang"), "text")
    repeats = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeats")
    n = repeats.count()
    if 16 * n > (REPEAT_BYTES if repeat_bytes is None else repeat_bytes):
        return rows.dropDuplicates(["key"]), None
    return rows, _uri(repeats) if n else None


@lru_cache(maxsize=1)
def _repeats(uri: str) -> tuple[np.ndarray, np.ndarray]:
    table = _read(uri).sort_by("key")
    return table.column("key").to_numpy(), 1.0 / table.column("n").to_numpy()


def _shares(keys: pa.Array, uri: str | None) -> np.ndarray:
    """What each row counts: one divided by its copies."""
    out = np.ones(len(keys))
    if uri:
        known, share = _repeats(uri)
        own = keys.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        out[hit] = share[at[hit]]
    return out


def _whole(c: Column) -> Column:
    """A sum of shares as the whole number that it is but for rounding."""
    return F.ceil(F.sum(c) - 0.001).cast("long")


def count_ngrams(rows: DataFrame, repeats: str | None) -> DataFrame:
    """rows and repeats of distinct_rows. (lang, gram, c) for all character n-grams of the highest order, texts padded at both ends."""

    def run(batches):
        for b in in_slices(batches, 2048, 1):  # the more at a time, the fewer rows come out
            texts, shares = b.column(1).to_pylist(), _shares(b.column(2), repeats)
            for lang, rows in _by_lang(b).items():
                parts = [f"{_PAD * (ORDER - 1)}{_clean(texts[i])}{_END}" for i in rows]
                joined = "".join(parts)
                codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
                h = _hash(codes, ORDER, 1)
                order = np.argsort(h, kind="stable")
                ranked = h[order]
                starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                first = order[starts]
                c = np.add.reduceat(np.repeat(shares[rows], [len(p) for p in parts])[order], starts)
                real = codes[first + ORDER - 1] != ord(_PAD)
                grams = [joined[i : i + ORDER] for i in first[real].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(c[real])], names=["lang", "gram", "c"])

    return rows.select("lang", "text", "key").mapInArrow(alone(__name__, run), "lang string, gram string, c double").groupBy("lang", "gram").agg(_whole("c").alias("c"))


def _whole_units(logp: Column) -> Column:
    return F.round(logp * UNIT).cast("int")


def _with_language(table: DataFrame, rows: DataFrame, langs: int, by: str = "gram") -> DataFrame:
    """``table`` joined with one row a language: broadcast up to BROADCAST_LANGS of them, beyond dealt by a salt of its column ``by`` too, as one language may have a third of all."""
    if langs <= BROADCAST_LANGS:
        return table.join(F.broadcast(rows), "lang")
    salt = F.pmod(F.hash(by), F.lit(SALTS)).alias("salt")
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return table.withColumn("salt", salt).join(salted, ["lang", "salt"]).drop("salt")


def _level(table: DataFrame, langs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, ctx, part) and (lang, ctx, weight): discounted share of a context, and what the context leaves for lower orders."""
    count = lambda i: F.sum((F.col("c") == i).cast("double")).alias(f"n{i}")
    n = [F.col(f"n{i}") for i in range(5)]
    y = n[1] / F.greatest(n[1] + 2 * n[2], F.lit(1.0))
    bounded = lambda i, v: F.greatest(F.lit(0.1), F.least(F.lit(float(i) - 0.05), F.coalesce(v, F.lit(0.5 * i)))).alias(f"d{i}")
    cut = table.groupBy("lang").agg(*(count(i) for i in (1, 2, 3, 4))).select("lang", *(bounded(i, F.when(n[i] > 0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)))
    grams = _with_language(table.withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)")), cut, langs)
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    total = grams.groupBy("lang", "ctx").agg(F.sum("c").alias("tot"), F.sum(d).alias("left"))
    shares = grams.join(total, ["lang", "ctx"]).select("lang", "gram", "ctx", "c", ((F.col("c") - d) / F.col("tot")).alias("part"))
    return shares, total.select("lang", "ctx", (F.col("left") / F.col("tot")).alias("weight"))


def train(docs: DataFrame, distinct: tuple[DataFrame, str | None] | None = None) -> tuple[DataFrame, DataFrame, dict[int, DataFrame]]:
    """distinct: distinct_rows(docs), if known. The stored model (h, v) in order of h; bands (lang, mean, deviation, unknown); and by order what the model holds: (kind, lang, gram, v), n-grams as kind 0, contexts as kind 1. lang is the name of a model."""
    levels = {ORDER: stored(count_ngrams(*(distinct or distinct_rows(docs))), "ngrams")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the characters seen before an n-gram
        levels[k] = stored(levels[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), "ngrams")
    langs = levels[1].select("lang").distinct().count()
    held, unknown, lower = {}, None, None
    for k in range(1, ORDER + 1):
        rows = []
        shares, weights = _level(levels[k], langs)
        if k == 1:
            size = levels[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("uniform"))
            unknown = weights.join(size, "lang").select("lang", _whole_units(F.log(F.col("weight") * F.col("uniform"))).alias("unknown"))
            under = _with_language(shares.join(weights, ["lang", "ctx"]), size.withColumnRenamed("uniform", "below"), langs)
        else:
            suffix = lower.select("lang", F.col("gram").alias("suffix"), F.exp("logp").alias("below"))
            under = shares.join(weights, ["lang", "ctx"]).withColumn("suffix", F.expr("substring(gram, 2)")).join(suffix, ["lang", "suffix"])
            rows.append(weights.select(F.lit(1).alias("kind"), "lang", F.col("ctx").alias("gram"), _whole_units(F.log("weight")).alias("v")))
        lower = stored(under.select("lang", "gram", "c", F.log(F.col("part") + F.col("weight") * F.col("below")).alias("logp")), "logp")
        rows.append(lower.select(F.lit(0).alias("kind"), "lang", "gram", _whole_units(F.col("logp")).alias("v")))
        held[k] = reduce(DataFrame.unionByName, rows)
    n, mean = F.sum("c"), F.sum(F.col("c") * F.col("logp")) / F.sum("c")
    square = F.sum(F.col("c") * F.col("logp") * F.col("logp")) / n
    bands = stored(lower.groupBy("lang").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("deviation")).join(unknown, "lang").coalesce(1), "bands")

    def hashed(batches):
        for b in batches:
            h = _row_hashes(*(b.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), b.column(3)], names=["h", "v"])

    table = reduce(DataFrame.unionByName, held.values()).mapInArrow(alone(__name__, hashed), "h long, v int")
    return stored(table.repartitionByRange("h").sortWithinPartitions("h"), "model"), bands, held


def held_out_values(held: dict[int, DataFrame], bands: DataFrame) -> DataFrame:
    """(lang, gram, v): what each n-gram of a fold is worth to the other fold's model, backing off as a worker does. For models too large for a worker."""
    seen = held[ORDER].filter("kind = 0")
    flipped = F.concat(F.expr("substring(lang, 1, length(lang) - 1)"), F.when(F.col("lang").endswith("1"), "0").otherwise("1"))
    langs = bands.select("lang", "unknown")
    todo = _with_language(seen.select(flipped.alias("lang"), "gram"), langs, langs.count()).withColumn("v", F.lit(0)).select("lang", "gram", "unknown", "v")
    found = []
    for k in range(ORDER, 0, -1):
        own = held[k].filter("kind = 0").select("lang", F.col("gram").alias("part"), F.col("v").alias("own"))
        at = stored(todo.withColumn("part", F.expr(f"right(gram, {k})")).join(own, ["lang", "part"], "left"), "held-out")
        found.append(at.filter("own is not null").select("lang", "gram", (F.col("v") + F.col("own")).alias("v")))
        todo = at.filter("own is null").select("lang", "gram", "unknown", "v", "part")
        if k > 1:
            weight = held[k].filter("kind = 1").select("lang", F.col("gram").alias("ctx"), F.col("v").alias("off"))
            todo = todo.withColumn("ctx", F.expr(f"left(part, {k - 1})")).join(weight, ["lang", "ctx"], "left").select("lang", "gram", "unknown", (F.col("v") + F.coalesce("off", F.lit(0))).alias("v"))
    found.append(todo.select("lang", "gram", (F.col("v") + F.col("unknown")).alias("v")))
    return stored(reduce(DataFrame.unionByName, found), "held-out-values")


def _row_hashes(kinds: list[int], langs: list[str], grams: list[str]) -> np.ndarray:
    """Hash of each n-gram under its language and kind; rows of one kind, language and length go together."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(kinds, langs, map(len, grams), strict=True)):
        groups.setdefault(key, []).append(i)
    out = np.zeros(len(grams), dtype=np.uint64)
    for (kind, lang, k), rows in groups.items():
        codes = np.frombuffer("".join([grams[i] for i in rows]).encode("utf-32-le"), dtype=np.uint32).reshape(-1, k)
        out[rows] = _mixed(codes.T, len(rows), _seed(lang, kind))
    return out


# -- scoring


def _directory(h: np.ndarray, bits: int, step: int = 2**16) -> np.ndarray:
    """Where in sorted h each pattern of leading bits starts; made piece by piece, so that no long array is made on the way."""
    out = np.empty(2**bits, dtype=np.int32)
    for i in range(0, len(out), step):
        heads = np.arange(i, min(i + step, len(out)), dtype=np.uint64) << np.uint64(64 - bits)
        out[i : i + step] = np.searchsorted(h, heads)
    return out


class Model:
    """Sorted hash arrays, with a directory of where each leading bit pattern starts."""

    def __init__(self, model_uri: str, bands_uri: str):
        files = _files(model_uri)
        sizes = [f.count_rows() for f in files]
        self.h, self.v = np.empty(sum(sizes) + 1, dtype=np.uint64), np.zeros(sum(sizes) + 1, dtype=np.int32)
        self.h[-1], at = ~np.uint64(0), 0
        for f in files:  # one after another: a worker holds the arrays and a batch
            for b in f.to_batches(columns=["h", "v"], batch_readahead=1, fragment_readahead=1):
                self.h[at : at + b.num_rows] = b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
                self.v[at : at + b.num_rows] = b.column(1).to_numpy()
                at += b.num_rows
        if (self.h[1:] < self.h[:-1]).any():
            raise ValueError("the model's files are not in order")
        self.bits = max(4, int(len(self.h)).bit_length() - 1)
        self.start = _directory(self.h[:-1], self.bits)
        self.bands = {r["lang"]: r for r in _read(bands_uri).to_pylist()}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        at = self.start[h >> np.uint64(64 - self.bits)]
        got = self.h[at]
        rest = np.flatnonzero(got < h)
        while len(rest):
            at[rest] += 1
            got[rest] = self.h[at[rest]]
            rest = rest[got[rest] < h[rest]]
        return self.v[at], got == h

    def log_probs(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """In UNITs, for each position from ORDER - 1 on."""
        out = np.zeros(len(codes) - ORDER + 1, dtype=np.int64)
        todo = np.empty(0, dtype=np.int64)
        for k in range(ORDER, 0, -1):
            if k == ORDER:
                v, ok = self.find(_hash(codes, k, _seed(lang, 0)))
                out[ok], todo = v[ok], np.flatnonzero(~ok)
            else:
                v, ok = self.find(_hash_at(codes, todo + ORDER - k, k, _seed(lang, 0)))
                out[todo[ok]] += v[ok]
                todo = todo[~ok]
            if not len(todo):
                return out
            if k > 1:
                v, ok = self.find(_hash_at(codes, todo + ORDER - k, k - 1, _seed(lang, 1)))
                out[todo] += np.where(ok, v, 0)
        out[todo] += self.bands[lang]["unknown"]
        return out

    def means(self, lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability of each text's characters and its end, and their number. A sum of whole numbers, divided once."""
        n = np.array([len(t) + 1 for t in texts])
        codes = _codes(texts)
        p = self.log_probs(lang, codes)
        ends = np.cumsum(n + ORDER - 1) - (ORDER - 1)  # past each text's last value
        total = np.add.reduceat(p, np.stack([ends - n, np.minimum(ends, len(p) - 1)], axis=1).ravel())[::2] if len(texts) else p
        total[-1:] = p[ends[-1] - n[-1] :].sum()
        return total / n / UNIT, n


def _dataset(uri: str):
    from pyarrow import dataset, fs

    where, path = fs.FileSystem.from_uri(uri)
    return dataset.dataset(path, filesystem=where, format="parquet", exclude_invalid_files=True)


def _read(uri: str) -> pa.Table:
    return _dataset(uri).to_table()


def _files(uri: str) -> list:
    """Fragments in order of their names, which is that of Spark's partitions."""
    return sorted(_dataset(uri).get_fragments(), key=lambda f: f.path)


@lru_cache(maxsize=1)
def _model(model_uri: str, bands_uri: str) -> Model:
    return Model(model_uri, bands_uri)


def _uri(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0]


def _scores(batch: pa.RecordBatch, model_uri: str, bands_uri: str) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_prob, size) a row; batch: lang, text, key first."""
    model = _model(model_uri, bands_uri)
    texts = [t or "" for t in batch.column(1).to_pylist()]
    counts = [base_counts(t) for t in texts]
    means, sizes = np.full(len(texts), np.nan), np.ones(len(texts), dtype=np.int64)
    by: dict[str, list[int]] = {}
    for i, (lang, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        by.setdefault(_scored_by(lang, key), []).append(i)
    for name, rows in by.items():
        if name in model.bands:
            means[rows], sizes[rows] = model.means(name, [_clean(texts[i]) for i in rows])
    return [(*c, c[0] < 50 or 100 * c[4] > 50 * c[0], None if np.isnan(m) else float(m), int(n)) for c, m, n in zip(counts, means, sizes, strict=True)]


def _joined_means(distinct: tuple[DataFrame, str | None], values: DataFrame) -> DataFrame:
    """(key, log_prob, size) of each distinct row that has a model, by joining n-gram counts with held_out_values: for models too large for a worker."""
    rows, repeats = distinct

    def run(batches):
        for b in in_slices(batches, 64, 2):
            for key, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                joined = f"{_PAD * (ORDER - 1)}{_clean(text)}{_END}"
                codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
                _, first, n = np.unique(_hash(codes, ORDER, 1), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(first)), pa.array([_other(lang)] * len(first)), pa.array([joined[i : i + ORDER] for i in first.tolist()]), pa.array(n)], names=["key", "lang", "gram", "n"])

    grams = rows.select("key", "lang", "text").mapInArrow(alone(__name__, run), "key long, lang string, gram string, n long")
    each = F.sum(F.col("n").cast("decimal(20,0)") * F.col("v"))  # exact; each copy adds the same
    sums = grams.join(values, ["lang", "gram"]).groupBy("key").agg(each.alias("total"), F.sum("n").alias("size"))
    if repeats:
        copies = rows.sparkSession.read.parquet(repeats).withColumnRenamed("n", "copies")
        sums = sums.join(copies, "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).select("key", F.expr("total div copies").alias("total"), F.expr("size div copies").alias("size"))
    return sums.select("key", (F.col("total").cast("double") / F.col("size") / UNIT).alias("log_prob"), "size")


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_FIELDS = f"{_COUNTS}, base_failed boolean, kept boolean, log_prob double"
_SCORED = f"{_COUNTS}, base_failed boolean, log_prob double, size long"
_TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64())


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _centres(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """scored: key, lang, base_failed, log_prob. (lang, deviation, centre, spread): each distinct text that passes the plain counts once; medians of rounded values, so that a language is no large group."""
    good = scored.filter("not base_failed and log_prob is not null").select("key", "lang", "log_prob").dropDuplicates(["key"])
    at = stored(good.groupBy("lang", (F.round(F.col("log_prob") * GRID) / GRID).alias("at")).agg(F.count("*").alias("n")), "histogram")
    centre = at.groupBy("lang").agg(F.percentile("at", 0.5, F.col("n")).alias("centre"), F.sum("n").alias("texts")).filter(F.col("texts") >= LEAST).drop("texts")
    away = at.join(centre, "lang").groupBy("lang", "centre").agg((1.4826 * F.percentile(F.abs(F.col("at") - F.col("centre")), 0.5, F.col("n"))).alias("spread"))
    language = F.expr("substring(lang, 1, length(lang) - 2)")
    return stored(bands.groupBy(language.alias("lang")).agg(F.avg("deviation").alias("deviation")).join(away, "lang", "left").coalesce(1), "centres")


def _banded(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """scored (lang as in bands) with kept."""
    centres = _centres(scored, bands)
    inside = F.abs(F.col("log_prob") - F.col("centre")) <= WIDTH * F.col("spread") + Z * F.col("deviation") / F.sqrt("size")
    joined = _with_language(scored, centres, centres.count(), "key")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def _scored(docs: DataFrame, model: DataFrame, bands: DataFrame) -> DataFrame:
    """docs: key, lang, text. (key, lang, *_SCORED, *other columns), stored."""
    uris = _uri(model), _uri(bands)
    others = [f for f in docs.schema if f.name not in ("key", "lang", "text")]
    schema = T.StructType([*T.StructType.fromDDL(f"key long, lang string, {_SCORED}"), *others])
    names = schema.fieldNames()

    def run(batches):
        for b in in_slices(batches, 256, 1, 2**19):  # some ten arrays as long as a slice's texts live at once
            rows = _scores(b, *uris)
            lang = pa.array([x or "" for x in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(2), lang, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)), *b.columns[3:]], names=names)

    own = docs.select("lang", "text", "key", *(f.name for f in others))
    return stored(own.mapInArrow(alone(__name__, run), schema), "scores")


def judge(docs: DataFrame, model_bytes: int = 256 * 2**20, repeat_bytes: int | None = None) -> DataFrame:
    """docs: doc_id, lang, text. doc_id with the counts, base_failed, kept, and log_prob, the mean of a character."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    distinct = distinct_rows(own, repeat_bytes)
    model, bands, held = train(own, distinct)
    size = model.count()
    if not size:
        return own.select("doc_id").mapInArrow(lambda batches: iter(()), f"doc_id long, {_FIELDS}")
    own = own.withColumn("key", row_key())
    scored = _scored_by_join(own, distinct, held_out_values(held, bands)) if 12 * size > model_bytes else _scored(own, model, bands)
    return _banded(scored, bands).select("doc_id", *_names(_FIELDS))


def _scored_by_join(own: DataFrame, distinct: tuple[DataFrame, str | None], values: DataFrame) -> DataFrame:
    names = ["doc_id", "key", "lang", *_names(_COUNTS)]

    def run(batches):
        for b in in_slices(batches):
            counts = [base_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5))], names=names)

    counts = own.select("lang", "text", "doc_id", "key").mapInArrow(alone(__name__, run), f"doc_id long, key long, lang string, {_COUNTS}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored(counts.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("base_failed", failed).join(_joined_means(distinct, values), "key", "left"), "scores")


def keep_good(docs: DataFrame, model_bytes: int = 256 * 2**20, repeat_bytes: int | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, in the same passes. Scores are stored by the hash of a row, and the hashes of those to leave out are joined or, up to repeat_bytes, loaded by the workers."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    distinct = distinct_rows(own, repeat_bytes)
    model, bands, held = train(own, distinct)
    size = model.count()
    if not size:
        return docs
    own = own.withColumn("key", row_key())
    scored = _scored_by_join(own.withColumn("doc_id", F.col("key")), distinct, held_out_values(held, bands)) if 12 * size > model_bytes else _scored(own, model, bands)
    bad = stored(_banded(scored, bands).filter("not kept").select("key").distinct(), "rejected")
    n = bad.count()
    if not n:
        return docs
    name = unused("_key", docs)
    keyed = docs.select("*", row_key().alias(name))
    if 16 * n > (REPEAT_BYTES if repeat_bytes is None else repeat_bytes):
        return keyed.join(bad.withColumnRenamed("key", name), name, "left_anti").drop(name)
    uri, at = _uri(bad), len(docs.columns)

    def run(batches):
        known = _rejected(uri)
        _model.cache_clear()  # a reused worker may still hold the model
        for b in batches:
            own = b.column(at).to_numpy(zero_copy_only=False)
            found = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            yield b.select(range(at)).filter(pa.array(~found))

    return by_place(keyed, alone(__name__, run), docs.schema)


@lru_cache(maxsize=1)
def _rejected(uri: str) -> np.ndarray:
    return np.sort(_read(uri).column("key").to_numpy())


keeps(__name__, _model.cache_clear, _repeats.cache_clear, _rejected.cache_clear)
