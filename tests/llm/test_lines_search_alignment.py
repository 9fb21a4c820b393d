"""Ranked search, line dedup and token alignment against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import by_name, lower, oracle, rows_of, same

from foliospark.llm import line_dedup, ranked_search, token_alignment
from foliospark.llm.queries import QUERIES, vocabulary
from foliospark.llm.shared import stored


@pytest.fixture(scope="module")
def docs(spark, sf):
    return rows_of(spark, sf)


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# -- op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=20):
    words = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, length = sum(map(bool, words)), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in sorted(set(items), key=repr):
        own = TERM.findall(lower(text))
        scored = []
        for (doc_id, _), c, w in zip(docs, counts, words, strict=True):
            m = 75 + 25 * len(w) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def item_rows(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    odd = [(None, "the the THE of mit license"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "?!"), (10**6 + 3, "lorem ipsum école ÉCOLE 日本語 lorem"), (10**6 + 3, "one two"), (10**6 + 3, "one two"), (10**6 + 4, " ".join(f"w{i}" for i in range(3000)))]
    return items.unionByName(spark.createDataFrame(odd, items.schema)).withColumn("n", F.lit("clash"))


@pytest.mark.parametrize("block_terms", [16_384, 150])
def test_search(spark, sf, docs, local, block_terms):
    items = item_rows(spark, sf)
    same(ranked_search.search(docs, items, block_terms=block_terms), plain_search(local, [(r.item_id, r.text) for r in items.collect()]))


def test_search_of_nothing(spark, sf, docs, empty):
    items = item_rows(spark, sf)
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.filter("text = ''"), items).count() == 0
    assert ranked_search.search(docs, items).dtypes == ranked_search.search(docs, items.limit(0)).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_with_ties_copies_and_two_steps_of_merging(spark):
    texts = ["alpha beta", "alpha beta", "alpha", "beta gamma delta", "unrelated words here", "alpha " * 50] * 40
    local = [(i % 200, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(local, "doc_id long, text string").repartition(40)
    items = [(1, "alpha beta beta"), (2, "gamma"), (3, "absent")]
    for k in (1, 20, 1000):
        same(ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k), plain_search(local, items, k))


def test_masks_under_the_best_are_left_alone():
    rng = np.random.default_rng(3)
    there = rng.random((12, 4000)) < 0.2
    there[:, :30] = True
    given = np.where(there, rng.integers(1, 1000, there.shape), 0)
    ids, null = np.arange(4000), np.zeros(4000, bool)
    weight = rng.integers(1, 50, 12)
    best = ranked_search._Best(20)
    seen = ranked_search._search(best, np.arange(12), weight, np.packbits(there, axis=1), given, given.max(axis=1), ids, null)
    order = np.lexsort((ids, -(weight @ given)))[:20]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == (weight @ given)[order].tolist()
    assert seen < 4000
    assert ranked_search._search(best, np.arange(12), weight, np.packbits(there, axis=1), given // 1000, given.max(axis=1) // 1000, ids, null) == 0


# -- op12


def plain_lines(rows, min_chars=1, min_docs=10, keep_first=False):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held, first = defaultdict(set), {}
    for doc_id, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            held[key(x)].add(("i", doc_id) if doc_id is not None else ("t", text or ""))
            place = (doc_id is not None, doc_id or 0, text or "", i)  # rows of one id are told apart by text
            first[key(x)] = min(first.get(key(x), place), place)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and not (keep_first and first[key(x)] == (doc_id is not None, doc_id or 0, text or "", i)) for i, x in enumerate(lines)]
        out.append((doc_id, text, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


LINES = [(10**7 + i, "\n".join(["  Subscribe NOW\t", f"own line {i}", "", "subscribe now", "end" if i % 2 else "End "])) for i in range(40)]
SAME = "Subscribe now\n\x0bÉnd\n subscribe NOW \n"


def test_lines(spark, docs, local, empty):
    more = spark.createDataFrame([*LINES, (None, SAME), (10**7, SAME)], "doc_id long, text string")
    for c in docs.columns[2:]:
        more = more.withColumn(c, F.lit(None))
    rows = docs.unionByName(more).withColumn("row", F.lit("clash")).withColumn("n_dropped", F.lit(True)).withColumn("h1", F.lit(0))
    known = [*local, *LINES, (None, SAME), (10**7, SAME)]
    got = line_dedup.drop_lines(rows)
    assert got.columns == [*rows.columns, "n_lines", "_n_dropped"]
    same(got.select("doc_id", "n_lines", "_n_dropped", "text"), [(d, n, k, t) for d, _, n, k, t in plain_lines(known)])
    same(line_dedup.drop_lines(rows, 4, 15).select("doc_id", "n_lines", "_n_dropped", "text"), [(d, n, k, t) for d, _, n, k, t in plain_lines(known, 4, 15)])
    assert line_dedup.drop_lines(empty).count() == 0 and line_dedup.keep_bitmaps(empty).count() == 0


def test_first_lines_stay(spark):
    rows = [(i, t) for i, t in LINES] + [(10**7 - 1, "END\nx\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_lines(df, min_docs=2, keep_first=True)
    same(got.select("doc_id", "n_lines", "n_dropped", "text"), [(d, n, k, t) for d, _, n, k, t in plain_lines(rows, 1, 2, True)])


def test_hot_line_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_LEAST", 20)
    rng = random.Random(5)
    rows = [(i % 2900, "\n".join(rng.choice(["hot", "HOT ", f"l{rng.randrange(500)}", f"u{i}"]) for _ in range(6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = line_dedup.hot_keys(line_dedup.line_hashes(df)).collect()
    assert 1 <= len(hot) <= 32 and max(r.blocks for r in hot) > 4
    held = Counter(x for _, x in {(i, y.strip().lower()) for i, t in rows for y in t.split("\n")})
    dropped = sum(k for _, _, _, k, _ in plain_lines(rows))
    for first, stay in ((False, 0), (True, sum(n >= 10 for n in held.values()))):
        assert line_dedup.drop_lines(df, keep_first=first).agg(F.sum("n_dropped")).first()[0] == dropped - stay
    same(line_dedup.drop_lines(df).select("doc_id", "n_lines", "n_dropped", "text"), [(d, n, k, t) for d, _, n, k, t in plain_lines(rows)])


def test_bitmaps_are_runs(spark):
    rows = [(i, f"a\nb\nown {i}\na\nc\nc") for i in range(12)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and all([tuple(x) for x in r.dropped] == [(0, 2), (3, 3)] and r.n_dropped == 5 for r in got)


def test_lines_plan_has_no_python(spark, sf):
    plan = line_dedup.drop_lines(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# -- op13


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    from foliospark.llm.bpe import byte_letters

    letters = byte_letters()
    a_bytes = {i: bytes(letters[c] for c in s) for s, i in t.get_vocab().items() if all(c in letters for c in s)}
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc_id, text in rows:
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        data = f" {text}".encode()
        if not text or b"".join(a_bytes[i] for i in a) != data or b"".join(map(b_bytes, b)) != data:
            a, b = [], []
        groups, i, j, x, y = [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                ga.append(a[i])
                x += len(a_bytes[a[i]])
                i += 1
            else:
                gb.append(b[j])
                y += len(b_bytes(b[j]))
                j += 1
            if x == y and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((doc_id, a, b, groups))
    count = Counter(p for _, _, _, gs in docs for p in {(u, w) for ga, gb in gs for u in ga for w in gb})
    best = defaultdict(int)
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    for doc_id, a, b, gs in docs:
        links = [(u, w) for ga, gb in gs for u in ga for w in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        yield doc_id, len(a), len(b), len(gs), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if gs else ""


STRANGE = [(1, "<|endoftext|> <s> <unk> </s>"), (2, "a▁b"), (3, "ﬁ Å ½  two  spaces \t\n tab"), (4, " "), (5, "𝕏🎉🎉 ñandú Straße 日本語テスト"), (6, "\x00\x01 nul"), (7, "é combining"), (8, "0x41 <0x41> AAAA"), (9, "zq" * 3000), (None, "plain words"), (9, "plain words")]


@pytest.mark.parametrize("block_pairs", [token_alignment.BLOCK_PAIRS, 400])
def test_alignment(spark, docs, local, block_pairs):
    more = spark.createDataFrame(STRANGE, "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.lit(1).alias("n_a"), F.lit("x").alias("pairs")).unionByName(more.withColumn("n_a", F.lit(2)).withColumn("pairs", F.lit("y")))
    got = token_alignment.align_documents(rows, vocabulary(), vocabulary("piece_bpe_32k.model"), block_pairs)
    same(got, list(plain_alignment([*local, *STRANGE])))


def test_both_encoders_of_a_file_agree():
    """Every code point in several surroundings, and long runs: ids as ranks give what the file's own library gives."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    fast = token_alignment.vocabularies(vocabulary(), vocabulary("piece_bpe_32k.model")).encode_a
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    mixed = ["".join(rng.choice("ab cd 'll's\n\t\r\x0b\u3000éß日本1२!?<|endoftext|>\u0301🎉") for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts = [" " + "".join(f"a{c}1{c} {c}b!{c}" for c in points[i : i + 50]) for i in range(0, len(points), 50)] + mixed + ["x" * 50_000, " " * 50_000, "é!" * 20_000]
    for i in range(0, len(texts), 2000):
        assert fast(texts[i : i + 2000]) == [e.ids for e in t.encode_batch(texts[i : i + 2000], add_special_tokens=False)]


def test_alignment_of_nothing(spark, empty):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    paths = vocabulary(), vocabulary("piece_bpe_32k.model")
    assert token_alignment.align_documents(empty, *paths).count() == 0
    same(token_alignment.align_documents(none, *paths), [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)])


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    p, q = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    a, b = rng.integers(0, 5, p.sum()), rng.integers(0, 5, q.sum())
    doc = np.sort(rng.integers(0, 4, 50))
    args = a, b, np.cumsum(p) - p, np.cumsum(q) - q, p, q, doc
    plain = token_alignment._irregular(*args)
    for most in (1, 7, 40):
        monkeypatch.setattr(token_alignment, "_SPELT", most)
        again = token_alignment._irregular(*args)
        assert all(np.array_equal(x, y) for x, y in zip((*plain[0], plain[1]), (*again[0], again[1]), strict=True))


def test_vector_and_pairs_share_no_link(spark, sf):
    """A link along the identity map is in the vector alone, also where a larger group holds it."""
    paths = vocabulary(), vocabulary("piece_bpe_32k.model")
    kept = stored(token_alignment.document_links(spark.read.parquet(f"{sf}/documents.parquet"), *paths), "test-links")
    v = token_alignment.vocabularies(*paths)
    assert all(v.same[r.p >> 32] != r.p & 0xFFFFFFFF for r in kept.filter("not vector").select(F.explode("pairs").alias("p")).distinct().collect())
    held = kept.filter("not vector").select(F.explode("same_ids").alias("a")).groupBy("a").count()
    same(kept.filter("vector").select(F.explode(F.arrays_zip("same_ids", "same_n")).alias("x")).groupBy("x.same_ids").agg(F.sum("x.same_n")), [tuple(r) for r in held.collect()])


# -- the queries


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_line_dedup"])
def test_queries_return_what_their_sql_does(spark, sf, name):
    got = by_name(QUERIES[name](spark, sf))
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")}
    same(got, oracle(name, **tables))


def test_alignment_query(spark, sf):
    got = QUERIES["op13_token_alignment"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    same(got, list(plain_alignment([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])))
