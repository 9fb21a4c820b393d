"""What has to hold for long texts, crowded pages and classes, large files, and streams that go on."""

import json
import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_pages import png

from foliospark.functions import distance, models
from foliospark.operators import components, quality, raster, regions, report, training
from foliospark.plans import registry
from foliospark.plans.fixtures import table
from foliospark.sources import files, summary_sink
from foliospark.streaming import jobs

# -- look-ups


def strips_and_artefacts(spark, n):
    strips = spark.createDataFrame([("p", f"title_{i // 40:03d}_word_{i:05d}_strip.png") for i in range(n)] + [("q", "a_word_1_strip.png")] * 2, "stem string, name string")
    rows = [("p", "binarized", f"title_{i // 40:03d}_word_{i:05d}_strip_binarized.png", f"b{i}") for i in range(0, n, 2)] + [("p", "block", f"title_{i:03d}_block.png", f"k{i}") for i in range(n // 40)]
    rows += [("p", "layout", "z.png", "l2"), ("p", "layout", "a.png", "l1"), ("q", "craft", "a_craft.png", "c"), ("q", "craft", "other_craft.png", "x"), ("q", "original", "a_word_1.png", None)]
    return strips, spark.createDataFrame(rows, "stem string, kind string, name string, path string")


def test_artefacts_of_a_crowded_page(spark):
    n = 5000
    got = report.attach_artefacts(*strips_and_artefacts(spark, n)).collect()
    assert len(got) == n + 2
    for r in (r for r in got if r.stem == "p"):
        i = int(r.name.split("_word_")[1][:5])
        assert (r.binarized, r.block, r.original, r.page, r.page_image) == (f"b{i}" if i % 2 == 0 else "", f"k{i // 40}", "", "l1", "")
    assert [(r.craft, r.original, r.page) for r in got if r.stem == "q"] == [("c", "", "")] * 2


def test_artefact_work_is_linear(spark):
    """The join makes five rows a strip, whatever else lies on the page."""
    for n in (1000, 4000):
        df = report.attach_artefacts(*strips_and_artefacts(spark, n))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and plan.count("Join") == 2


def test_artefacts_of_odd_names(spark):
    """Names without blocks, suffixes or pages, the first path of several, and strips that come twice: as looked up one by one."""
    names = ["a_word_1_strip.png", "a_word_1_strip.png", "x_wo_strip.pngrd_1", "strip", ".png", "a.b_word_2.c", "_word_", "a_strip.png", "", None]
    stems = ["p", "q", None]
    keys = ["a_word_1_strip_binarized.png", "x_wo_strip_binarized.png", "strip_mat_debug.png", ".png_binarized.png", "a.b_word_2_binarized.png", "a_block.png", "a.b_craft.png", "x_block.png", "_block.png", "a_word_1.png", "strip", "_word_", "", None, "layout.png"]
    held = [(p, kind, k, f"{kind}{i}{j}") for j, p in enumerate(stems) for i, k in enumerate(keys) for kind in ("binarized", "original", "block", "craft", "debug", "layout", "other") if (i + j) % 3] + [("p", "block", "a_block.png", "1"), ("q", "page", "z", None)]
    stem = lambda n: re.sub(r"(?<=.)\.[^.]*$", "", n)
    block = lambda n: n.replace("_strip.png", "").split("_word_")[0]
    asked = {"binarized": lambda n: stem(n) + "_binarized.png", "original": lambda n: n.replace("_strip.png", ".png") if "_word_" in n else n, "block": lambda n: block(n) + "_block.png", "craft": lambda n: block(n) + "_craft.png", "debug": lambda n: stem(n) + "_mat_debug.png"}
    first = lambda p, kind, of: min((path for q, k, key, path in held if path and p is not None and (q, k) == (p, kind) and of(key)), default="")
    want = [(p, n, *(first(p, kind, lambda key: n is not None and key == f(n)) for kind, f in asked.items()), first(p, "layout", lambda _: True), "") for p in stems for n in names]  # noqa: B023
    got = report.attach_artefacts(spark.createDataFrame([(p, n) for p in stems for n in names], "stem string, name string"), spark.createDataFrame(held, "stem string, kind string, name string, path string"))
    assert got.columns == ["stem", "name", *asked, "page", "page_image"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_strips_are_not_copied_by_key(spark, sf):
    """Strips and artefacts are dealt out by page; five copies of each strip went through shuffles before."""
    plan = registry.QUERIES["artefact_lookup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"stem#\d+", by) for by in dealt)


# -- edit distance


def matrix(a, b):
    """The last row of the distance matrix, row by row."""
    places = np.arange(len(b) + 1)
    row = places.copy()
    other = np.array([hash(x) for x in b])
    for i, x in enumerate(a, 1):
        best = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (other != hash(x)))]
        row = np.minimum.accumulate(best - places) + places
    return int(row[-1])


def replay(a, b, script):
    out, at = [], 0
    for kind, i, j in script:
        out += a[at:i]
        at = i + (kind != "ins")
        out += [] if kind == "del" else [b[j]]
    return out + list(a[at:])


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text("abé🎉 ", max_size=40), st.text("abé🎉 ", max_size=40), st.sampled_from([2**25, 60, 5]))
def test_distances_and_scripts(a, b, cells):
    d = matrix(a, b)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(distance, "_CELLS", cells)
        script = distance.edit_script(a, b)
    assert distance.edit_distance(a, b) == d == len(script) and replay(list(a), b, script) == list(b)
    x, y = distance.tokens(a), distance.tokens(b)
    assert distance.edit_distance(x, y) == matrix(x, y)


def test_distances_of_long_texts():
    rng = random.Random(2)
    a = "".join(rng.choice("the quick brown fox") for _ in range(60_000))
    b = "".join(c for c in a if rng.random() > 0.05).replace("q", "g") + "x" * 1000
    began = time.time()
    d = distance.edit_distance(a, b)
    assert time.time() - began < 30
    assert abs(len(a) - len(b)) <= d <= 8000
    short = a[:3000], b[:2800]
    assert distance.edit_distance(*short) == matrix(*short)


def garbled(rng, n, words=("the", "other", "one", "école", "日本", "of", "book", "e", "\n")):
    """n texts, each with what two recognisers make of it, and a third garbled at random."""
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    noise = lambda t: "".join(rng.choice(["", c + c, "x", c]) if rng.random() < 0.1 else c for c in t)
    return texts, [t.replace("e", "c") for t in texts], [t.replace("th", "h").replace("o", "0") for t in texts], [noise(t) for t in texts]


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.text("abé🎉 ", max_size=40), st.text("abé🎉 ", max_size=40)), max_size=12), st.sampled_from([(2**22, 512), (30, 3)]))
def test_settled_distances_are_right(pairs, limits):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(distance, "_CHARS", limits[0])
        m.setattr(distance, "_BAGS", limits[1])
        got = distance.settled([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert len(got) == len(pairs) and all(d in (-1, matrix(a, b)) for d, (a, b) in zip(got, pairs, strict=True))


def test_kinds_of_many_texts():
    """Those of a script, also of texts with more than 256 and 65,536 different characters, and of halves of surrogates."""
    texts, mat, raw, noise = garbled(random.Random(11), 60)
    many = ["".join(map(chr, range(0x4E00, 0x4E00 + n))) + "eothe" for n in (300, 600)] + ["".join(map(chr, range(0x20000, 0x20000 + 66_000))) + "eo"]
    texts, said = texts * 3 + many + ["\ud800e", ""], mat + raw + noise + [t.replace("e", "c")[3:] for t in many] + ["\ud800c", "ab"]
    script = lambda s, t: [k for k, _, _ in distance.edit_script(s, t)]
    want = [tuple(script(s, t).count(k) for k in ("ins", "del", "sub")) for s, t in zip(texts, said, strict=True)]
    assert distance.edit_kinds(texts, said) == want


def test_kinds_of_recognised_texts_need_no_columns(monkeypatch):
    """Texts whose bags of characters decide; a script of each by columns took seconds a megabyte."""
    texts, mat, raw, _ = garbled(random.Random(12), 40)
    texts, mat, raw = ([*s, "".join(s) * 8] for s in (texts, mat, raw))
    monkeypatch.setattr(distance, "_columns", None)
    n_e, n_t, n_o = ([t.count(x) for t in texts] for x in ("e", "th", "o"))
    assert distance.edit_kinds(texts, mat) == [(0, 0, e) for e in n_e]
    assert distance.edit_kinds(texts, raw) == [(0, t, o) for t, o in zip(n_t, n_o, strict=True)]


def test_distances_of_many_texts(monkeypatch):
    """Those of a matrix; where the bags decide, without columns."""
    texts, mat, raw, noise = garbled(random.Random(13), 60)
    pairs = texts * 3, mat + raw + noise
    want = [matrix(s, t) for s, t in zip(*pairs, strict=True)]
    assert distance.edit_distances(*pairs) == want
    monkeypatch.setattr(distance, "_columns", None)
    assert distance.edit_distances(texts * 2, mat + raw) == want[:120]


def test_error_rates_are_of_whole_texts(spark):
    rng = random.Random(4)
    words = ["the", "other", "one", "école", "日本", "of", "book", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) + rng.choice(["", "\nend", "\t"]) for _ in range(30)] + [""]
    rows = [(i, "s", t, t.replace("e", "c"), t.replace("th", "h").replace("o", "0")[: rng.randrange(1, 2000)]) for i, t in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "doc_id long, source string, truth string, mat string, raw string")
    rate = lambda d, n: None if n == 0 else round(d / n, 9)
    got = {r.doc_id: (r.cer_mat, r.cer_raw) for r in quality.error_rates(pairs).collect()}
    assert got == {i: tuple(rate(matrix(t, x), len(t)) for x in (m, r)) for i, _, t, m, r in rows}
    tok = distance.tokens
    got = {r.doc_id: (r.wer_mat, r.wer_raw) for r in quality.word_error_rates(pairs).collect()}
    assert got == {i: tuple(rate(matrix(tok(t), tok(x)), len(tok(t))) for x in (m, r)) for i, _, t, m, r in rows}
    for r, (_, _, t, m, w) in zip(quality.operation_counts(pairs).orderBy("doc_id").collect(), rows, strict=True):
        assert r.mat_ins + r.mat_del + r.mat_sub == matrix(t, m) and r.mat_ins - r.mat_del == len(m) - len(t)
        assert r.raw_ins + r.raw_del + r.raw_sub == matrix(t, w) and r.raw_ins - r.raw_del == len(w) - len(t)


def test_pooled_rates_of_long_texts(spark):
    """500 texts of some 20,000 characters: linear work. By columns two distances took 0.28 s, so all 140 s."""
    rng = random.Random(14)
    words = ["the", "other", "one", "of", "book", "e", "house"]
    texts = [" ".join(rng.choice(words) for _ in range(5000)) for _ in range(500)]
    rows = [("s", t, t.replace("e", "c"), t.replace("th", "h").replace("o", "0")) for t in texts]
    pairs = spark.createDataFrame(rows, "source string, truth string, mat string, raw string").coalesce(1)
    began = time.time()
    got = quality.pooled_error_rates(pairs).first()
    assert time.time() - began < 60
    n, e, o = sum(map(len, texts)), sum(t.count("e") for t in texts), sum(t.count("th") + t.count("o") for t in texts)
    assert (got.cer_mat, got.cer_raw, got.n) == (round(e / n, 9), round(o / n, 9), 500)


def test_agreement_of_strips(spark, monkeypatch):
    """Also how far two recognisers are apart is settled without columns; what they leave out or garble counts as a matrix has it."""
    texts, mat, raw, noise = garbled(random.Random(15), 80)
    apart = [matrix(a, b) for a, b in zip(mat, raw, strict=True)]
    got = quality.agreement(spark.createDataFrame(list(zip(["s"] * 80, texts, mat, noise)), "source string, truth string, mat string, raw string")).first()  # noqa: B905
    m, r, b = ([matrix(x, y) for x, y in zip(one, other, strict=True)] for one, other in ((texts, mat), (texts, noise), (mat, noise)))
    assert (got.mean_distance, got.mat_nearer, got.raw_nearer) == (round(sum(b) / 80, 9), sum(x < y for x, y in zip(m, r, strict=True)), sum(y < x for x, y in zip(m, r, strict=True)))
    monkeypatch.setattr(distance, "_columns", None)
    assert distance.edit_distances(mat, raw) == apart


def test_tokens_are_those_of_split(spark):
    for t in ("", " ", "a", " a  b\t\n", "a\x0bb c", "x \r\n y "):
        assert spark.createDataFrame([(t,)], "t string").select(quality.n_tokens(F.col("t"))).first()[0] == len(distance.tokens(t))


# -- splits without ranking


def ranked_split(samples, share=0.2):
    quota = training.validation_quotas(samples, share)
    place = F.row_number().over(Window.partitionBy("class_name").orderBy(F.md5(F.coalesce(F.col("sample_id").cast("string"), F.lit(""))), "sample_id"))
    return samples.withColumn("_n", place).join(quota, "class_name").withColumn("split", F.when(F.col("_n") <= F.col("n_val"), "val").otherwise("train")).drop("_n", "n_val")


def test_split_is_that_of_ranking(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 7}") for i in range(9000)] + [(9001, "one"), (None, "none"), (None, "hot")]
    s = spark.createDataFrame(rows, "sample_id long, class_name string")
    pick = lambda df: sorted(((r.class_name, r.sample_id or -1, r.split) for r in df.collect()))
    assert pick(training.stratified_split(s)) == pick(ranked_split(s))
    assert training.stratified_split(s.limit(0)).count() == 0
    twice = s.union(s)  # repeated ids: sizes hold
    assert training.stratified_split(twice).filter("split = 'val'").count() == ranked_split(twice).filter("split = 'val'").count()


@pytest.mark.parametrize("digits", [(5, 8), (1, 1), (1, 0)])
def test_kth_hash_by_counting(spark, digits):
    rng = random.Random(6)
    rows = [(k, f"{rng.randrange(16**6):06x}{0:026x}") for k in "abc" for _ in range(500)]
    ks = {"a": 1, "b": 250, "c": 500}
    got = training.kth_hashes(spark.createDataFrame(rows, "g string, _hash string"), spark.createDataFrame(list(ks.items()), "g string, k long"), "g", "k", *digits).collect()
    assert len(got) == 3
    for r in got:
        own = sorted(h for g, h in rows if g == r.g)
        lead = r._low + r._high
        assert own[ks[r.g] - 1].startswith(lead) and r._rest == ks[r.g] - sum(h[: len(lead)] < lead for h in own)


def test_no_class_is_ranked(spark, sf):
    plan = training.stratified_split(table(spark, sf, "samples"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("_own" in w for w in re.findall(r"row_number\(\) windowspecdefinition\((class_name[^)]*)", plan))


# -- nearest anchors

BOX = "img_id long, comp_id long, area long, lft long, tp long, wid long, hgt long"


def boxes(rng, n, side, img=1):
    return [(img, i, 100, rng.randrange(side), rng.randrange(side), rng.randrange(1, 30), rng.randrange(1, 30)) for i in range(n)]


def test_nearest_anchor_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    a = boxes(rng, 60, 2000) + boxes(rng, 1, 50, 2) + [(3, 0, 5, -500, -500, 4000, 3)] + boxes(rng, 5, 10, 5)
    c = boxes(rng, 300, 3000) + boxes(rng, 40, 90_000, 2) + boxes(rng, 40, 900, 3) + boxes(rng, 10, 50, 4)
    got = {(r.img_id, r.comp_id): r.distance for r in components.nearest_anchor(spark.createDataFrame(c, BOX), spark.createDataFrame(a, BOX)).collect()}
    want = {}
    for img, i, _, x, y, w, h in c:
        cx, cy = x + w // 2, y + h // 2
        near = [max(b[3] - cx, 0, cx - b[3] - b[5]) ** 2 + max(b[4] - cy, 0, cy - b[4] - b[6]) ** 2 for b in a if b[0] == img]
        if near:
            want[img, i] = min(near) ** 0.5
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert components.nearest_anchor(spark.createDataFrame(c, BOX), spark.createDataFrame(a, BOX).limit(0)).count() == 0


def classes_by_hand(rows, pixels):
    """Class of each component of one image, all pairs."""
    valid = sorted((r for r in rows if r[2] >= pixels * components.HARD_MIN), key=lambda r: (-r[2], -r[1]))
    middle = float(np.median([r[2] for r in valid[: components.TOP_N]])) if valid else None
    anchors = [r for r in valid if r[2] >= components.ANCHOR * middle]
    reach = components.NEAR_FACTOR * float(np.median([r[6] for r in anchors])) if anchors else -1
    out = {r[1]: "removed" for r in rows} | {r[1]: "anchor" for r in anchors}
    for _, i, area, x, y, w, h in valid:
        cx, cy = x + w // 2, y + h // 2
        if out[i] == "removed" and area >= components.NEAR_AREA * middle and any((max(b[3] - cx, 0, cx - b[3] - b[5]) ** 2 + max(b[4] - cy, 0, cy - b[4] - b[6]) ** 2) ** 0.5 <= reach for b in anchors):
            out[i] = "near"
    return out


def test_classes_with_and_without_grid(spark):
    """Images of few and of many anchors, coordinates below zero, one anchor far larger than the others, none at all."""
    rng = random.Random(16)
    some = lambda img, n, side, low=0: [(img, i, rng.choice([1000, 900, 100, 30, 2]), low + rng.randrange(side), low + rng.randrange(side), rng.randrange(1, 30), rng.randrange(1, 30)) for i in range(n)]
    images = [some(1, 30, 400), some(2, 600, 1500), some(3, 700, 2000, -1000), some(4, 300, 300) + [(4, 300, 10**6, -50, -50, 5000, 2)], [(5, 0, 2, 0, 0, 1, 1)], some(6, 2 * components.FEW, 900)]
    got = components.classify(spark.createDataFrame([r for rows in images for r in rows], BOX), 600_000)
    assert got.columns == ["img_id", "comp_id", "area", "lft", "tp", "wid", "hgt", "class"]
    assert {(r.img_id, r.comp_id): r["class"] for r in got.collect()} == {(rows[0][0], i): c for rows in images for i, c in classes_by_hand(rows, 600_000).items()}
    assert {"anchor", "near", "removed"} <= {r["class"] for r in got.filter("img_id = 2").collect()}


def test_components_are_dealt_out_once(spark):
    """Classes and their counts go by image: one shuffle of the components, where joins made eight more."""
    rows = spark.createDataFrame(boxes(random.Random(17), 50, 500), BOX)
    for df in (components.classify(rows, 10**6), components.class_counts(components.classify(rows, 10**6))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_queries_by_image_take_one_shuffle(spark, sf):
    """That of the derived table; its rows are then dealt out by image already."""
    for name in ("component_classes", "component_class_counts"):
        assert registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_crowded_image_is_not_paired(spark):
    """100,000 components: the grid's join makes a few rows for each, not one for each pair."""
    rng = random.Random(9)
    rows = spark.createDataFrame([(1, i, 1000 if i % 4 == 0 else 100, rng.randrange(20_000), rng.randrange(20_000), rng.randrange(5, 15), rng.randrange(5, 15)) for i in range(100_000)], BOX)
    began = time.time()
    counts = {r["class"]: r["count"] for r in components.classify(rows, 10**6).groupBy("class").count().collect()}
    assert sum(counts.values()) == 100_000 and counts["anchor"] == 25_000 and counts["near"] > 0
    assert time.time() - began < 60


# -- files


def test_quoted_csv_in_many_tasks(spark, tmp_path):
    rng = random.Random(10)
    rows = [(f"{rng.randrange(40)}.png ", rng.choice(["plain", "two\nlines", 'say "x", y', "", "\n\n", "a,b", "ක\nත"]) + str(i)) for i in range(300)]
    text = "file_name,text\n" + "".join(f'{n},"{t.replace(chr(34), chr(34) * 2)}"\n' for n, t in rows)
    (tmp_path / "gt.csv").write_text(text, encoding="utf-8")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "gt.csv")).rdd.getNumPartitions() > 10
        got = files.read_quoted_csv(spark, str(tmp_path / "gt.csv"), "file_name string, text string").orderBy("_record").collect()
        last = {r.file_name: r.text for r in files.read_ground_truth(spark, str(tmp_path / "gt.csv")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [(r.file_name, r.text) for r in got] == rows
    assert last == {n.strip(): t for n, t in rows}
    one = spark.read.csv(str(tmp_path / "gt.csv"), header=True, multiLine=True, escape='"').collect()
    assert [(r.file_name, r.text) for r in one] == rows


def test_changed_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: sorted((r.name, r.status) for r in files.changed_images(spark, str(tmp_path / "in"), str(tmp_path / "state")).collect())
    for name in ("a.png", "b.png"):
        png(tmp_path / "in" / name, 2, 2, 9)
    (tmp_path / "in" / "n.txt").write_text("no")
    assert run() == [("a.png", "added"), ("b.png", "added")]
    assert run() == []
    png(tmp_path / "in" / "b.png", 3, 3, 9)
    os.utime(tmp_path / "in" / "b.png", (2e9, 2e9))
    (tmp_path / "in" / "a.png").unlink()
    png(tmp_path / "in" / "c.png", 2, 2, 9)
    assert run() == [("a.png", "removed"), ("b.png", "changed"), ("c.png", "added")]
    os.remove(next((tmp_path / "state").glob("run=2/_SUCCESS")))  # a run that did not end: its changes come again
    assert run() == [("a.png", "removed"), ("b.png", "changed"), ("c.png", "added")]


SUMMARY_ROW = "stem string, fname string, predicted_text string, texts array<string>, crop_images array<string>, error string"


def test_summaries_stay_once(spark, tmp_path):
    path = str(tmp_path / "sum")
    rows = spark.createDataFrame([(f"p{i}", f"p{i}.png", "ක", ["ක"], [], "boom" if i % 5 == 0 else None) for i in range(40)], SUMMARY_ROW)
    for _ in range(2):  # the batch is repeated
        summary_sink.write_summaries_once(rows.repartition(4), path, "day1")
    summary_sink.write_summaries_once(rows.limit(0), path, "day2")
    lost = summary_sink.BatchWriter(path, "day3")
    summary_sink.BatchWriter(path, "day3").files.write(iter(rows.take(3)))  # a task that wrote and died: in no manifest
    gone = lost.write(iter(rows.take(2)))
    lost.abort([gone, None])
    got = summary_sink.read_summaries_once(spark, path).collect()
    assert sorted(r.stem for r in got) == sorted(f"p{i}" for i in range(40)) and {r.predicted_text for r in got} == {"ක"}
    assert not (tmp_path / "sum" / "data" / gone.name).exists()
    record = json.loads(next(p for p in (tmp_path / "sum" / "data").iterdir() if p.suffix == ".json").read_text(encoding="utf-8").splitlines()[0])
    assert None not in record.values()


def test_failing_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "sum")
    summary_sink.write_summaries_once(spark.createDataFrame([("a", "a.png", "x", [], [], None)], SUMMARY_ROW), path, "one")
    bad = spark.range(8).repartition(4).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("stem"), F.when(F.col("id") == 5, F.raise_error(F.lit("boom"))).otherwise("f").alias("fname"))
    with pytest.raises(Exception, match="boom"):
        summary_sink.write_summaries_once(bad, path, "two")
    assert [r.stem for r in summary_sink.read_summaries_once(spark, path).collect()] == ["a"]


def test_summary_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", f"p{i}.png", "t", [], [], None) for i in range(9)], SUMMARY_ROW)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    spark.dataSource.register(summary_sink.PageSummaries)
    for check in ("c1", "c1", "c2"):  # c2 starts over with the same batches
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.writeStream.format(summary_sink.FORMAT).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert sorted(r.stem for r in summary_sink.read_summaries_once(spark, str(tmp_path / "out")).collect()) == sorted(f"p{i}" for i in range(9))


# -- streams that go on


@pytest.fixture
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


DETECTION = "page_id long, det_idx long, label string, score double, x1 long, y1 long, x2 long, y2 long"


def test_titles_over_many_batches(spark, tmp_path, one_partition):
    """Each batch's state and listing are those of its own pages; a later detection of a number replaces the earlier one."""
    rng = random.Random(12)
    rows = [(b // 5, b % 5 if b != 9 else 0, rng.choice(["document_title", "text"]), 0.9, *(x := [rng.randrange(100), rng.randrange(100)]), x[0] + 50, x[1] + 40) for b in range(50)]
    (tmp_path / "in").mkdir()
    for b, row in enumerate(rows):
        spark.createDataFrame([row], DETECTION).coalesce(1).write.parquet(str(tmp_path / f"b{b}"))
        place = tmp_path / "in" / f"{b:02d}.parquet"
        place.write_bytes(next((tmp_path / f"b{b}").glob("part*")).read_bytes())
        os.utime(place, (1e9 + b, 1e9 + b))
    live = spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.run_titles(live, str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(400)
    ran = [p for p in q.recentProgress if p.numInputRows]
    assert len(ran) == 50
    took = [p.durationMs["triggerExecution"] for p in ran]
    assert sorted(took[40:])[5] < 2 * sorted(took[5:15])[5]
    folders = list((tmp_path / "out" / "titles").iterdir())
    assert all(len(list(f.glob("part*"))) <= 2 for f in folders)
    known = {(r[0], r[1]): r for r in rows}
    expected = sorted((r.page_id, r.position, r.box_id) for r in regions.title_regions(spark.createDataFrame(list(known.values()), DETECTION)).collect())
    read = lambda: sorted((r.page_id, r.position, r.box_id) for r in jobs.read_titles(spark, str(tmp_path / "out")).collect())
    assert read() == expected
    jobs.compact_titles(spark, str(tmp_path / "out"))
    assert read() == expected and len(list((tmp_path / "out" / "titles").iterdir())) == 1


def test_clock_needs_a_query_that_goes_on(spark, tmp_path):
    live = spark.readStream.schema(DETECTION).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="every"):
        jobs.run_titles(live, str(tmp_path / "o"), str(tmp_path / "c"), keep_ms=1000)


def test_state_of_ended_jobs_is_freed(spark, tmp_path, one_partition):
    event = "job_id long, seq_id long, ts timestamp_ntz, status string, msg string"
    batches = [
        [(1, 1, "2024-01-01 00:00:00", "queued"), (1, 2, "2024-01-01 00:01:00", "done"), (1, 3, "2024-01-01 00:02:00", "queued"), (2, 1, "2024-01-01 00:00:00", "queued"), (3, 1, "2024-01-01 00:00:00", "done"), (4, 1, "2024-01-01 00:00:00", "failed")],
        [(1, 4, "2024-01-01 00:30:00", "queued"), (2, 2, "2024-01-01 01:00:00", "queued")],  # over: stays out
        [(2, 3, "2024-01-03 00:00:00", "queued")],  # moves the watermark past job 1's end
        [(2, 4, "2024-01-03 00:01:00", "failed"), (1, 5, "2024-01-01 00:40:00", "queued")],  # late: dropped
        [(1, 6, "2024-01-03 00:05:00", "queued")],  # a new run of job 1
    ]
    (tmp_path / "in").mkdir()
    for b, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, "") for r in rows], "job_id long, seq_id long, ts string, status string, msg string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(str(tmp_path / f"b{b}"))
        place = tmp_path / "in" / f"{b}.parquet"
        place.write_bytes(next((tmp_path / f"b{b}").glob("part*")).read_bytes())
        os.utime(place, (1e9 + b, 1e9 + b))
    live = spark.readStream.schema(event).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with jobs.keyed_state(spark):
        q = jobs.until_terminal_stream(live, "1 hour", keep_ms=3_600_000).writeStream.outputMode("append").format("memory").queryName("ended").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert sorted((r.job_id, r.seq_id) for r in spark.table("ended").collect()) == [(1, 1), (1, 2), (1, 6), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (4, 1)]
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) > min(held[held.index(max(held)) :])


# -- images to thresholds


def test_thresholds_from_files(spark, tmp_path):
    for i, grey in enumerate((0, 128, 255)):
        png(tmp_path / f"{i}.png", 5, 4, grey)
    (tmp_path / "bad.png").write_bytes(b"broken")
    images = files.read_images(spark, str(tmp_path)).select(F.element_at(F.split("origin", "/"), -1).alias("img_id"), "data", "nChannels")
    got = {r.img_id: (r.threshold, r.ink, r.paper, r.inverted) for r in raster.image_thresholds(images).collect()}
    assert got == {f"{i}.png": (grey, 20, 0, False) for i, grey in enumerate((0, 128, 255))}


def test_thresholds_equal_those_of_pixel_rows(spark, sf):
    by_pixel = {r.img_id: r.t for r in raster.otsu(table(spark, sf, "px")).collect()}
    assert {r.img_id: r.threshold for r in raster.image_thresholds(table(spark, sf, "rasters")).collect()} == by_pixel
    rng = np.random.default_rng(5)
    colour = rng.integers(0, 256, (30, 3), dtype=np.uint8)
    grey = models.grey_levels(colour.tobytes(), 3)
    assert np.abs(grey - colour @ np.array([0.114, 0.587, 0.299])).max() <= 0.5
    assert np.array_equal(models.grey_levels(np.c_[colour, colour[:, 0]].tobytes(), 4), grey)
    none = spark.createDataFrame([(1, None, 1), (2, b"", 1)], "img_id long, data binary, nChannels int")
    assert raster.image_thresholds(none).count() == 0


# -- models


def softmax_fit(x, y, classes):
    """An independent fit: Newton's steps on the cross-entropy with the least of a penalty."""
    n, d = x.shape
    x = np.c_[x, np.ones(n)]
    w, target = np.zeros((d + 1, classes)), np.eye(classes)[y]
    for _ in range(30):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = (x.T @ (p - target) / n + 1e-4 * w).T.ravel()
        hess = np.block([[x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]) / n + 1e-4 * (a == b) * np.eye(d + 1) for b in range(classes)] for a in range(classes)])
        w -= np.linalg.solve(hess, grad).reshape(classes, d + 1).T
    return w


def test_logistic_regression_agrees_with_an_independent_fit(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    x = rng.normal(0, 1.0, (600, 5)) + 1.2 * np.eye(5)[y]
    rows = [(i, int(y[i]), [float(v) for v in x[i]], "val" if i % 4 == 0 else "train") for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, split string")
    got = {r.vec_id: r.pred for r in training.logistic_regression(v).collect()}
    train = np.arange(600) % 4 > 0
    w = softmax_fit(x[train], y[train], 3)
    want = (np.c_[x, np.ones(600)] @ w).argmax(1)
    val = np.flatnonzero(~train)
    agree = np.mean([got[i] == want[i] for i in val])
    ours, theirs = (np.mean([p[i] == y[i] for i in val]) for p in (got, want))
    assert agree >= 0.97 and abs(ours - theirs) <= 0.02
    curve = training.validation_curve(v, (1, 20)).orderBy("epoch").collect()
    assert curve[1].val_loss < curve[0].val_loss and abs(curve[1].val_acc - ours) < 1e-9
    z = np.c_[x, np.ones(600)][val] @ w
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    smooth = -(0.92 * log_p[np.arange(len(val)), y[val]] + 0.08 * log_p.mean(1)).mean()
    assert abs(curve[1].val_loss - smooth) < 0.02
    assert training.replay_early_stop(training.validation_curve(v, (1, 20))).count() == 2


def test_model_columns_pass_whatever_their_names(spark):
    df = spark.createDataFrame([(1, (2, "a"), [1])], "v long, `odd ``name` struct<`content type`:long,`x y`:string>, `a.b` array<int>")
    got = models.score_partitions(df, lambda: 3, lambda m, b: b["v"] * m, "w long", "triple").first()
    assert got["w"] == 3 and got["odd `name"]["content type"] == 2 and got["error"] is None


def test_scored_partitions_in_blocks(spark, sf):
    e = table(spark, sf, "embeddings")
    pick = lambda df: sorted((r.vec_id, r.pred) for r in df.collect())
    assert pick(registry.scored_partitions(e, most_cells=150)) == pick(registry.scored_partitions(e))
