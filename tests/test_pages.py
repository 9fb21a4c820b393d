"""Traps of the page operators on hand-made rows, files and streams."""

import json
import os
import random
import struct
import zlib

from pyspark.sql import functions as F

from foliospark.functions import models
from foliospark.functions import texts as x
from foliospark.operators import components, lines, quality, raster, regions, report, training
from foliospark.plans import registry
from foliospark.plans.fixtures import table
from foliospark.sources import files
from foliospark.streaming import jobs

DET = "page_id long, det_idx long, label string, score double, x1 long, y1 long, x2 long, y2 long"


def png(path, w, h, grey):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes([grey]) * w for _ in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_region_traps(spark):
    rows = [
        (1, 0, "document_title", 0.20, 0, 0, 100, 100), (1, 1, "document_title", 0.19, 0, 0, 10, 10), (1, 2, "text", 0.9, 0, 0, 900, 900), (1, 3, "paragraph_title", 0.5, 10, 10, 60, 60),
        (1, 4, "paragraph_title", 0.5, 100, 0, 200, 100), (1, 5, "paragraph_title", 0.5, 5, 5, 5, 50), (2, 0, "header", 0.9, 0, 0, 9, 9), (2, 1, "text", 0.9, 0, 0, 10, 10), (2, 2, "text", 0.9, 50, 0, 60, 10), (2, 3, "text", 0.9, 0, 50, 20, 60), (2, 4, "text", 0.9, 90, 50, 92, 52), (3, 0, "header", 0.9, 0, 0, 9, 9),
    ]
    got = [(r.page_id, r.box_id) for r in regions.title_regions(spark.createDataFrame(rows, DET)).orderBy("page_id", "position").collect()]
    # touching boxes and boxes without area don't suppress; equal places go by area; a page without text has none; numbers keep their gaps
    assert got == [(1, "title_000"), (1, "title_005"), (1, "title_004"), (2, "body_003"), (2, "body_001"), (2, "body_002")]


def test_suppression_properties(spark):
    random.seed(1)
    rows = [(p, i, "document_title", 0.9, a, b, a + random.randint(1, 60), b + random.randint(1, 60)) for p in range(20) for i in range(15) for a, b in [(random.randint(0, 80), random.randint(0, 80))]]
    df = spark.createDataFrame(rows, DET)
    kept = {(r.page_id, r.det_idx) for r in regions.title_regions(df).collect()}

    def over(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        return w > 0 and h > 0 and w * h / min((a[6] - a[4]) * (a[7] - a[5]), (b[6] - b[4]) * (b[7] - b[5])) > 0.6

    for p in range(20):
        page = [r for r in rows if r[0] == p]
        inside = [r for r in page if (p, r[1]) in kept]
        assert not any(over(a, b) for a in inside for b in inside if a is not b)
        assert all(any(over(r, k) for k in inside) for r in page if r not in inside)


def test_one_shuffle_of_pages(spark, sf):
    plan = regions.title_or_fallback(regions.text_detections(table(spark, sf, "detections")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page_id") == 1


def test_word_traps(spark):
    assert [tuple(r) for r in spark.createDataFrame([(10, 8), (5, 384), (3, 1000)], "w long, h long").select(lines.g.scaled_width(F.col("w"), F.col("h")), lines.g.resample_choice(F.col("h"))).collect()] == [(480, "cubic"), (5, "cubic"), (1, "area")]
    quad = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 0, 10, 10, 0, 10), (1, 0, 1, 0, 40, 30, 40, 30, 49, 0, 49)], "page_id long, block_no long, poly_idx long, x0 long, y0 long, x1 long, y1 long, x2 long, y2 long, x3 long, y3 long")
    assert [r.poly_idx for r in lines.keep_words(lines.group_lines(quad)).collect()] == [1]  # equal sides stay, but 10 is too narrow
    blocks = spark.createDataFrame([(1, 0, 0, 0), (1, 9, 0, 0)], "page_id long, block_no long, bx long, by long")
    one = quad.filter("poly_idx = 0")
    assert [(r.block_no, r.words) for r in lines.block_metadata(lines.block_words(blocks, one)).collect()] == [(0, [])]


def test_eta_and_names(spark):
    got = spark.createDataFrame([(-1.0,), (float("nan"),), (5.9,), (65.0,), (3661.0,)], "s double").select(x.format_eta(F.col("s")).alias("e")).collect()
    assert [r.e for r in got] == ["calculating...", "calculating...", "5s", "1m 05s", "1h 01m 01s"]
    r = spark.createDataFrame([("combo_ක_0002",)], "n string").select(*x.class_parts(F.col("n"))).first()
    assert tuple(r) == ("combo", "ක", "0002")
    r = spark.createDataFrame([("C:\\out\\a\\b.PNG",)], "n string").select(x.relative(F.col("n"), "C:/out"), x.ext(F.col("n"))).first()
    assert tuple(r) == ("a/b.PNG", ".png")


def test_class_map_labels_parse(spark):
    m = spark.createDataFrame([("punct_exclaim_0305",), ("other",)], "n string").select(x.remap_folder(F.col("n")).alias("f")).collect()
    assert [r.f for r in m] == ["punct_!_0305", "other"]


def test_wer(spark):
    rows = [("a b c", "a x c"), ("a b", "a b"), ("a", ""), (" ".join(map(str, range(200))), " ".join(map(str, range(1, 200))))]
    got = [round(r.w, 6) for r in spark.createDataFrame(rows, "t string, s string").select(quality.wer(F.col("t"), F.col("s")).alias("w")).collect()]
    assert got == [round(1 / 3, 6), 0.0, 1.0, 0.005]


def test_files(spark, tmp_path):
    for cls in ("b_cls", "a_cls"):
        (tmp_path / "img" / cls).mkdir(parents=True)
        png(tmp_path / "img" / cls / "One.PNG", 4, 3, 200)
    (tmp_path / "img" / "a_cls" / "note.txt").write_text("no")
    (tmp_path / "img" / "a_cls" / "bad.png").write_bytes(b"broken")
    root = str(tmp_path / "img")
    assert [(r.name, r.ext) for r in files.image_manifest(spark, root).collect()] == [("One.PNG", ".png"), ("bad.png", ".png"), ("One.PNG", ".png")]
    assert {(r.class_name, r.class_idx) for r in files.read_class_folders(spark, root).collect()} == {("a_cls", 0), ("b_cls", 1)}
    images = spark.read.format("image").load(root + "/b_cls")
    assert images.select(models.raster_histogram("image.data").alias("h")).first().h[200] == 12
    assert files.read_images(spark, root).filter("height = 3 and width = 4").count() == 2
    white = files.read_images(spark, root, on_error="white").filter("height = 384").first()
    assert (white.width, white.nChannels, set(white.data)) == (384, 3, {255})
    manifest = files.image_manifest(spark, root)
    asked = spark.createDataFrame([(0, "bad.png"), (1, "gone.png"), (2, "bad.png")], "ord int, name string")
    assert [r.ord for r in report.requested_images(manifest, asked).collect()] == [0, 2]
    assert report.requested_images(manifest).count() == 3


def test_csv_and_json_records(spark, tmp_path):
    (tmp_path / "gt.csv").write_text('file_name,text\na.png ,first\nb.png,"two\nlines"\na.png,last\n')
    assert {(r.file_name, r.text) for r in files.read_ground_truth(spark, str(tmp_path / "gt.csv")).collect()} == {("a.png", "last"), ("b.png", "two\nlines")}
    (tmp_path / "map.json").write_text(json.dumps({"0": "combo_ක_0002", "10": "punct_x_0001"}))
    m = files.read_class_map(spark, str(tmp_path / "map.json"))
    assert json.loads(files.class_map_json(m).first().json) == {"0": "combo_ක_0002", "10": "punct_x_0001"}
    labels = spark.createDataFrame([("a.png", 'x "y", z')], "file_name string, text string")
    files.write_labels(labels, str(tmp_path / "raw"), str(tmp_path / "done"))
    assert files.read_ground_truth(spark, str(tmp_path / "done")).first().text == 'x "y", z'


def test_summary_round_trip(spark, tmp_path):
    strips = spark.createDataFrame([("p1", "b2", "ක ත", None), ("p1", "a1", "", None), ("p1", "c1", "lost", "boom"), ("p2", "a1", "x", None)], "stem string, block_id string, text string, error string")
    made = report.summaries(report.page_texts(strips)).withColumn("error", F.lit(None).cast("string"))
    files.write_summaries(made.coalesce(1), str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part*")).read_text(encoding="utf-8")
    assert "ක ත" in text and '"fname":"p1.png"' in text and '"error":null' not in text
    one = {r["stem"]: r for r in map(json.loads, text.splitlines())}
    assert one["p1"]["predicted_text"] == "ක ත" and one["p1"]["texts"] == ["", "ක ත"] and [s["cer"] for s in one["p1"]["splits"]] == [0, 0, 100]
    (tmp_path / "many" / "p1").mkdir(parents=True)
    (tmp_path / "many" / "p1" / "frontend_summary.json").write_text(json.dumps(one["p1"], ensure_ascii=False, indent=1))
    assert [r.stem for r in files.read_summaries(spark, str(tmp_path / "many")).collect()] == ["p1"]
    meta = regions.page_metadata(regions.title_regions(spark.createDataFrame([(1, 0, "document_title", 0.9, 0, 0, 10, 10)], DET)), 80, 90)
    files.write_page_meta(meta, str(tmp_path / "meta"))
    back = json.loads(next((tmp_path / "meta").glob("bucket=*/*.json")).read_text())
    assert back["page_id"] == 1 and back["image_size"] == {"width": 80, "height": 90} and back["boxes"][0]["polygon"] == [[0, 0], [10, 0], [10, 10], [0, 10]]
    again = spark.createDataFrame([(1, json.dumps([{"label": "text", "score": 0.5, "coordinate": [1.9, 2, 3, 4]}, {"label": "x", "coordinate": [0, 0, 1, 1]}]))], "page_id long, boxes string")
    assert [(r.det_idx, r.score, r.x1) for r in regions.explode_detections(again).collect()] == [(0, 0.5, 1), (1, 0.0, 0)]


def test_strip_source(spark):
    pages = spark.createDataFrame([("a",), ("b_c",), ("d",)], "stem string")
    own = spark.createDataFrame([("a", "a_1.png"), ("a", "a_1_binarized.png")], "stem string, name string")
    flat = spark.createDataFrame([("a_9.png",), ("b_c_1.png",), ("b_c_1_mat_debug.png",), ("d.png",)], "name string")
    assert {tuple(r) for r in report.strip_source(pages, own, flat).collect()} == {("a", "a_1.png"), ("b_c", "b_c_1.png")}


def test_split_properties(spark, sf):
    s = training.stratified_split(table(spark, sf, "samples")).toPandas()
    n = len(s)
    assert (s["split"] == "val").sum() == -(-n // 5) and s["sample_id"].is_unique
    share = s.groupby("class_name")["split"].agg(lambda v: abs((v == "val").sum() - 0.2 * len(v)))
    assert share.max() <= 1


def test_user_model_errors_become_rows(spark):
    def predict(model, batch):
        if (batch["v"] == 3).any():
            raise ValueError("three")
        return batch["v"] * model

    got = models.score_partitions(spark.createDataFrame([(i,) for i in range(5)], "v long"), lambda: 2, predict, "w long", "double").toPandas().sort_values("v")
    assert got["error"].tolist() == [None, None, None, "three", None] and got["w"].dropna().tolist() == [0, 2, 4, 8]


def test_streams_equal_batch(spark, sf, tmp_path):
    events = table(spark, sf, "job_events")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = report.job_status(live).writeStream.outputMode("complete").format("memory").queryName("status").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("status").collect())) == sorted(map(tuple, report.job_status(events).collect()))
    # in order of time, a file a batch, the stream stops each job where the batch does
    ordered = events.orderBy("ts", "seq_id").toPandas()
    for i, part in enumerate((ordered.iloc[:400], ordered.iloc[400:])):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / f"o{i}"))
    (tmp_path / "ord").mkdir()
    for i in range(2):
        (tmp_path / "ord" / f"{i}.parquet").write_bytes(next((tmp_path / f"o{i}").glob("part*")).read_bytes())
        os.utime(tmp_path / "ord" / f"{i}.parquet", (1e9 + i, 1e9 + i))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ord"))
    with jobs.keyed_state(spark):
        q = jobs.until_terminal_stream(live, keep_ms=10 * 365 * 86_400_000).writeStream.outputMode("append").format("memory").queryName("stopped").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq_id for r in spark.table("stopped").collect()) == sorted(r.seq_id for r in report.until_terminal(events).collect())


def test_title_stream_and_uploads(spark, sf, tmp_path):
    det = table(spark, sf, "detections")
    det.repartition(3, "page_id", "det_idx").write.parquet(str(tmp_path / "det"))  # a page's detections lie in several files
    assert spark.read.parquet(str(tmp_path / "det")).withColumn("f", F.input_file_name()).groupBy("page_id").agg(F.countDistinct("f").alias("n")).filter("n > 1").count() > 10
    expected = sorted((r.page_id, r.position, r.box_id) for r in regions.title_regions(det).collect())
    for run in range(2):  # a rerun from the start replaces pages
        live = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "det"))
        jobs.run_titles(live, str(tmp_path / "titles"), str(tmp_path / f"check{run}")).awaitTermination(200)
        assert sorted((r.page_id, r.position, r.box_id) for r in jobs.read_titles(spark, str(tmp_path / "titles")).collect()) == expected
    (tmp_path / "up").mkdir()
    png(tmp_path / "up" / "a.PNG", 2, 2, 0)
    (tmp_path / "up" / "b.txt").write_text("x")
    q = jobs.new_uploads(spark, str(tmp_path / "up")).select("name", "ext").writeStream.format("memory").queryName("ups").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("ups").collect()] == [("a.PNG", ".png")]


def test_component_classes_by_hand(spark):
    rows = [(1, 1, 1000, 0, 0, 20, 20), (1, 2, 150, 30, 5, 4, 4), (1, 3, 150, 200, 5, 4, 4), (1, 4, 5, 1, 1, 1, 1), (2, 1, 1, 0, 0, 1, 1)]
    c = components.classify(spark.createDataFrame(rows, "img_id long, comp_id long, area long, lft long, tp long, wid long, hgt long"), 600_000)
    assert {(r.img_id, r.comp_id): r["class"] for r in c.collect()} == {(1, 1): "anchor", (1, 2): "anchor", (1, 3): "anchor", (1, 4): "removed", (2, 1): "removed"}


def test_constant_image_has_a_threshold(spark):
    px = spark.createDataFrame([(1, r, c, 7) for r in range(3) for c in range(3)], "img_id long, r long, c long, v int")
    assert raster.otsu(px).first().t == 7


def test_every_query_has_a_schema(spark, sf):
    for name, f in registry.QUERIES.items():
        if name not in ("logistic_regression", "scored_partitions"):
            assert f(spark, sf).columns, name
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_block_records_lie_in_few_folders(spark, sf, tmp_path):
    made = lines.block_metadata(lines.block_words(registry._blocks(table(spark, sf, "polygons")), table(spark, sf, "polygons")))
    files.write_block_meta(made, str(tmp_path / "blocks"), buckets=4)
    assert len(list((tmp_path / "blocks").glob("bucket=*"))) == 4
    back = spark.read.schema("page_id long, block_no long, words array<struct<word_no:long,word_id:string,bbox_in_full_image:array<double>>>").json(str(tmp_path / "blocks"))
    count = lambda df: sorted((r.page_id, r.block_no, len(r.words)) for r in df.collect())
    assert count(back) == count(made)


def test_null_scores_and_labels_are_warned_about(spark):
    rows = spark.createDataFrame([(1, 0, "text", None, 0, 0, 9, 9), (1, 1, None, 0.9, 0, 0, 9, 9), (1, 2, "image", 0.9, 0, 0, 9, 9), (1, 3, "text", 0.9, 0, 0, 9, 9)], DET)
    r = regions.rejected_warnings(rows).first()
    assert (r.warnings, r.n_rejected) == ("000 text: low score; 001 no label: not text; 002 image: not text", 3)
    assert regions.region_counts(rows).first().n_text == 1


def test_centroids_in_blocks_give_the_same(spark, sf):
    v = registry._split_vectors(table(spark, sf, "embeddings"))
    model = training.centroids(v.filter("split = 'train'"))
    pred = lambda **k: sorted((r.vec_id, r.pred) for r in training.nearest_centroid(v.filter("split = 'val'"), model, **k).collect())
    assert pred() == pred(most_bytes=2000)


def test_logistic_regression_learns(spark):
    random.seed(3)
    rows = [(i, i % 3, [random.gauss(2.0 * (i % 3 == d), 0.3) for d in range(4)], "val" if i % 5 == 0 else "train") for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, split string")
    got = training.logistic_regression(v).collect()
    assert len(got) == 60 and sum(r.pred == r.label for r in got) >= 58


def test_fix_pad_and_half_even(spark):
    b = spark.createDataFrame([(100, 50, 1, 2, 3, 4, 15, 768)], "bx long, by long, a long, b long, c long, d long, w long, h long")
    box = lines.g.absolute_bbox(F.col("bx"), F.col("by"), [F.col(c) for c in "abcd"], fix_pad=True)
    assert tuple(b.select(*box).first()) == (91, 42, 93, 44)
    assert b.select(lines.g.scaled_width(F.col("w"), F.col("h"), half_even=True).alias("w"), lines.g.scaled_width(F.col("w"), F.col("h")).alias("v")).first().asDict() == {"w": 8, "v": 7}
