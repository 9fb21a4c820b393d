"""Data work around glyph classifiers: splits, class maps, metrics, early stopping, simple models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import texts as x

LR, LR_MIN, EPOCHS, SMOOTHING, PATIENCE = 1e-4, 1e-6, 20, 0.08, 5


def class_indices(samples: DataFrame) -> DataFrame:
    """Adds class_idx, the rank of the class among sorted distinct ones from 0. The list of classes is ranked, not the samples."""
    classes = samples.select("class_name").distinct().withColumn("class_idx", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("bigint"))
    return samples.join(classes, "class_name")


def validation_quotas(samples: DataFrame, test_share: float = 0.2) -> DataFrame:
    """class_name, n_val: ceil(share * N) validation rows, in proportion by class, what is left over by largest fraction."""
    counts = samples.groupBy("class_name").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.crossJoin(total).withColumn("exact", F.col("n") * F.ceil(F.col("total") * test_share) / F.col("total"))
    share = share.withColumn("base", F.floor("exact")).withColumn("left", F.ceil(F.col("total") * test_share) - F.sum("base").over(Window.partitionBy("total")))
    rest = F.row_number().over(Window.partitionBy("total").orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), "class_name"))
    return share.select("class_name", (F.col("base") + (rest <= F.col("left")).cast("int")).alias("n_val"))


def kth_hashes(hashed: DataFrame, quotas: DataFrame, by: str, k: str, prefix: int = 5, more: int = 8) -> DataFrame:
    """hashed: the columns by and _hash (hex); quotas: by and k. The leading digits of each group's k-th smallest hash: by, _low (the first ``prefix``), _high (the next ``more``), and _rest, which of the rows under those digits is the k-th.

    Two counting passes: a histogram of the first digits tells in which bin the k-th lies, and a histogram of that bin's
    next digits where in it. Counts are summed before the shuffle, so a group has 16 ** prefix rows there at most, however many rows it has.
    """
    order = lambda c: Window.partitionBy(by).orderBy(c)

    def bin_of(counts: DataFrame, place: str, left: str) -> DataFrame:
        upto = counts.withColumn("_upto", F.sum("_n").over(order(place)))
        return upto.filter((F.col("_upto") >= F.col(left)) & (F.col("_upto") - F.col("_n") < F.col(left))).withColumn("_rest", F.col(left) - F.col("_upto") + F.col("_n"))

    digits = hashed.select(by, F.substring("_hash", 1, prefix).alias("_low"), F.substring("_hash", prefix + 1, more).alias("_high"))
    first = digits.groupBy(by, "_low").agg(F.count("*").alias("_n")).join(quotas.filter(F.col(k) > 0), by)
    low = bin_of(first, "_low", k).select(by, "_low", F.col("_rest").alias("_within"))
    second = digits.join(low, [by, "_low"]).groupBy(by, "_low", "_high").agg(F.count("*").alias("_n"), F.first("_within").alias("_within"))
    return bin_of(second, "_high", "_within").select(by, "_low", "_high", "_rest")


def stratified_split(samples: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Adds split. A class's first rows by md5 of sample_id are validation, as many as its quota. No class is ranked: only rows under all the digits of its bound are, which are the bound's own but for hashes alike in 52 bits."""
    quotas = validation_quotas(samples, test_share)
    hashed = samples.withColumn("_hash", F.md5(F.coalesce(F.col("sample_id").cast("string"), F.lit(""))))
    bounds = kth_hashes(hashed, quotas, "class_name", "n_val").withColumn("_bound", F.concat("_low", "_high")).select("class_name", "_bound", "_rest")
    placed = hashed.join(bounds, "class_name", "left").withColumn("_own", F.substring("_hash", 1, 13))
    tied = Window.partitionBy("class_name", "_own").orderBy("_hash", "sample_id")
    at_bound = placed.filter("_own = _bound").withColumn("split", F.when(F.row_number().over(tied) <= F.col("_rest"), "val").otherwise("train"))
    clear = placed.filter("_bound is null or _own <> _bound").withColumn("split", F.when(F.col("_own") < F.col("_bound"), "val").otherwise("train"))
    return clear.unionByName(at_bound).drop("_hash", "_own", "_bound", "_rest")


def sample_images(samples: DataFrame, n: int = 9, seed: str = "42") -> DataFrame:
    return samples.orderBy(F.md5(F.concat("file_name", F.lit(seed))), "file_name").limit(n).orderBy("file_name")


def first_per_source(samples: DataFrame, limits: dict[str, int], source: Column) -> DataFrame:
    """The first n rows by file name of each source named in limits."""
    parts = [samples.filter(source == k).orderBy("file_name").limit(n).withColumn("source", F.lit(k)).withColumn("source_order", F.lit(i)) for i, (k, n) in enumerate(limits.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_labels(images: DataFrame, truth: DataFrame) -> DataFrame:
    """images: name; truth: file_name, text. Joined on the stem."""
    return images.withColumn("_k", x.stem(F.col("name"))).join(truth.withColumn("_k", x.stem(F.trim("file_name"))), "_k").drop("_k")


def remapped_classes(samples: DataFrame, class_map: DataFrame) -> DataFrame:
    """class_map: class_idx, folder. Adds class_idx by the remapped folder name."""
    return samples.withColumn("folder", x.remap_folder(F.col("class_name"))).join(class_map, "folder")


def class_audit(classes: DataFrame) -> DataFrame:
    """classes: category, label, serial. Serials that several labels share, and labels with several serials."""
    one = classes.groupBy(F.lit("serial").alias("kind"), F.col("serial").alias("key")).agg(F.countDistinct("label").alias("n"))
    two = classes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("key")).agg(F.countDistinct("serial").alias("n"))
    return one.unionByName(two).filter("n > 1")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 9).alias("accuracy"))


def epoch_metrics(log: DataFrame) -> DataFrame:
    """log: epoch, phase, loss, n, correct -> a row an epoch."""
    part = lambda v, p: F.sum(F.when(F.col("phase") == p, v))
    loss = lambda p: F.round(part(F.col("loss") * F.col("n"), p) / part(F.col("n"), p), 6).alias(f"{p}_loss")
    acc = lambda p: F.round(part(F.col("correct"), p) / part(F.col("n"), p), 6).alias(f"{p}_acc")
    return log.groupBy("epoch").agg(loss("train"), loss("val"), acc("train"), acc("val"))


def replay_early_stop(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """history: epoch, val_loss. Adds is_best and waited; epochs after the stop go. One history is a few dozen rows."""
    run = Window.partitionBy(F.lit(1)).orderBy("epoch")
    best_before = F.min("val_loss").over(run.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("is_best", best_before.isNull() | (F.col("val_loss") < best_before))
    h = h.withColumn("best_epoch", F.last(F.when(F.col("is_best"), F.col("epoch")), ignorenulls=True).over(run)).withColumn("waited", F.col("epoch") - F.col("best_epoch"))
    stop = F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).over(Window.partitionBy(F.lit(1)))
    return h.withColumn("_stop", stop).filter("_stop is null or epoch <= _stop").drop("_stop")


def training_summary(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """history: epoch, val_loss, val_acc."""
    h = replay_early_stop(history, patience)
    best = F.max_by(F.struct("epoch", "val_loss", "val_acc"), F.struct((-F.col("val_loss")).alias("l"), (-F.col("epoch")).alias("e")))
    one = h.agg(best.alias("b"), F.count("*").alias("epochs_ran"), (F.max("waited") >= patience).alias("early_stopped"))
    return one.select(F.col("b.epoch").alias("best_epoch"), F.round("b.val_loss", 6).alias("best_val_loss"), F.round(F.col("b.val_acc") * 100, 2).alias("best_val_acc_pct"), "epochs_ran", "early_stopped")


def epoch_eta(times: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """times: epoch, seconds. Moving mean of the last five and the time that is left."""
    last = Window.partitionBy(F.lit(1)).orderBy("epoch").rowsBetween(-4, 0)
    t = times.withColumn("avg_s", F.avg("seconds").over(last))
    left = F.col("avg_s") * (epochs - F.col("epoch"))
    return t.select("epoch", F.round("avg_s", 6).alias("avg_s"), x.format_eta(F.round(left, 6)).alias("eta"))


def cosine_rate(epoch: Column, lr: float = LR, least: float = LR_MIN, epochs: int = EPOCHS) -> Column:
    return least + (lr - least) * (1 + F.cos(F.pi() * epoch / epochs)) / 2


def smoothed_loss(logits: Column, y: Column, eps: float = SMOOTHING) -> Column:
    """Label-smoothed cross-entropy; y counts from 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    doubles = F.transform(logits, lambda v: v.cast("double"))
    log_sum = F.log(total(F.transform(doubles, F.exp)))
    return (1 - eps) * (log_sum - F.element_at(doubles, y + 1)) + eps * (log_sum - total(doubles) / F.size(doubles))


def centroids(vectors: DataFrame) -> DataFrame:
    """vectors: label, embedding -> (label, dim, mean)."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(vectors: DataFrame, model: DataFrame, most_bytes: int = 16 * 2**20) -> DataFrame:
    """Adds pred, the label of the nearest centroid, the smallest on ties. model: label, dim, mean.

    Centroids are broadcast in blocks of labels of about ``most_bytes``; one block does for some thousand classes.
    """
    blocks = 1 + model.count() * 16 // most_bytes
    rows = model.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda d: d.mean).alias("mean"))
    square = lambda m: F.round(F.aggregate(F.zip_with("embedding", m, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v), 9)
    found = vectors
    for k in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.hash("label"), F.lit(blocks)) == k)
        packed = block.agg(F.collect_list(F.struct("label", "mean")).alias("_model"))
        best = F.array_min(F.transform("_model", lambda m: F.struct(square(m.mean).alias("d"), m.label.alias("label"))))
        found = found.crossJoin(F.broadcast(packed)).withColumn("_best", F.least("_best", best) if k else best).drop("_model")
    return found.withColumn("pred", F.col("_best.label")).drop("_best")


def validation_curve(vectors: DataFrame, steps: Sequence[int] = (1, 5, 20, 100)) -> DataFrame:
    """vectors as for logistic_regression. epoch (steps of the fit), val_loss, val_acc: the mean label-smoothed loss and the accuracy on val after so many steps, as early stopping reads them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.withColumn("features", array_to_vector("embedding"))
    train, val = data.filter("split = 'train'").persist(), data.filter("split = 'val'")
    rows = []
    for n in steps:  # a fit each, over all of train
        scored = LogisticRegression(maxIter=n, labelCol="label", featuresCol="features").fit(train).transform(val)
        loss = smoothed_loss(vector_to_array("rawPrediction"), F.col("label"))
        rows.append(scored.agg(F.lit(n).cast("long").alias("epoch"), F.avg(loss).alias("val_loss"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("val_acc")))
    return reduce(DataFrame.unionByName, rows)


def logistic_regression(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, label, embedding, split. Fits on train, returns vec_id, label, pred of val."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("features", array_to_vector("embedding"))
    model = LogisticRegression(maxIter=20, labelCol="label", featuresCol="features").fit(data.filter("split = 'train'"))
    return model.transform(data.filter("split = 'val'")).select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))
