"""Registered queries: one per operator, each over whole tables.

Every function takes a session and the folder of the tables and returns a DataFrame. Numbers are
rounded only in the last projection, so that they can be compared with the same query in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from vectorloom import functions as X
from vectorloom.operators import assembly, boxplot, classify, evaluate, folds, inference, newton, permutation, profile, tune
from vectorloom.operators.relu_perceptron import ReluPerceptronClassifier, ReluPerceptronModel
from vectorloom.session import scratch_path
from vectorloom.sources import (
    append_runs,
    list_files,
    npy_manifest,
    read_log,
    read_matrix,
    read_npy,
    shuffled,
    table,
    with_split,
    write_matrix,
    write_npy,
)

CLASSES = 10
MODES = {"click": "Cluster", "view": "CPU", "purchase": "GPU"}
SCAN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(column: str | Column, name: str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, digits) + F.lit(0.0)).alias(name)


def flat_text(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


# ---- inputs shared by several queries ------------------------------------------------------------


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return with_split(table(spark, folder, "embeddings"), "vec_id")


def binary_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label2", (F.col("label") < 7).cast("int"))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Rows laid out as features followed by a one-hot label."""
    one_hot = X.one_hot_index(F.col("label"), CLASSES)
    rows = embeddings(spark, folder)
    return rows.select("vec_id", "split", X.with_one_hot(F.col("embedding"), one_hot).alias("matrix"))


def train_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_profile(train_rows(spark, folder), "embedding")


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).where(F.col("split") == "train")


def vectors(rows: DataFrame, probabilities: bool = False) -> DataFrame:
    keep = ["vec_id", "split"]
    row = X.softmax(F.col("embedding")) if probabilities else F.col("embedding")
    shaped = rows.select(*keep, "label", row.alias("embedding"))
    return assembly.training_frame(shaped, "embedding", "label", keep)


def scan_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Four numeric order-line columns as features, the return flag as class."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        F.array(*SCAN_COLUMNS).alias("features"), F.col("l_returnflag").alias("class_name")
    )


def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding drawn as an 8 x 8 grey image, in the layout of Spark's image source."""
    level = lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("int")
    digits = F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0"))
    image = F.struct(
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(digits, "")).alias("data"),
    )
    return table(spark, folder, "embeddings").select("vec_id", image.alias("image"))


def linear_map(inputs: int, outputs: int) -> np.ndarray:
    """A fixed weight matrix that SQL can state as well."""
    j, o = np.meshgrid(np.arange(inputs), np.arange(outputs), indexing="ij")
    return ((7 * j + 3 * o) % 5 - 2) / 4.0


def linear_model(inputs: int, outputs: int) -> inference.Factory:
    def factory():
        weights = linear_map(inputs, outputs)
        return lambda batch: batch.reshape(len(batch), -1).astype(np.float64) @ weights

    return factory


def gaussian_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(embeddings(spark, folder))
    model = classify.gaussian_naive_bayes().fit(rows.where(F.col("split") == "train"))
    return with_int_prediction(model.transform(rows))


def with_int_prediction(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("label", F.col("label").cast("int")).withColumn(
        "prediction", F.col("prediction").cast("int")
    )


# ---- scans and shaping ---------------------------------------------------------------------------


@query
def matrix_scan_split(spark: SparkSession, folder: str) -> DataFrame:
    width = F.size("embedding")
    return (
        embeddings(spark, folder)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(width).alias("narrowest"),
            F.max(width).alias("widest"),
            F.sum("label").alias("label_sum"),
        )
    )


@query
def matrix_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    write_matrix(embeddings(spark, folder), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    rows = read_matrix(spark, path, "test")
    return rows.select("vec_id", "label", rounded(total, "total"))


@query
def matrix_round_trip_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every split written and read back."""
    path = scratch_path(spark, "matrix")
    write_matrix(embeddings(spark, folder), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    parts = [read_matrix(spark, path, split) for split in ("train", "validation", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("split", "vec_id", "label", F.size("embedding").alias("width"), rounded(total, "total"))


@query
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    files = list_files(spark, folder, "*.parquet")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), "length", "class_name")


def npy_shards(spark: SparkSession, folder: str) -> str:
    """The id, features and label of each embedding as `.npy` shards, half of the rows in single precision."""
    path = scratch_path(spark, "npy")
    rows = table(spark, folder, "embeddings")
    values = F.transform("embedding", lambda v: v.cast("double"))
    row = F.concat(F.array(F.col("vec_id").cast("double")), values, F.array(F.col("label").cast("double")))
    for kind, part in (("<f4", 0), ("<f8", 1)):
        half = rows.where(F.pmod("vec_id", F.lit(2)) == part).select(row.alias("row"))
        write_npy(half, "row", f"{path}/{kind[1:]}", kind).write.format("noop").mode("overwrite").save()
    return path


@query
def npy_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of two precisions written, planned by their headers and read back; every cell."""
    found = read_npy(spark, npy_shards(spark, folder))
    single = F.col("path").contains("/f4/")
    found = found.select(F.col("features")[0].cast("bigint").alias("vec_id"), single.alias("single"), F.posexplode("features").alias("pos", "value"))
    return found.where("pos > 0").select("vec_id", "single", "pos", rounded("value", "value"))


@query
def npy_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, width and element of the shards by precision."""
    found = npy_manifest(spark, npy_shards(spark, folder))
    return found.groupBy("kind", "item_bytes", "width").agg(F.sum("rows").alias("n_rows"))


@query
def shuffled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shuffled(table(spark, folder, "embeddings").select("vec_id", "label"), seed=4321)


@query
def shuffled_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that order the rows in three epochs, of the rows in the order of the last."""
    rows = shuffled(table(spark, folder, "embeddings").select("vec_id", "label"), seed=17, epoch=2)
    keys = [permutation.permuted(F.col("vec_id"), 17, epoch).alias(f"key_{epoch}") for epoch in range(3)]
    return rows.select("vec_id", "label", *keys)


@query
def feature_slice(spark: SparkSession, folder: str) -> DataFrame:
    features = X.feature_slice(F.col("matrix"), CLASSES)
    rows = matrix(spark, folder).select("vec_id", features.alias("features"))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "vec_id",
        F.size("features").alias("n_features"),
        F.element_at("features", 1).alias("first_value"),
        F.element_at("features", -1).alias("last_value"),
        rounded(total, "total"),
    )


@query
def label_slice_argmax(spark: SparkSession, folder: str) -> DataFrame:
    rows = assembly.split_label(matrix(spark, folder), "matrix", CLASSES, ["vec_id"])
    return rows.select("vec_id", F.col("label").alias("label_index"))


@query
def onehot_index(spark: SparkSession, folder: str) -> DataFrame:
    one_hot = X.one_hot_index(F.col("label"), CLASSES)
    return table(spark, folder, "embeddings").select("vec_id", flat_text(one_hot).alias("onehot"))


@query
def onehot_class_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    classes = assembly.class_names(rows, "l_returnflag")
    one_hot = X.one_hot_name(F.col("l_returnflag"), classes)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_returnflag", flat_text(one_hot).alias("onehot")
    )


@query
def path_parent_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", X.parent_dir(F.col("url")).alias("class_name")
    )


@query
def class_list(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.class_list(table(spark, folder, "lineitem"), "l_returnflag")


@query
def column_pick(spark: SparkSession, folder: str) -> DataFrame:
    picked = X.pick_columns(F.col("embedding"), [0, 7, 63])
    rows = table(spark, folder, "embeddings").select("vec_id", picked.alias("picked"))
    return rows.select(
        "vec_id", *[F.col("picked")[i].cast("double").alias(f"c{i}") for i in range(3)]
    )


@query
def features_onehot_concat(spark: SparkSession, folder: str) -> DataFrame:
    row = F.col("matrix")
    return matrix(spark, folder).select(
        "vec_id",
        F.size(row).alias("width"),
        F.element_at(row, 1).alias("first_value"),
        flat_text(X.label_slice(row, CLASSES).cast("array<bigint>")).alias("onehot"),
    )


@query
def feature_label_join(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return assembly.join_labels(features, table(spark, folder, "labels"), "doc_id")


@query
def feature_label_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return assembly.unmatched(features, table(spark, folder, "labels"), "doc_id")


@query
def class_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = binary_labels(table(spark, folder, "embeddings"))
    return assembly.class_mask(rows, 0, "label2").select("vec_id", "label", "label2")


@query
def elapsed_units(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        seconds.alias("seconds"),
        rounded(X.minutes(seconds), "minutes", 9),
        rounded(X.hours(seconds), "hours", 9),
    )


@query
def shifted_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", X.iso_shifted(F.col("ts"), -5).alias("local_iso"))


@query
def run_mode_label(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        X.run_mode(kind, MODES, "Other").alias("mode"),
        X.run_slots(kind, "click", 2).alias("slots"),
    )


@query
def run_log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "runlog")
    seconds = F.col("value")
    runs = table(spark, folder, "events").select(
        X.run_mode(F.col("event_type"), MODES, "Other").alias("mode"),
        F.col("event_type").alias("method"),
        F.col("ts").alias("started_at"),
        seconds.alias("elapsed_seconds"),
        X.minutes(seconds).alias("elapsed_minutes"),
    )
    append_runs(runs, path)
    log = read_log(spark, path)
    return log.select("mode", "method", "elapsed_seconds", rounded("elapsed_minutes", "elapsed_minutes", 9))


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a record of the log, with all its columns."""
    seconds, kind = F.col("value"), F.col("event_type")
    numbers = F.when(F.col("event_id") % 3 > 0, F.array(seconds / 1000.0, seconds / 2000.0))
    return table(spark, folder, "events").select(
        X.run_mode(kind, MODES, "Other").alias("mode"),
        kind.alias("method"),
        F.col("ts").alias("started_at"),
        F.length(kind).alias("epochs"),
        (F.col("event_id") % 7).cast("int").alias("steps_per_epoch"),
        seconds.alias("elapsed_seconds"),
        X.minutes(seconds).alias("elapsed_minutes"),
        X.hours(seconds).alias("elapsed_hours"),
        X.run_slots(kind, "click", 2).alias("slots"),
        (F.col("event_id") % 5).cast("int").alias("parallelism"),
        (seconds / 1000.0).alias("accuracy"),
        numbers.alias("accuracy_history"),
    )


def record_columns() -> list[str | Column]:
    history = F.col("accuracy_history")
    return [
        "mode",
        "method",
        F.unix_micros("started_at").alias("started_micros"),
        "epochs",
        "steps_per_epoch",
        "elapsed_seconds",
        rounded("elapsed_minutes", "elapsed_minutes", 9),
        rounded("elapsed_hours", "elapsed_hours", 9),
        "slots",
        "parallelism",
        rounded("accuracy", "accuracy", 9),
        rounded(history[0], "first_accuracy", 9),
        rounded(history[1], "second_accuracy", 9),
    ]


@query
def run_log_all_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the log written and read back."""
    path = scratch_path(spark, "runlog")
    append_runs(run_records(spark, folder), path)
    return read_log(spark, path).select(*record_columns())


# ---- profiling -----------------------------------------------------------------------------------


@query
def column_means(spark: SparkSession, folder: str) -> DataFrame:
    return train_profile(spark, folder).select("pos", rounded("mean", "mean", 8))


@query
def column_stddev_pop(spark: SparkSession, folder: str) -> DataFrame:
    return train_profile(spark, folder).select("pos", rounded("std", "std", 8))


@query
def rank_by_mean(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rank_columns(train_profile(spark, folder), "mean").select("pos", "rank")


@query
def rank_by_std(spark: SparkSession, folder: str) -> DataFrame:
    ranked = profile.rank_columns(train_profile(spark, folder), "std", descending=False)
    return ranked.select("pos", "rank")


@query
def topk_columns(spark: SparkSession, folder: str) -> DataFrame:
    top = profile.top_columns(train_profile(spark, folder), "mean", 10)
    return top.select("pos", rounded("mean", "mean", 8))


def _histogram(spark: SparkSession, folder: str, positions: Column, **options) -> DataFrame:
    rows = binary_labels(train_rows(spark, folder))
    found = profile.class_histogram(rows, "embedding", positions, "label2", **options)
    return found.select("pos", "label2", "bin", rounded("edge", "edge", 8), "n")


@query
def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _histogram(spark, folder, F.array(F.lit(0)))


@query
def class_histogram_common_range(spark: SparkSession, folder: str) -> DataFrame:
    return _histogram(spark, folder, F.array(F.lit(0), F.lit(5)), common_range=True)


@query
def top3_class_histograms(spark: SparkSession, folder: str) -> DataFrame:
    top = profile.top_columns(train_profile(spark, folder), "mean", 3)
    return _histogram(spark, folder, profile.as_positions(top))


def _box_plots(spark: SparkSession, folder: str, statistic: str) -> DataFrame:
    top = profile.top_columns(train_profile(spark, folder), statistic, 10)
    boxes = boxplot.boxplot_stats(train_rows(spark, folder), "embedding", profile.as_positions(top))
    numbers = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return boxes.select("pos", "total", *[rounded(n, n, 8) for n in numbers], "outliers")


@query
def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _box_plots(spark, folder, "mean")


@query
def boxplot_stats_by_std(spark: SparkSession, folder: str) -> DataFrame:
    return _box_plots(spark, folder, "std")


@query
def boxplot_outliers(spark: SparkSession, folder: str) -> DataFrame:
    top = profile.top_columns(train_profile(spark, folder), "mean", 10)
    found = boxplot.boxplot_outliers(train_rows(spark, folder), "embedding", profile.as_positions(top))
    return found.select("pos", rounded("value", "value", 8), "n")


@query
def lineitem_profile(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.column_profile(scan_rows(spark, folder), "features", ["class_name"])
    return found.select(
        "class_name", "pos", "n", rounded("mean", "mean", 5), rounded("std", "std", 5), "lo", "hi"
    )


@query
def lineitem_boxplots(spark: SparkSession, folder: str) -> DataFrame:
    positions = F.array(*[F.lit(i) for i in range(len(SCAN_COLUMNS))])
    boxes = boxplot.boxplot_stats(scan_rows(spark, folder), "features", positions)
    numbers = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return boxes.select("pos", "total", *[rounded(n, n, 5) for n in numbers], "outliers")


# ---- images and batch models ---------------------------------------------------------------------


@query
def image_resize(spark: SparkSession, folder: str) -> DataFrame:
    resized = image_rows(spark, folder).select(
        "vec_id", inference.resize_images("image", 4, 4).alias("pixels")
    )
    red = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("pixels", i * 3))
    return resized.select("vec_id", F.posexplode(red).alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query
def image_resize_colour(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding drawn as a 6 x 3 colour image, reduced 2:1 and 3:2 and enlarged; all channels."""
    drawn = F.struct(
        F.lit(6).alias("height"),
        F.lit(3).alias("width"),
        F.lit(3).alias("nChannels"),
        F.substring("image.data", 1, 54).alias("data"),
    )
    rows = image_rows(spark, folder).select("vec_id", drawn.alias("image"))
    sizes = [(3, 1), (4, 2), (12, 6)]
    resized = [inference.resize_images("image", h, w).alias(f"r{h}x{w}") for h, w in sizes]
    rows = rows.select("vec_id", *resized)
    each = F.array(*[F.struct(F.lit(f"{h}x{w}").alias("size"), F.col(f"r{h}x{w}").alias("pixels")) for h, w in sizes])
    rows = rows.select("vec_id", F.explode(each).alias("one"))
    rows = rows.select("vec_id", "one.size", F.posexplode("one.pixels").alias("pos", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query
def image_label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Resized pixels and one-hot label of every image, the class name standing for its folder."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    images = image_rows(spark, folder).join(labels, "vec_id")
    folders = F.concat(F.lit("images/class-"), F.col("label"), F.lit("/"), F.col("vec_id"), F.lit(".png"))
    named = images.withColumn("path", folders).withColumn("class_name", X.parent_dir(F.col("path")))
    classes = assembly.class_names(named, "class_name")
    rows = inference.image_label_rows(named, classes, 4, 4)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select("path", rounded(total, "total"), flat_text(F.col("label")).alias("onehot"))


@query
def image_featurise(spark: SparkSession, folder: str) -> DataFrame:
    found = inference.featurise_images(
        image_rows(spark, folder), linear_model(48, 2), 4, 4, keep=["vec_id"]
    )
    return found.select(
        "vec_id", *[F.col("features")[o].cast("double").alias(f"f{o}") for o in range(2)]
    )


@query
def linear_featurise(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = inference.featurise(
        rows, "embedding", linear_model(64, 4), [64], returns=ArrayType(DoubleType())
    )
    return found.select("vec_id", *[rounded(F.col("features")[o], f"f{o}") for o in range(4)])


# ---- classifiers ---------------------------------------------------------------------------------


@query
def mnb_parameters(spark: SparkSession, folder: str) -> DataFrame:
    model = classify.multinomial_naive_bayes().fit(vectors(train_rows(spark, folder), True))
    found = classify.naive_bayes_parameters(spark, model)
    return found.select("label", "pos", rounded("pi", "pi", 8), rounded("theta", "theta", 8))


@query
def mnb_predict(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(embeddings(spark, folder), True)
    model = classify.multinomial_naive_bayes().fit(rows.where(F.col("split") == "train"))
    return with_int_prediction(model.transform(rows)).select("vec_id", "label", "prediction")


@query
def gnb_parameters(spark: SparkSession, folder: str) -> DataFrame:
    model = classify.gaussian_naive_bayes().fit(vectors(train_rows(spark, folder)))
    found = classify.naive_bayes_parameters(spark, model)
    numbers = [rounded(name, name, 8) for name in ("pi", "theta", "sigma")]
    return found.select("label", "pos", *numbers)


@query
def gnb_predict(spark: SparkSession, folder: str) -> DataFrame:
    return gaussian_predictions(spark, folder).select("vec_id", "label", "prediction")


@query
def lineitem_gnb_confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan_rows(spark, folder)
    classes = assembly.class_names(rows, "class_name")
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_name")) - 1
    shaped = assembly.training_frame(rows, "features", index)
    model = classify.gaussian_naive_bayes().fit(shaped)
    return evaluate.confusion(with_int_prediction(model.transform(shaped)))


def _predictions(spark: SparkSession, folder: str, estimator) -> DataFrame:
    """Rows of every split, scored by a fit on the training split."""
    rows = vectors(embeddings(spark, folder))
    model = estimator.fit(rows.where(F.col("split") == "train"))
    scored = model.transform(rows)
    return with_int_prediction(scored).select("vec_id", "label", "prediction")


@query
def lr_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder, classify.logistic_regression())


@query
def lr_penalised_predict(spark: SparkSession, folder: str) -> DataFrame:
    n = train_rows(spark, folder).count()
    return _predictions(spark, folder, classify.penalised_logistic_regression(n))


@query
def lr_stationarity(spark: SparkSession, folder: str) -> DataFrame:
    """Slope of the penalised loss at the fit, per class and column: zero at the optimum."""
    rows = vectors(train_rows(spark, folder))
    estimator = classify.penalised_logistic_regression(rows.count(), tol=1e-10)
    model = estimator.fit(rows)
    weights = model.coefficientMatrix.toArray()
    at = np.hstack([weights, model.interceptVector.toArray()[:, None]])
    sums = newton.sums_at(newton.labelled(rows, "features", "label"), at, len(at), curved=False)
    slopes = sums[2:].reshape(at.shape)[:, :-1] + weights
    found = [(k, j, float(v)) for (k, j), v in np.ndenumerate(slopes)]
    return spark.createDataFrame(found, "class int, pos int, slope double").select("class", "pos", rounded("slope", "slope", 2))


@query
def mlpc_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder, classify.sigmoid_perceptron([64, 16, CLASSES], max_iter=20))


def _held_out(spark: SparkSession, folder: str) -> DataFrame:
    rows = embeddings(spark, folder).where(F.col("split") != "test")
    return rows.withColumn("held_out", F.col("split") == "validation")


def _relu_model(spark: SparkSession, folder: str) -> ReluPerceptronModel:
    estimator = ReluPerceptronClassifier(
        layers=[64, 32, 16, CLASSES],
        featuresCol="embedding",
        idCol="vec_id",
        maxIter=20,
        stepSize=0.01,
        validationIndicatorCol="held_out",
    )
    return estimator.fit(_held_out(spark, folder))


@query
def relu_mlp_predict(spark: SparkSession, folder: str) -> DataFrame:
    scored = _relu_model(spark, folder).transform(embeddings(spark, folder))
    return with_int_prediction(scored).select("vec_id", "label", "prediction")


@query
def relu_mlp_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction and its probability under given weights."""
    weights = [linear_map(64, 6).ravel(), np.zeros(6), linear_map(6, 5).ravel(), np.zeros(5)]
    model = ReluPerceptronModel(np.concatenate(weights))
    model.set(model.layers, [64, 6, 5])
    model.set(model.featuresCol, "embedding")
    scored = model.transform(table(spark, folder, "embeddings"))
    return scored.select(
        "vec_id",
        F.col("prediction").cast("int").alias("prediction"),
        rounded(F.array_max(vector_to_array("probability")), "probability"),
    )


@query
def relu_mlp_history(spark: SparkSession, folder: str) -> DataFrame:
    return _relu_model(spark, folder).history


@query
def image_head_history(spark: SparkSession, folder: str) -> DataFrame:
    """Dense head with dropout over features from a frozen model, with all training callbacks."""
    rows = inference.featurise(_held_out(spark, folder), "embedding", linear_model(64, 48), [64])
    estimator = ReluPerceptronClassifier(
        layers=[48, 46, 12, CLASSES],
        idCol="vec_id",
        maxIter=20,
        solver="sgd",
        stepSize=1e-4,
        decay=1e-6,
        momentum=1e-6,
        nesterov=True,
        dropout=[0.2, 0.0],
        miniBatchFraction=0.25,
        stepsPerEpoch=4,
        validationIndicatorCol="held_out",
        earlyStopPatience=4,
        keepBest=True,
        plateauPatience=3,
    )
    return estimator.fit(rows).history


# ---- evaluation ----------------------------------------------------------------------------------


@query
def accuracy_by_split(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.scores_by(gaussian_predictions(spark, folder), ["split"])
    return scores.select(
        "split", "n", rounded("accuracy", "accuracy"), rounded("majority_share", "majority_share")
    )


@query
def accuracy_percent_text(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.scores_by(gaussian_predictions(spark, folder), ["split"])
    return scores.select("split", X.percent_text(F.col("accuracy")).alias("accuracy_text"))


@query
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(gaussian_predictions(spark, folder))


@query
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    predictions = gaussian_predictions(spark, folder)
    found = evaluate.loss_and_accuracy(predictions, vector_to_array("probability"), ["split"])
    return found.select("split", "n", rounded("log_loss", "log_loss"), rounded("accuracy", "accuracy"))


@query
def majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.majority_baseline(table(spark, folder, "labels"), "quality")
    return found.select("n", "majority_label", rounded("majority_share", "majority_share"))


# ---- folds and search ----------------------------------------------------------------------------


@query
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return folds.stratified_folds(table(spark, folder, "embeddings"), "vec_id", "label", 3)


@query
def fold_majority_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = binary_labels(train_rows(spark, folder))
    marked = rows.select("label2", X.fold_of(F.col("vec_id")).alias("fold"))
    per_fold = evaluate.fold_majority(marked, "label2", "fold")
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"), rounded(F.avg("accuracy"), "mean_accuracy")
    )


def _search_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = train_rows(spark, folder).withColumn("fold", X.fold_of(F.col("vec_id")))
    return assembly.training_frame(rows, "embedding", "label", ["vec_id", "fold"])


@query
def cv_mlpc_grid(spark: SparkSession, folder: str) -> DataFrame:
    estimator = classify.sigmoid_perceptron([64, 8, CLASSES])
    layers = tune.perceptron_layers(64, [[8], [4], [8, 4]], CLASSES)
    grid = tune.grid_of(
        estimator, {"layers": layers, "stepSize": [0.001, 0.0001]}, {"maxIter": 20, "solver": "gd"}
    )
    model = tune.cross_validate(
        _search_rows(spark, folder), estimator, grid, fold_column="fold", parallelism=4
    )
    return tune.grid_report(spark, model)


@query
def cv_relu_grid(spark: SparkSession, folder: str) -> DataFrame:
    estimator = ReluPerceptronClassifier(layers=[64, 8, CLASSES], idCol="vec_id", maxIter=20)
    layers = tune.perceptron_layers(64, [[50], [10], [50, 20]], CLASSES)
    grid = tune.grid_of(estimator, {"layers": layers, "stepSize": [0.001, 0.0001]})
    model = tune.cross_validate(_search_rows(spark, folder), estimator, grid, fold_column="fold")
    return tune.grid_report(spark, model)
