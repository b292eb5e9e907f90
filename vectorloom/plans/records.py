"""Queries on published runs, image files and saved models, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import classify, inference
from vectorloom.operators.relu_perceptron import ReluPerceptronModel
from vectorloom.operators.runs import fit_and_log
from vectorloom.plans.catalog import CLASSES, embeddings, image_rows, linear_map, linear_model, query, record_columns, rounded, run_records, vectors
from vectorloom.plans.oracles import _E, _dot
from vectorloom.plans.training import _FORWARD, _STEP, LAYERS, ORACLES, QUERIES, STEP, _one_step, _pass, _updated, _weights, given_weights
from vectorloom.session import scratch_path
from vectorloom.sources import list_files, publish_runs, published_runs, scan_images, table, write_images
from vectorloom.sources.files import open_folder, put, shared_uri

# ---- run log -------------------------------------------------------------------------------------


@query
def run_log_published(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs, each published a second time by a job of another layout, which changes nothing."""
    path, runs = scratch_path(spark, "published"), run_records(spark, folder)
    clicks = F.col("method") == "click"
    for run_id, rows in (("clicks", runs.where(clicks)), ("others", runs.where(~clicks))):
        publish_runs(rows, path, run_id)
        publish_runs(rows.repartition(3), path, run_id)
    return published_runs(spark, path).select("run_id", *record_columns())


ORACLES["run_log_published"] = f"""SELECT CASE method WHEN 'click' THEN 'clicks' ELSE 'others' END AS run_id, *
  FROM ({ORACLES["run_log_all_columns"]})"""


@query
def fit_log_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Fit, time, score every split and publish in one call; a repeated call leaves the log as it is."""
    path, rows = scratch_path(spark, "fits"), vectors(embeddings(spark, folder))
    for _ in range(2):
        fit_and_log(rows, classify.gaussian_naive_bayes(), path, "first", "Cluster", "GaussianNB", slots=2)
    minutes = F.abs(F.col("elapsed_minutes") * 60 - F.col("elapsed_seconds")) < 1e-9
    return published_runs(spark, path).select(
        "run_id", "split", "mode", "method", "slots", "rows", rounded("accuracy", "accuracy"), rounded("majority_share", "majority_share"),
        ((F.col("elapsed_seconds") > 0) & minutes & F.col("started_at").isNotNull()).alias("timed"),
    )


ORACLES["fit_log_by_split"] = f"""SELECT 'first' AS run_id, split, 'Cluster' AS mode, 'GaussianNB' AS method, 2::INT AS slots,
  n AS rows, accuracy, majority_share, true AS timed FROM ({ORACLES["accuracy_by_split"]})"""


# ---- image files ---------------------------------------------------------------------------------


def image_folder(spark: SparkSession, folder: str) -> str:
    """Every embedding as a grey PNG file of 8 x 8 pixels below its class, beside a licence text and a broken image."""
    root = scratch_path(spark, "images")
    rows = image_rows(spark, folder).join(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id")
    write_images(rows.withColumn("class_name", F.concat(F.lit("class-"), F.col("label"))), root, "vec_id", "class_name")
    filesystem, inner = open_folder(shared_uri(spark, root))
    filesystem.create_dir(f"{inner}/class-0", recursive=True)
    for name in ("LICENSE.txt", "broken.png"):
        put(filesystem, f"{inner}/class-0/{name}", b"no image")
    return root


def file_id():
    """The id that an image file of `image_folder` is named by; -1 for other files."""
    return F.coalesce(F.regexp_extract("path", r"([0-9]+)\.png$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


@query
def image_file_list(spark: SparkSession, folder: str) -> DataFrame:
    """Name, class and the leading bytes of all files but the licence text."""
    files = list_files(spark, image_folder(spark, folder), content=True)
    name = F.element_at(F.split("path", "/"), -1)
    whole = F.octet_length("content") == F.col("length")
    return files.select(name.alias("file_name"), "class_name", F.hex(F.substring("content", 1, 24)).alias("head"), whole.alias("whole"))


# Signature, and a header that says 8 by 8 pixels.
ORACLES["image_file_list"] = """SELECT vec_id || '.png' AS file_name, 'class-' || label AS class_name,
    '89504E470D0A1A0A0000000D494844520000000800000008' AS head, true AS whole FROM embeddings
  UNION ALL SELECT 'broken.png', 'class-0', hex('no image'), true"""


@query
def image_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All pixels of all files, decoded; what is no image keeps an invalid row."""
    rows = scan_images(spark, image_folder(spark, folder), "*/*.png")
    image = F.col("image")
    pixels = F.when(F.col("valid"), F.hex(image["data"]))
    size = [image[c].alias(c) for c in ("height", "width", "nChannels")]
    return rows.select(file_id().alias("vec_id"), "class_name", "valid", *size, pixels.alias("pixels"))


ORACLES["image_file_scan"] = """SELECT vec_id, 'class-' || label AS class_name, true AS valid, 8::INT AS height, 8::INT AS width,
    1::INT AS "nChannels", array_to_string(list_transform(embedding, lambda v:
      printf('%02X', floor((CAST(v AS DOUBLE) + 1.0) * 127.5)::INT)), '') AS pixels FROM embeddings
  UNION ALL SELECT -1, 'class-0', false, -1, -1, -1, NULL"""


def dense_head() -> ReluPerceptronModel:
    """One hidden layer over four features, with weights that SQL can state."""
    last = linear_map(5, CLASSES) + np.arange(CLASSES) / 64.0
    model = ReluPerceptronModel(np.concatenate([linear_map(4, 5).ravel(), np.zeros(5), last.ravel(), np.zeros(CLASSES)]))
    model.set(model.layers, [4, 5, CLASSES])
    return model


@query
def image_file_head(spark: SparkSession, folder: str) -> DataFrame:
    """From files to classes: decode, halve, features of a frozen model, label from the folder, dense head."""
    images = scan_images(spark, image_folder(spark, folder), "*/*.png", keep_invalid=False)
    found = inference.featurise_images(images, linear_model(48, 4), 4, 4)
    unit = F.transform("features", lambda v: v.cast("double") / 256.0)
    found = found.withColumn("features", unit).withColumn("label", F.regexp_extract("class_name", "([0-9]+)$", 1).cast("int"))
    scored = dense_head().transform(found)
    return scored.select(
        file_id().alias("vec_id"), "label", F.col("prediction").cast("int").alias("prediction"),
        rounded(F.array_max(vector_to_array("probability")), "probability"),
    )


_FEATURES = ", ".join(f"f{o} / 256" for o in range(4))
_HALF = "(" + " + ".join(
    f"floor((CAST(embedding[16 * (i // 4) + 2 * (i % 4) + {d} + 1] AS DOUBLE) + 1) * 127.5)" for d in (0, 1, 8, 9)
) + ") / 4"
_DEEP = ", ".join(f"greatest({_dot(4, o, 'f[j + 1]')}, 0)" for o in range(5))
_SCORES_OF = ", ".join(f"{_dot(5, o, 'h[j + 1]')} + list_sum(h) * {o} / 64.0::DOUBLE" for o in range(CLASSES))
ORACLES["image_file_head"] = f"""WITH i AS (SELECT vec_id, label, list_transform(range(0, 16), lambda i: {_HALF}) AS px FROM embeddings),
  a AS (SELECT vec_id, label, {", ".join(f"{_dot(48, o, 'px[j // 3 + 1]')} AS f{o}" for o in range(4))} FROM i),
  f AS (SELECT vec_id, label, [{_FEATURES}] AS f FROM a),
  h AS (SELECT vec_id, label, [{_DEEP}] AS h FROM f),
  z AS (SELECT vec_id, label, [{_SCORES_OF}] AS z FROM h)
  SELECT vec_id, label::INT AS label, (list_position(z, list_max(z)) - 1)::INT AS prediction,
         round(1 / list_sum(list_transform(z, lambda s: exp(s - list_max(z)))), 6) + 0.0 AS probability FROM z"""


# ---- saved models and histories ------------------------------------------------------------------


def _reloaded(spark: SparkSession, folder: str) -> ReluPerceptronModel:
    """A model after one step, saved and loaded."""
    place = scratch_path(spark, "model")
    _one_step(spark, folder, solver="sgd", stepSize=STEP).write().save(place)
    return ReluPerceptronModel.load(place)


@query
def model_reload_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, _reloaded(spark, folder).weights)


@query
def model_reload_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Every row scored by the loaded model."""
    scored = _reloaded(spark, folder).transform(embeddings(spark, folder))
    best = F.array_max(vector_to_array("probability"))
    return scored.select("vec_id", "split", F.col("prediction").cast("int").alias("prediction"), rounded(best, "probability"))


ORACLES["model_reload_weights"] = f"""{_STEP}, {_updated(f"(-{STEP} * g)")}
  SELECT 0 AS layer, i::INT AS source, k::INT AS target, round(w, 6) + 0.0 AS weight FROM u0
  UNION ALL SELECT 1, k::INT, j::INT, round(w, 6) + 0.0 FROM u1"""
ORACLES["model_reload_predict"] = f"""{_STEP}, {_updated(f"(-{STEP} * g)")},
  every AS (SELECT vec_id, label, split, unnest(range(65))::INT AS i,
                   unnest(list_concat(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), [1.0::DOUBLE])) AS v FROM e),
  {_pass("every", "u0", "u1", "y")}
  SELECT e.vec_id, e.split, (min(py.j) FILTER (best))::INT AS prediction, round(exp(-min(cost)), 6) + 0.0 AS probability
  FROM py JOIN e USING (vec_id) GROUP BY e.vec_id, e.split"""

STILL = 1e-300  # a step so small that no score changes
EPOCHS = 9


@query
def relu_callbacks(spark: SparkSession, folder: str) -> DataFrame:
    """History of a run that cannot improve: the rate halves every two epochs, after five the run stops, the first is the best."""
    best = scratch_path(spark, "best")
    model = _one_step(
        spark, folder, solver="sgd", stepSize=STILL, earlyStopPatience=5, plateauPatience=2, plateauFactor=0.5, plateauFloor=0.0,
        keepBest=True, checkpointPath=best, epochs=EPOCHS,
    )
    first = _one_step(spark, folder, solver="sgd", stepSize=STILL)
    kept = np.array_equal(ReluPerceptronModel.load(best).weights, first.weights)
    numbers = ["loss", "accuracy", "val_loss", "val_accuracy"]
    rate = rounded(F.col("learning_rate") / STILL, "rate")
    return model.history.select("epoch", rate, *[rounded(n, n) for n in numbers], F.lit(kept).alias("best_is_first"))


ORACLES["relu_callbacks"] = f"""WITH {_E}, {_FORWARD},
  tr AS (SELECT * FROM x WHERE split = 'train'), va AS (SELECT * FROM x WHERE split = 'validation'),
  {_pass("tr", "w0", "w1", "")}, {_pass("va", "w0", "w1", "v")},
  sums AS (SELECT avg(cost) FILTER (j = label) AS loss, avg((best AND j = label)::INT) * 10 AS accuracy FROM p),
  held AS (SELECT avg(cost) FILTER (j = label) AS loss, avg((best AND j = label)::INT) * 10 AS accuracy FROM pv)
  SELECT range::INT AS epoch, round(0.5 ** ((range - 1) // 2 * (range > 0)::INT), 6) + 0.0 AS rate,
         round(sums.loss, 6) + 0.0 AS loss, round(sums.accuracy, 6) + 0.0 AS accuracy,
         round(held.loss, 6) + 0.0 AS val_loss, round(held.accuracy, 6) + 0.0 AS val_accuracy, true AS best_is_first
  FROM range(6), sums, held"""

__all__ = ["ORACLES", "QUERIES"]
