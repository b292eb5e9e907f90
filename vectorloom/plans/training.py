"""Queries on training steps and searches whose results SQL can state, with that SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import functions as X
from vectorloom.operators import fold_search, newton, tune
from vectorloom.operators.relu_perceptron import ReluPerceptronClassifier, layer_views
from vectorloom.operators.slot_training import fit_in_slots
from vectorloom.plans.catalog import CLASSES, QUERIES, embeddings, linear_map, query, rounded, train_rows
from vectorloom.plans.oracles import _E, ORACLES
from vectorloom.session import scratch_path
from vectorloom.sources import table

LAYERS = [64, 6, CLASSES]
STEP = 0.5


def given_weights() -> np.ndarray:
    """Weights and biases that SQL can state as well; no two classes are alike, so that no scores tie."""
    k, j = np.meshgrid(np.arange(6), np.arange(CLASSES), indexing="ij")
    last = ((7 * k + 3 * j) % 11 - 5) / 8.0
    return np.concatenate([linear_map(64, 6).ravel(), np.zeros(6), last.ravel(), np.zeros(CLASSES)])


def _one_step(spark: SparkSession, folder: str, epochs: int = 1, **settings):
    """One full-batch step an epoch over the training split in two slots, scored on the validation split."""
    rows = embeddings(spark, folder).where(F.col("split") != "test").withColumn("held_out", F.col("split") == "validation")
    estimator = ReluPerceptronClassifier(
        layers=LAYERS, featuresCol="embedding", idCol="vec_id", maxIter=epochs, validationIndicatorCol="held_out", **settings
    )
    return fit_in_slots(rows, estimator, slots=2, start_weights=given_weights())


def _weights(spark: SparkSession, flat: np.ndarray) -> DataFrame:
    found = []
    for depth, (matrix, bias) in enumerate(layer_views(flat, LAYERS)):
        found += [(depth, i, j, float(v)) for (i, j), v in np.ndenumerate(np.vstack([matrix, bias]))]
    table = spark.createDataFrame(found, "layer int, source int, target int, weight double")
    return table.select("layer", "source", "target", rounded("weight", "weight"))


@query
def relu_sgd_step(spark: SparkSession, folder: str) -> DataFrame:
    """All weights after one step of Nesterov's descent; the source after the last one is the bias."""
    model = _one_step(spark, folder, solver="sgd", stepSize=STEP, momentum=0.5, decay=0.1, nesterov=True)
    return _weights(spark, model.weights)


@query
def relu_adam_step(spark: SparkSession, folder: str) -> DataFrame:
    """Direction and size of one Adam step, for weights with a clear slope."""
    model = _one_step(spark, folder, solver="adam", stepSize=0.25)
    moved = _weights(spark, model.weights - given_weights())
    return moved.where(F.abs("weight") > 0.249).select("layer", "source", "target", rounded("weight", "moved", 3))


@query
def relu_step_history(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy before a step on the training split, and after it on the validation split."""
    model = _one_step(spark, folder, solver="sgd", stepSize=STEP)
    numbers = ["loss", "accuracy", "val_loss", "val_accuracy"]
    return model.history.select("epoch", "steps", "rows", "learning_rate", *[rounded(n, n) for n in numbers])


# Layer 0 has 64 inputs and a constant one for the bias (source 64), layer 1 six and a constant one.
_FORWARD = """
  w0 AS (SELECT i, k, CASE WHEN i = 64 THEN 0.0 ELSE ((7 * i + 3 * k) % 5 - 2) / 4.0 END::DOUBLE AS w
         FROM range(65) a(i), range(6) b(k)),
  w1 AS (SELECT k, j, CASE WHEN k = 6 THEN 0.0 ELSE ((7 * k + 3 * j) % 11 - 5) / 8.0 END::DOUBLE AS w
         FROM range(7) a(k), range(10) b(j)),
  x AS (SELECT vec_id, label, split, unnest(range(65))::INT AS i,
               unnest(list_concat(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), [1.0::DOUBLE])) AS v
        FROM e WHERE split <> 'test')"""


def _pass(rows: str, w0: str, w1: str, tag: str) -> str:
    """Hidden values and class chances of `rows` under two weight tables."""
    return f"""
  h{tag} AS (SELECT vec_id, label, k, greatest(sum(v * w), 0) AS h FROM {rows} JOIN {w0} USING (i) GROUP BY vec_id, label, k
           UNION ALL SELECT DISTINCT vec_id, label, 6, 1.0 FROM {rows}),
  z{tag} AS (SELECT vec_id, label, j, sum(h * w) AS z FROM h{tag} JOIN {w1} USING (k) GROUP BY vec_id, label, j),
  t{tag} AS (SELECT vec_id, max(z) AS top FROM z{tag} GROUP BY vec_id),
  s{tag} AS (SELECT vec_id, max(top) AS top, sum(exp(z - top)) AS total FROM z{tag} JOIN t{tag} USING (vec_id) GROUP BY vec_id),
  p{tag} AS (SELECT vec_id, label, j, exp(z - top) / total - (j = label)::INT AS miss,
                  ln(total) + top - z AS cost, z = top AS best
           FROM z{tag} JOIN s{tag} USING (vec_id))"""


_STEP = f"""WITH {_E}, {_FORWARD}, tr AS (SELECT * FROM x WHERE split = 'train'), {_pass("tr", "w0", "w1", "")},
  n AS (SELECT count(DISTINCT vec_id) AS n FROM tr),
  b AS (SELECT vec_id, k, sum(miss * w) AS back FROM p JOIN w1 USING (j) WHERE k < 6 GROUP BY vec_id, k),
  g1 AS (SELECT k, j, sum(h * miss) / any_value(n) AS g FROM h JOIN p USING (vec_id), n GROUP BY k, j),
  g0 AS (SELECT i, b.k, sum(v * CASE WHEN h > 0 THEN back ELSE 0 END) / any_value(n) AS g
         FROM tr JOIN b USING (vec_id) JOIN h ON h.vec_id = tr.vec_id AND h.k = b.k, n GROUP BY i, b.k)"""


def _updated(change: str) -> str:
    return f"""
  u0 AS (SELECT i, k, w + {change} AS w FROM w0 JOIN g0 USING (i, k)),
  u1 AS (SELECT k, j, w + {change} AS w FROM w1 JOIN g1 USING (k, j))"""


_BOTH = """SELECT 0 AS layer, i::INT AS source, k::INT AS target, {0} FROM {1}0
  UNION ALL SELECT 1, k::INT, j::INT, {0} FROM {1}1"""

ORACLES["relu_sgd_step"] = f"{_STEP}, {_updated(f'(-{STEP} * 1.5 * g)')} " + _BOTH.format("round(w, 6) + 0.0 AS weight", "u")
_MOVED = "round(-0.25 * g / (abs(g) + 1e-8 / sqrt(0.001)), 6)"
_MOVES = _BOTH.format(f"round({_MOVED}, 3) + 0.0 AS moved, abs({_MOVED}) > 0.249 AS clear", "g")
ORACLES["relu_adam_step"] = f"{_STEP} SELECT layer, source, target, moved FROM ({_MOVES}) WHERE clear"
ORACLES["relu_step_history"] = f"""{_STEP}, {_updated(f"(-{STEP} * g)")},
  va AS (SELECT * FROM x WHERE split = 'validation'), {_pass("va", "u0", "u1", "v")},
  sums AS (SELECT avg(cost) FILTER (j = label) AS loss, avg((best AND j = label)::INT) * 10 AS accuracy FROM p),
  held AS (SELECT avg(cost) FILTER (j = label) AS loss, avg((best AND j = label)::INT) * 10 AS accuracy FROM pv)
  SELECT 0 AS epoch, 1 AS steps, n::BIGINT AS rows, {STEP}::DOUBLE AS learning_rate, round(sums.loss, 6) + 0.0 AS loss,
         round(sums.accuracy, 6) + 0.0 AS accuracy, round(held.loss, 6) + 0.0 AS val_loss, round(held.accuracy, 6) + 0.0 AS val_accuracy
  FROM n, sums, held"""


# ---- logistic regression -------------------------------------------------------------------------


@query
def lr_newton_onehot(spark: SparkSession, folder: str) -> DataFrame:
    """Return flag by line status: with one column per status the optimum is the logarithm of the shares."""
    flags, statuses = ["A", "N", "R"], ["F", "O"]
    lines = table(spark, folder, "lineitem").select(
        X.one_hot_name(F.col("l_linestatus"), statuses).alias("features"),
        (F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")) - 1).alias("label"),
    )
    found = newton.fit(lines, "features", "label", len(statuses), len(flags), intercept=False)
    rows = [(flags[k], statuses[j], float(v)) for (k, j), v in np.ndenumerate(found.coefficients)]
    made = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, coefficient double")
    return made.select("l_returnflag", "l_linestatus", rounded("coefficient", "coefficient"))


ORACLES["lr_newton_onehot"] = """WITH c AS (
    SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
  d AS (SELECT l_linestatus, l_returnflag, ln(n / sum(n) OVER (PARTITION BY l_linestatus)) AS share FROM c)
  SELECT l_returnflag, l_linestatus, round(share - avg(share) OVER (PARTITION BY l_linestatus), 6) + 0.0 AS coefficient FROM d"""


@query
def lr_newton_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Slope of the penalised mean loss at the fit on the training split, per class and column."""
    rows = train_rows(spark, folder)
    found = newton.fit(rows, "embedding", "label", 64, CLASSES, penalty=1.0 / rows.count())
    slopes = [(k, j, float(v)) for (k, j), v in np.ndenumerate(found.slope[:, :-1])]
    return spark.createDataFrame(slopes, "class int, pos int, slope double").select("class", "pos", rounded("slope", "slope", 8))


ORACLES["lr_newton_slope"] = ORACLES["lr_stationarity"]


# ---- searches ------------------------------------------------------------------------------------


def _search_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = train_rows(spark, folder)
    return rows.select(
        "vec_id", "label", X.softmax(F.col("embedding")).alias("shares"), F.col("embedding").cast("array<double>").alias("values"),
        X.fold_of(F.col("vec_id")).alias("fold"),
    )


@query
def cv_multinomial_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothing of multinomial Naive Bayes by three-fold cross-validation."""
    report = fold_search.multinomial_search(_search_rows(spark, folder), "shares", "label", "fold", [0.0001, 0.001, 0.1, 1.0])
    return report.select("point", "params", rounded("fold_mean", "fold_mean"), rounded("fold_std", "fold_std"), "rank")


@query
def cv_gaussian_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Variance floor of Gaussian Naive Bayes by three-fold cross-validation."""
    report = fold_search.gaussian_search(_search_rows(spark, folder), "values", "label", "fold", [1e-9, 0.1, 1.0])
    return report.select("point", "params", rounded("fold_mean", "fold_mean"), rounded("fold_std", "fold_std"), "rank")


@query
def cv_best_point(spark: SparkSession, folder: str) -> DataFrame:
    report = fold_search.multinomial_search(_search_rows(spark, folder), "shares", "label", "fold", [0.0001, 0.001, 0.1, 1.0])
    return tune.best_point(report).select("point", "params", rounded("fold_mean", "fold_mean"))


@query
def cv_report_dump(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as JSON lines and read back."""
    place = scratch_path(spark, "grid-report")
    tune.write_report(cv_gaussian_grid(spark, folder), place)
    kept = spark.read.schema("point int, params string, fold_mean double, fold_std double, rank int").json(place)
    return kept.select("point", "params", rounded("fold_mean", "fold_mean"), "rank")


_FOLDS = f"""{_E}, t AS (
  SELECT vec_id, label, (vec_id % 3)::INT AS fold, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS raw
  FROM e WHERE split = 'train'),
  y AS (SELECT vec_id, label, fold, unnest(range(len(raw)))::INT AS pos, unnest(raw) AS v,
               unnest(list_transform(raw, lambda v: exp(v) / list_sum(list_transform(raw, lambda w: exp(w))))) AS q FROM t),
  f AS (SELECT range::INT AS held FROM range(3))"""


def _report(points: list[float], name: str, scores: str) -> str:
    grid = ", ".join(f"({k}, {p!r}::DOUBLE, '{{\"{name}\": {p!r}}}')" for k, p in enumerate(points))
    return f"""WITH {_FOLDS}, g AS (SELECT * FROM (VALUES {grid}) g(point, a, params)), {scores},
  hit AS (SELECT point, held, vec_id, label, min(k) FILTER (score = top) AS k
          FROM (SELECT *, max(score) OVER (PARTITION BY point, held, vec_id) AS top FROM sc)
          GROUP BY point, held, vec_id, label),
  acc AS (SELECT point, held, avg((k = label)::INT) AS accuracy FROM hit GROUP BY point, held),
  rep AS (SELECT point, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM acc GROUP BY point)
  SELECT point::INT AS point, params, round(m, 6) + 0.0 AS fold_mean, round(s, 6) + 0.0 AS fold_std,
         row_number() OVER (ORDER BY round(m, 12) DESC, point)::INT AS rank
  FROM rep JOIN g USING (point)"""


_MULTINOMIAL = """
  cn AS (SELECT held, label, ln((count(*) + a) / (sum(count(*)) OVER (PARTITION BY held, point) + a * count(*) OVER (PARTITION BY held, point))) AS pi, point
         FROM t, f, g WHERE fold <> held GROUP BY held, label, point, a),
  th AS (SELECT held, label, pos, point, ln((sum(q) + a) / (sum(sum(q)) OVER (PARTITION BY held, label, point) + a * count(*) OVER (PARTITION BY held, label, point))) AS theta
         FROM y, f, g WHERE fold <> held GROUP BY held, label, pos, point, a),
  sc AS (SELECT th.point, th.held, vec_id, y.label, th.label AS k, sum(q * theta) + any_value(pi) AS score
         FROM y JOIN th ON y.pos = th.pos AND y.fold = th.held
         JOIN cn ON cn.held = th.held AND cn.label = th.label AND cn.point = th.point
         GROUP BY th.point, th.held, vec_id, y.label, th.label)"""
_GAUSSIAN = """
  fl AS (SELECT held, max(sv) AS top FROM (SELECT held, pos, var_samp(v) AS sv FROM y, f WHERE fold <> held GROUP BY held, pos) GROUP BY held),
  cn AS (SELECT held, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY held)) AS pi FROM t, f WHERE fold <> held GROUP BY held, label),
  st AS (SELECT held, label, pos, avg(v) AS mu, var_pop(v) AS s2 FROM y, f WHERE fold <> held GROUP BY held, label, pos),
  sc AS (SELECT g.point, st.held, vec_id, y.label, st.label AS k,
                sum(-0.5 * ln(2 * pi() * (s2 + a * top)) - (v - mu) ** 2 / (2 * (s2 + a * top))) + any_value(cn.pi) AS score
         FROM y JOIN st ON y.pos = st.pos AND y.fold = st.held JOIN fl ON fl.held = st.held
         JOIN cn ON cn.held = st.held AND cn.label = st.label, g
         GROUP BY g.point, st.held, vec_id, y.label, st.label)"""

ORACLES["cv_multinomial_grid"] = _report([0.0001, 0.001, 0.1, 1.0], "smoothing", _MULTINOMIAL)
ORACLES["cv_gaussian_grid"] = _report([1e-9, 0.1, 1.0], "varFloor", _GAUSSIAN)
ORACLES["cv_best_point"] = f"SELECT point, params, fold_mean FROM ({ORACLES['cv_multinomial_grid']}) WHERE rank = 1"
ORACLES["cv_report_dump"] = f"SELECT point, params, fold_mean, rank FROM ({ORACLES['cv_gaussian_grid']})"

__all__ = ["ORACLES", "QUERIES"]
