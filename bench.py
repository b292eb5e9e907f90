"""Headline timings as one JSON line.

`queries` holds registered queries run to the last row, and `fit_*` entries that time only the fit of
a classifier, on a matrix of the shape that recorded runs are known for (about 15,000 rows of 1,000
class probabilities, two classes), derived from the customer table. Reading and caching the matrix is
outside the clock there, as it is in those records.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vectorloom import functions as X  # noqa: E402
from vectorloom.operators import assembly, classify, tune  # noqa: E402
from vectorloom.operators.relu_perceptron import ReluPerceptronClassifier  # noqa: E402
from vectorloom.operators.slot_training import fit_in_slots  # noqa: E402
from vectorloom.plans import QUERIES  # noqa: E402
from vectorloom.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WIDTH = 1000
HEADLINES = [
    "accuracy_by_split",
    "boxplot_stats",
    "class_histogram",
    "column_means",
    "feature_label_join",
    "gnb_predict",
    "image_featurise",
    "lineitem_boxplots",
    "lineitem_gnb_confusion",
    "lineitem_profile",
    "linear_featurise",
    "lr_predict",
    "mlpc_predict",
    "mnb_predict",
    "onehot_class_name",
    "rank_by_mean",
    "relu_mlp_predict",
    "run_log_round_trip",
    "stratified_folds",
    "top3_class_histograms",
]


def wide_matrix(spark):
    """One row of 1,000 positive numbers summing to one per customer, with a 74/26 label."""
    base = spark.read.parquet(f"{FOLDER}/customer.parquet").select("c_custkey", "c_acctbal")
    angle = lambda j: F.sin(F.col("c_custkey") * j * 0.37 + F.col("c_acctbal") * 0.001)
    scores = F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), angle)
    rows = base.repartition(int(CPUS)).select(
        F.col("c_custkey").alias("id"),
        X.fold_of(F.col("c_custkey")).alias("fold"),
        X.softmax(scores).alias("probabilities"),
        (F.col("c_acctbal") > 1860).cast("int").alias("label"),
    )
    return assembly.training_frame(rows, "probabilities", "label", ["id", "fold"])


def fits(rows: int):
    layers = [WIDTH, 500, 200, 2]
    relu = {"layers": layers, "maxIter": 20, "precision": "single", "idCol": "id"}
    return {
        "fit_logistic_regression": classify.logistic_regression(),
        "fit_penalised_logistic_regression": classify.penalised_logistic_regression(rows),
        "fit_multinomial_naive_bayes": classify.multinomial_naive_bayes(),
        "fit_gaussian_naive_bayes": classify.gaussian_naive_bayes(),
        "fit_sigmoid_perceptron_20": classify.sigmoid_perceptron(layers),
        "fit_relu_perceptron_20": ReluPerceptronClassifier(**relu),
    }


def grids():
    """The recorded search: six points, three folds, 20 iterations."""
    layers = [WIDTH, 500, 2]
    return {
        "grid_sigmoid_perceptron_20": classify.sigmoid_perceptron(layers),
        "grid_relu_perceptron_20": ReluPerceptronClassifier(
            layers=layers, idCol="id", precision="single", maxIter=20
        ),
    }


def search(rows, estimator):
    hidden = tune.perceptron_layers(WIDTH, [[500], [100], [500, 200]], 2)
    grid = tune.grid_of(estimator, {"layers": hidden, "stepSize": [0.001, 0.0001]})
    return tune.cross_validate(rows, estimator, grid, fold_column="fold", parallelism=4)


def clocked(work, runs: int = 2) -> float:
    """Best of `runs`: the first one also loads classes and starts Python workers."""
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        work()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    spark = build_session(
        app="bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = set(sys.argv[1:])
    wanted = lambda name: not only or name in only
    drain = lambda frame: frame.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    QUERIES["column_means"](spark, FOLDER).collect()
    for name in filter(wanted, HEADLINES):
        times[name] = clocked(lambda: drain(QUERIES[name](spark, FOLDER)))
        print(name, times[name], file=sys.stderr, flush=True)
    rows = wide_matrix(spark).cache()
    count = rows.count()
    for name, estimator in fits(count).items():
        if wanted(name):
            times[name] = clocked(lambda: estimator.fit(rows))
            print(name, times[name], file=sys.stderr, flush=True)
    name = "fit_relu_perceptron_20_epochs"  # mini-batches of 200 rows, as the recorded fits had
    if wanted(name):
        layers = [WIDTH, 500, 200, 2]
        small = ReluPerceptronClassifier(
            layers=layers, maxIter=20, precision="single", idCol="id", miniBatchFraction=200 / count
        )
        times[name] = clocked(lambda: fit_in_slots(rows, small, slots=1), runs=1)
        print(name, times[name], file=sys.stderr, flush=True)
    # Whole searches take minutes and run only when named.
    for name, estimator in grids().items():
        if name in only:
            times[name] = clocked(lambda: search(rows, estimator), runs=1)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries and fits",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
