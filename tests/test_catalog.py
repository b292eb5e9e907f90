"""Every registered query, and its SQL twin where there is one."""

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from vectorloom.plans import ORACLES, QUERIES

ROWS_ONLY = {
    "file_listing": ["class_name", "file_name", "length"],
    "lr_predict": ["label", "prediction", "vec_id"],
    "lr_penalised_predict": ["label", "prediction", "vec_id"],
    "mlpc_predict": ["label", "prediction", "vec_id"],
    "relu_mlp_predict": ["label", "prediction", "vec_id"],
    "relu_mlp_history": None,
    "image_head_history": None,
    "cv_mlpc_grid": ["fold_mean", "fold_std", "params", "point", "rank"],
    "cv_relu_grid": ["fold_mean", "fold_std", "params", "point", "rank"],
}


@pytest.fixture(scope="module")
def tables(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, tables, name):
    got = contract.queries()[name](spark, folder).toPandas()
    wanted = tables.sql(contract.oracle_sql()[name]).df()
    assert len(wanted)
    assert differences(got, wanted) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(spark, folder, name):
    got = contract.queries()[name](spark, folder).toPandas()
    assert len(got)
    if ROWS_ONLY[name]:
        assert sorted(got.columns) == ROWS_ONLY[name]


def test_every_query_is_listed():
    assert set(QUERIES) == set(ORACLES) | set(ROWS_ONLY)
    assert not set(ORACLES) & set(ROWS_ONLY)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    got = contract.entry(spark).toPandas()
    assert sorted(got["split"]) == ["test", "train", "validation"]


@pytest.mark.parametrize("name", ["lr_predict", "lr_penalised_predict", "mlpc_predict", "relu_mlp_predict"])
def test_predictions_cover_every_split(spark, folder, name):
    got = contract.queries()[name](spark, folder)
    everything = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert sorted(r["vec_id"] for r in got.collect()) == sorted(r["vec_id"] for r in everything.collect())


def test_training_takes_all_iterations(spark, folder):
    assert contract.queries()["relu_mlp_history"](spark, folder).count() == 20
