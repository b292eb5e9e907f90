import numpy as np
import pytest
from blobs import blob_arrays
from pyspark.sql import functions as F

from vectorloom.operators import assembly, tune
from vectorloom.operators import relu_perceptron as R
from vectorloom.operators.relu_perceptron import ReluPerceptronClassifier, ReluPerceptronModel
from vectorloom.operators.training import Adam, BestWeights, EarlyStop, Plateau, Sgd


def learner(**params):
    settings = {"layers": [4, 6, 2], "maxIter": 8, "stepSize": 0.05, "idCol": "id"}
    return ReluPerceptronClassifier(**(settings | params))


def accuracy(model, rows):
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


# ---- the network ---------------------------------------------------------------------------------


@pytest.mark.parametrize("loss", ["softmax", "sigmoid"])
@pytest.mark.parametrize("dropout", [[], [0.4, 0.2]])
def test_gradient_is_the_slope_of_the_loss(loss, dropout):
    rng = np.random.default_rng(2)
    net = R._Net([3, 5, 4, 3], loss, dropout, salt=11)
    x, y, keys = rng.normal(size=(7, 3)), rng.integers(0, 3, 7).astype(np.int32), np.arange(7)
    flat = R.glorot_weights(net.layers, 1) + 0.05 * rng.normal(size=R.weight_count(net.layers))

    def total(weights):
        sums = np.zeros(len(weights) + 3)
        R.add_gradient(sums, net, weights, x, y, keys)
        return sums

    found = total(flat)
    assert found[-1] == 7
    for i in rng.permutation(len(flat))[:30]:
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (total(flat + step)[-3] - total(flat - step)[-3]) / 2e-6
        assert found[i] == pytest.approx(slope, abs=1e-5)


def test_losses_by_hand():
    scores = np.array([[0.0, np.log(3.0)]])
    assert R.losses_of(scores, np.array([1]), "softmax")[0] == pytest.approx(np.log(4 / 3))
    wanted = -(np.log(0.5) + np.log(0.75)) / 2
    assert R.losses_of(scores, np.array([1]), "sigmoid")[0] == pytest.approx(wanted)
    assert np.isfinite(R.losses_of(np.array([[1e4, -1e4]]), np.array([1]), "softmax")).all()


def test_dropout_mask_follows_the_row():
    keys = np.array([5, 9, 5])
    mask = R.keep_mask(keys, 2000, 0.3, 17)
    assert (mask[0] == mask[2]).all() and (mask[0] != mask[1]).any()
    assert set(np.unique(mask)) == {0.0, 1 / 0.7}
    assert mask.mean() == pytest.approx(1.0, abs=0.05)
    assert (R.keep_mask(keys, 2000, 0.3, 18) != mask).any()


def test_initial_weights_are_bounded():
    flat = R.glorot_weights([10, 6, 2], 3)
    (first, bias), _ = R.layer_views(flat, [10, 6, 2])
    assert np.abs(first).max() <= np.sqrt(6 / 16) and not bias.any()
    assert (flat == R.glorot_weights([10, 6, 2], 3)).all()


# ---- optimisers and callbacks ---------------------------------------------------------------------


def test_adam_by_hand():
    adam = Adam(0.1)
    weights = adam.update(np.array([1.0]), np.array([4.0]))
    assert weights[0] == pytest.approx(0.9, abs=1e-6)
    mean, square = 0.9 * 0.1 * 4 + 0.1 * -2, 0.999 * 0.001 * 16 + 0.001 * 4
    wanted = weights[0] - 0.1 * (mean / (1 - 0.81)) / np.sqrt(square / (1 - 0.999**2))
    assert adam.update(weights, np.array([-2.0]))[0] == pytest.approx(wanted, abs=1e-6)


def test_nesterov_steps_on_a_quadratic():
    sgd, w = Sgd(0.1, momentum=0.5, decay=0.1, nesterov=True), np.array([1.0])
    w = sgd.update(w, w.copy())
    assert w[0] == pytest.approx(1 - 0.1 - 0.05)
    rate = 0.1 / 1.1
    velocity = 0.5 * -0.1 - rate * 0.85
    assert sgd.update(w, w.copy())[0] == pytest.approx(0.85 + 0.5 * velocity - rate * 0.85)


def test_plain_momentum():
    sgd = Sgd(0.1, momentum=0.5)
    assert sgd.update(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.9)
    assert sgd.update(np.array([0.9]), np.array([1.0]))[0] == pytest.approx(0.75)


def test_early_stop_counts_epochs_without_gain():
    stop = EarlyStop(2)
    assert [stop.seen(v) for v in (3, 2, 2, 1, 1.5, 1.2)] == [False, False, False, False, False, True]


def test_plateau_halves_down_to_the_floor():
    plateau, rate, seen = Plateau(2, 0.5, 0.3), 1.0, []
    for value in (0.5, 0.5, 0.5, 0.6, 0.6, 0.6, 0.6, 0.6):
        rate = plateau.rate_after(value, rate)
        seen.append(rate)
    assert seen == [1.0, 1.0, 0.5, 0.5, 0.5, 0.3, 0.3, 0.3]


def test_plateau_never_raises_a_low_rate():
    plateau = Plateau(1, 0.5, 0.1)
    assert [plateau.rate_after(0.0, 0.01) for _ in range(3)] == [0.01] * 3


def test_best_weights():
    best = BestWeights()
    assert [best.seen(i, v, np.array([i])) for i, v in enumerate((3.0, 1.0, 2.0))] == [True, True, False]
    assert best.epoch == 1 and best.weights[0] == 1


# ---- training ------------------------------------------------------------------------------------


def test_learns_and_keeps_history(blobs):
    model = learner(maxIter=20).fit(blobs)
    assert accuracy(model, blobs) > 0.95
    history = model.history.orderBy("epoch").collect()
    assert [h.epoch for h in history] == list(range(20)) and all(h.rows == 200 for h in history)
    assert history[-1].loss < history[0].loss and history[0].val_loss is None


def reference_fit(points, labels, epochs, rate, seed=4321, layers=(4, 6, 2)):
    """The same full-batch training without Spark."""
    net, weights, adam = R._Net(list(layers), "softmax", []), R.glorot_weights(layers, seed), Adam(rate)
    for _ in range(epochs):
        total = np.zeros(len(weights) + 3)
        R.add_gradient(total, net, weights, points, labels.astype(np.int32), np.arange(len(labels)))
        weights = adam.update(weights, total[:-3] / total[-1])
    return weights


@pytest.mark.parametrize("slots", [1, 2, 7])
def test_full_batch_fit_does_not_depend_on_slots(blobs, slots):
    points, labels = blob_arrays()
    model = learner(numPartitions=slots).fit(blobs)
    np.testing.assert_allclose(model.weights, reference_fit(points, labels, 8, 0.05), rtol=1e-7, atol=1e-9)


def test_mini_batches_and_dropout_do_not_depend_on_slots(blobs):
    fits = [
        learner(miniBatchFraction=0.25, dropout=[0.3], numPartitions=n, maxIter=2).fit(blobs.repartition(n + 1))
        for n in (1, 4)
    ]
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, rtol=1e-7, atol=1e-9)
    assert [h.rows for h in fits[0].history.collect()] == [200, 200]
    assert [h.steps for h in fits[0].history.collect()] == [4, 4]


def test_distributed_and_direct_sums_agree(blobs, monkeypatch):
    direct = learner(maxIter=3).fit(blobs)
    monkeypatch.setattr(R, "DIRECT_BYTES", 0)
    monkeypatch.setattr(R, "CHUNK", 16)
    spread = learner(maxIter=3).fit(blobs)
    np.testing.assert_allclose(direct.weights, spread.weights, rtol=1e-9, atol=1e-12)


def test_small_blocks_give_the_same_sums(blobs, monkeypatch):
    whole = learner(maxIter=3, miniBatchFraction=0.5).fit(blobs)
    monkeypatch.setattr(R, "BLOCK_ROWS", 3)
    small = learner(maxIter=3, miniBatchFraction=0.5).fit(blobs)
    np.testing.assert_allclose(whole.weights, small.weights, rtol=1e-9, atol=1e-12)


def test_repeated_rows_spread_over_mini_batches(spark):
    """Without an id, copies of one row must not end up in one batch."""
    rows = spark.range(400).select(F.array(F.lit(1.0), F.lit(2.0)).alias("features"), F.lit(0).alias("label"))
    model = ReluPerceptronClassifier(layers=[2, 2], miniBatchFraction=0.25, stepsPerEpoch=1, maxIter=4).fit(rows)
    assert [h.rows for h in model.history.orderBy("epoch").collect()] == [100] * 4


def test_bounded_epochs_go_on_where_they_ended(blobs):
    model = learner(miniBatchFraction=0.25, stepsPerEpoch=1, maxIter=4).fit(blobs)
    rows = [h.rows for h in model.history.orderBy("epoch").collect()]
    assert sum(rows) == 200 and max(rows) < 100


def test_vector_and_float_features(spark, blobs):
    as_vector = assembly.training_frame(blobs, "features", "label", ["id"])
    as_float = blobs.withColumn("features", F.col("features").cast("array<float>"))
    base = learner(maxIter=3).fit(blobs).weights
    np.testing.assert_allclose(learner(maxIter=3).fit(as_vector).weights, base, rtol=1e-9)
    np.testing.assert_allclose(learner(maxIter=3).fit(as_float).weights, base, rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose(learner(maxIter=3, precision="single").fit(as_float).weights, base, rtol=1e-2, atol=1e-3)


def test_penalty_shrinks_weights(blobs):
    free, tied = (learner(regParam=p, maxIter=20).fit(blobs).weights for p in (0.0, 1.0))
    assert np.square(tied).sum() < np.square(free).sum()


def test_validation_and_callbacks(spark, blobs, tmp_path):
    rows = blobs.withColumn("held_out", F.col("id") % 5 == 0)
    path = str(tmp_path / "best")
    model = learner(
        maxIter=30, stepSize=1.0, validationIndicatorCol="held_out", earlyStopPatience=2, keepBest=True,
        checkpointPath=path, plateauPatience=2, layers=[4, 2],
    ).fit(rows)
    history = model.history.orderBy("epoch").collect()
    assert all(h.rows == 160 and h.val_loss is not None for h in history)
    losses = [h.val_loss for h in history]
    assert len(history) == 30 or min(losses[-2:]) >= min(losses)
    best = int(np.argmin(losses))
    held = rows.where("held_out")
    from vectorloom.operators.evaluate import loss_and_accuracy
    from pyspark.ml.functions import vector_to_array

    score = loss_and_accuracy(model.transform(held), vector_to_array("probability")).first()
    assert score.log_loss == pytest.approx(losses[best], rel=1e-6)
    np.testing.assert_array_equal(ReluPerceptronModel.load(path).weights, model.weights)


def test_callbacks_need_validation_rows(blobs):
    with pytest.raises(ValueError, match="validationIndicatorCol"):
        learner(earlyStopPatience=2).fit(blobs)


def test_save_and_load(spark, blobs, tmp_path):
    model = learner(maxIter=2, predictionCol="guess").fit(blobs)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = ReluPerceptronModel.load(str(tmp_path / "m"))
    assert again.uid == model.uid and again.getPredictionCol() == "guess"
    np.testing.assert_array_equal(again.weights, model.weights)
    assert again.history.collect() == model.history.collect()
    both = [m.transform(blobs).orderBy("id").select("guess", "probability").collect() for m in (model, again)]
    assert both[0] == both[1]
    estimator = learner(dropout=[0.5])
    estimator.write().overwrite().save(str(tmp_path / "e"))
    assert ReluPerceptronClassifier.load(str(tmp_path / "e")).getOrDefault("dropout") == [0.5]


@pytest.mark.parametrize("params", [{}, {"idCol": None, "numPartitions": 6}])
def test_lost_blocks_are_recomputed(spark, blobs, monkeypatch, params):
    """Dropping all cached blocks before every step must not change what is learned."""
    settings = {"maxIter": 2, "miniBatchFraction": 0.25, "dropout": [0.2]} | params
    source = spark.createDataFrame(blobs.toPandas()).repartition(4, "id")
    kept = learner(**settings).fit(source)
    whole_sum = R._Blocks.sum

    def forgetful(self, *args):
        self.cached.unpersist(blocking=True)
        return whole_sum(self, *args)

    monkeypatch.setattr(R._Blocks, "sum", forgetful)
    np.testing.assert_allclose(learner(**settings).fit(source).weights, kept.weights, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("limit", [R.DIRECT_BYTES, 0], ids=["direct", "spread"])
def test_shared_fits_equal_single_fits(blobs, monkeypatch, limit):
    monkeypatch.setattr(R, "DIRECT_BYTES", limit)
    monkeypatch.setattr(R, "CHUNK", 10)
    estimator = learner()
    grid = tune.grid_of(estimator, {"layers": [[4, 3, 2], [4, 5, 2]], "maxIter": [2, 3]})
    together = dict(estimator.fitMultiple(blobs, grid))
    assert sorted(together) == [0, 1, 2, 3]
    for index, settings in enumerate(grid):
        alone = estimator.copy(settings).fit(blobs)
        np.testing.assert_allclose(together[index].weights, alone.weights, rtol=1e-9, atol=1e-12)
        assert len(together[index]._history) == settings[estimator.maxIter]


def test_variants_with_other_data_settings_are_fitted_apart(blobs):
    estimator = learner(maxIter=1)
    grid = tune.grid_of(estimator, {"miniBatchFraction": [1.0, 0.5], "stepSize": [0.1, 0.2]})
    fits = R._SharedFits(blobs, [estimator.copy(g) for g in grid])
    assert fits.groups == [[0, 1], [2, 3]]
    assert sorted(i for i, _ in fits) == [0, 1, 2, 3]


def test_search_over_the_perceptron(spark, blobs):
    rows = blobs.withColumn("fold", (F.col("id") % 3).cast("int"))
    estimator = learner(maxIter=10)
    grid = tune.grid_of(estimator, {"stepSize": [1e-7, 0.05]})
    model = tune.cross_validate(rows, estimator, grid, fold_column="fold")
    best = tune.best_point(tune.grid_report(spark, model)).first()
    assert best.point == 1 and best.fold_mean > 0.9


@pytest.mark.parametrize(
    "change, message",
    [
        ({"layers": [3, 2]}, "feature row must hold 3"),
        ({"layers": [4, 1]}, "labels must be whole numbers"),
        ({"layers": [4]}, "input and an output"),
        ({"solver": "newton"}, "adam or sgd"),
        ({"loss": "hinge"}, "softmax or sigmoid"),
        ({"layers": [4, 100_000, 10_000, 2]}, "exceed the limit"),
    ],
)
def test_bad_settings(blobs, change, message):
    with pytest.raises(Exception, match=message):
        learner(**change).fit(blobs)


def test_no_training_rows(blobs):
    with pytest.raises(ValueError, match="no training rows"):
        learner().fit(blobs.where("id < 0"))


def test_blocks_are_released(spark, blobs):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    learner(maxIter=1).fit(blobs)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
