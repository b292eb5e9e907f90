"""One call for a run: fit, time, score by split, publish in the log."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.scalars import hours, minutes
from vectorloom.operators.evaluate import scores_by
from vectorloom.sources.published_log import publish_runs
from vectorloom.sources.runlog import timed


def fit_and_log(
    rows: DataFrame,
    estimator: Estimator,
    path: str,
    run_id: str,
    mode: str,
    method: str,
    split: str = "split",
    train: str = "train",
    label: str = "label",
    **fields: Any,
) -> Model:
    """Fit on the training split, and publish one record per split with its rows, accuracy and majority share.

    `fields` are further values of the record. Only the fit is timed. Calling it again with a published `run_id`
    fits again, but leaves the log as it is.
    """
    started = datetime.now(timezone.utc)
    model, seconds = timed(lambda: estimator.fit(rows.where(F.col(split) == train)))
    scores = scores_by(model.transform(rows), [split], label=label)
    values = {"mode": mode, "method": method, "started_at": started} | fields
    elapsed = F.lit(float(seconds))
    runs = scores.select(
        F.col(split).alias("split"),
        F.col("n").alias("rows"),
        "accuracy",
        "majority_share",
        elapsed.alias("elapsed_seconds"),
        minutes(elapsed).alias("elapsed_minutes"),
        hours(elapsed).alias("elapsed_hours"),
        *[F.lit(value).alias(name) for name, value in values.items()],
    )
    publish_runs(runs, path, run_id)
    return model
