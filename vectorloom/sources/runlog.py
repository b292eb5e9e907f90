"""Append-only log of timed runs, kept as JSON lines in a folder."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

RUN_SCHEMA = StructType(
    [
        StructField("mode", StringType()),
        StructField("method", StringType()),
        StructField("started_at", TimestampType()),
        StructField("epochs", IntegerType()),
        StructField("steps_per_epoch", IntegerType()),
        StructField("elapsed_seconds", DoubleType()),
        StructField("elapsed_minutes", DoubleType()),
        StructField("elapsed_hours", DoubleType()),
        StructField("slots", IntegerType()),
        StructField("parallelism", IntegerType()),
        StructField("accuracy", DoubleType()),
        StructField("accuracy_history", ArrayType(DoubleType())),
    ]
)
_BAD = "_corrupt_record"

# Keys of the logs that existing users hold, and the column each one becomes.
ARRAY_LOG_FIELDS = {
    "Tipo Ejecucion": "string",
    "Metodo": "string",
    "timestamp": "string",
    "Steps_per_epoch": "int",
    "Epochs": "int",
    "tiempo_ejecucion": "double",
    "tiempo_ejecucion_mins": "double",
    "tiempo_ejecucion_horas": "double",
    "Slots": "int",
    "accuracy": "string",
    "parallelism": "int",
    "paralelism": "int",
}


def timed(work: Callable[[], Any]) -> tuple[Any, float]:
    """Run `work` and return its result with the wall-clock seconds it took."""
    start = time.perf_counter()
    result = work()
    return result, time.perf_counter() - start


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records; columns missing from `runs` are logged as null."""
    known = set(runs.columns)
    columns = [
        (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RUN_SCHEMA.fields
    ]
    # The default writes milliseconds only.
    runs.select(*columns).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def append_run(
    spark: SparkSession, path: str, mode: str, method: str, elapsed_seconds: float, **fields: Any
) -> None:
    """Append one run. Concurrent writers are safe: each adds a file of its own."""
    record = {
        "mode": mode,
        "method": method,
        "started_at": datetime.now(timezone.utc),
        "elapsed_seconds": float(elapsed_seconds),
        "elapsed_minutes": elapsed_seconds / 60.0,
        "elapsed_hours": elapsed_seconds / 3600.0,
    } | fields
    unknown = set(record) - set(RUN_SCHEMA.names)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    row = tuple(record.get(name) for name in RUN_SCHEMA.names)
    append_runs(spark.createDataFrame([row], RUN_SCHEMA).coalesce(1), path)


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table; an absent log is empty. Unreadable lines stay visible in a column."""
    schema = StructType(RUN_SCHEMA.fields + [StructField(_BAD, StringType())])
    try:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", _BAD).json(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], schema)
        raise


def import_array_log(spark: SparkSession, path: str, shift_hours: int = 0) -> DataFrame:
    """Read an older log, one JSON array per file, into the columns of `read_log`.

    Older writers moved the clock by five hours and still marked it as UTC; `shift_hours=5` undoes
    that. `accuracy` was written as a number by some runs and as a list by others; both are kept. A file
    that does not parse yields one row with its text in `_corrupt_record`; so does a record whose time does not.
    """
    schema = StructType(
        [StructField(k, _TYPES[t]) for k, t in ARRAY_LOG_FIELDS.items()] + [StructField(_BAD, StringType())]
    )
    try:
        raw = (
            spark.read.schema(schema)
            .option("multiLine", True)
            .option("columnNameOfCorruptRecord", _BAD)
            .json(path)
        )
    except AnalysisException as error:
        if _missing(error):
            return read_log(spark, path)
        raise
    seconds = F.col("tiempo_ejecucion")
    is_list = F.col("accuracy").startswith("[")
    instant = F.try_to_timestamp("timestamp")
    unread = F.when(instant.isNull(), F.concat(F.lit("timestamp: "), F.col("timestamp")))
    return raw.select(
        F.col("Tipo Ejecucion").alias("mode"),
        F.col("Metodo").alias("method"),
        (instant + F.make_dt_interval(hours=F.lit(shift_hours))).alias("started_at"),
        F.col("Epochs").alias("epochs"),
        F.col("Steps_per_epoch").alias("steps_per_epoch"),
        seconds.alias("elapsed_seconds"),
        F.coalesce("tiempo_ejecucion_mins", seconds / 60.0).alias("elapsed_minutes"),
        F.coalesce("tiempo_ejecucion_horas", seconds / 3600.0).alias("elapsed_hours"),
        F.col("Slots").alias("slots"),
        F.coalesce("parallelism", "paralelism").alias("parallelism"),
        F.when(~is_list, F.col("accuracy").try_cast("double")).alias("accuracy"),
        F.when(is_list, F.from_json("accuracy", "array<double>")).alias("accuracy_history"),
        F.coalesce(F.col(_BAD), unread).alias(_BAD),
    )


_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType()}
