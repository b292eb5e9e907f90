"""Cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from vectorloom.operators.selection import order_statistics
from vectorloom.operators.sizing import positions


def _edges(total: int, folds: int) -> list[int]:
    """First position of every fold but the first; the first `total % folds` folds are one longer."""
    small, longer = divmod(total, folds)
    return [k * small + min(k, longer) for k in range(1, folds)]


def stratified_folds(rows: DataFrame, row_id: str, label: str, folds: int = 3) -> DataFrame:
    """`row_id`, label and fold (from 0), each label cut into equal runs in id order.

    The result of `ntile` over a window per label. Numeric ids without repeats within a label need no shuffle of rows:
    the ids at which folds begin are found by selection and sent to the rows. Other ids are sorted across
    partitions. A label may hold a large share of all rows either way.
    """
    narrow = rows.select(row_id, label)
    kind = narrow.schema[row_id].dataType
    begins = None
    if isinstance(kind, NumericType) and not isinstance(kind, DecimalType):
        found = order_statistics(narrow.select(label, F.col(row_id).alias("value")), [label], lambda n: _edges(n, folds))
        begins = None if found is None else _begins(found, folds)
    if begins is None or not narrow.where(F.col(row_id).isNull()).isEmpty():
        return _sorted_folds(narrow, row_id, label, folds)
    fields = f"_label {narrow.schema[label].dataType.simpleString()}, _begins array<{kind.simpleString()}>"
    table = narrow.sparkSession.createDataFrame(begins, fields)
    passed = F.size(F.filter("_begins", lambda begin: begin <= F.col(row_id)))
    joined = narrow.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(row_id, label, passed.cast("int").alias("fold"))


def _begins(found: dict, folds: int) -> list[tuple] | None:
    """Per label the first id of each fold; None where equal ids lie on both sides of a cut."""
    out = []
    for (name,), own in found.items():
        edges = [e for e in _edges(own.total, folds) if e < own.total]
        if any(own.ranks[e].below < e for e in edges):
            return None
        out.append((name, [own.ranks[e].value for e in edges]))
    return out


def _sorted_folds(narrow: DataFrame, row_id: str, label: str, folds: int) -> DataFrame:
    placed = positions(narrow, [label], [row_id])
    small = F.floor(F.col("total") / folds)
    longer = F.col("total") - small * folds
    edge = longer * (small + 1)
    fold = F.when(
        F.col("position") < edge, F.floor(F.col("position") / (small + 1))
    ).otherwise(longer + F.floor((F.col("position") - edge) / F.greatest(small, F.lit(1))))
    return placed.select(row_id, label, fold.cast("int").alias("fold"))


def with_folds(rows: DataFrame, folds: DataFrame, row_id: str) -> DataFrame:
    """Attach the fold to the full rows, for use as `foldCol`."""
    return rows.join(folds.select(row_id, "fold"), row_id)
