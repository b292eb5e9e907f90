"""Column expressions over array-valued feature rows.

All of them stay on the JVM side. A matrix row is one `array<float|double>` column rather than a
thousand scalar columns, so plans stay small whatever the width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body` as a variable.

    A plain reference inside a lambda would be inlined and evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def feature_slice(row: Column, label_width: int) -> Column:
    """All but the last `label_width` entries."""
    return F.slice(row, F.lit(1), F.size(row) - F.lit(label_width))


def label_slice(row: Column, label_width: int) -> Column:
    """The last `label_width` entries."""
    return F.slice(row, -label_width, label_width)


def arg_max(values: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties (bigint)."""
    return F.array_position(values, F.array_max(values)) - F.lit(1)


def one_hot_index(index: Column, classes: int) -> Column:
    """`array<bigint>` with a one at `index`; null for a null index, an error for one out of range."""
    row = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == index).cast("bigint"))
    problem = F.concat(F.lit(f"index outside 0..{classes - 1}: "), index.cast("string"))
    return F.when(index.between(0, classes - 1), row).when(index.isNotNull(), F.raise_error(problem).cast("array<bigint>"))


def one_hot_name(name: Column, classes: Sequence[str]) -> Column:
    """`array<bigint>` with a one where the class name matches; null for a null name."""
    row = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: (c == name).cast("bigint"))
    return F.when(name.isNotNull(), row)


def with_one_hot(features: Column, one_hot: Column) -> Column:
    """Features followed by the one-hot label, as one numeric row."""
    return F.concat(features.cast("array<double>"), one_hot.cast("array<double>"))


def column_at(row: Column, index: int) -> Column:
    """One matrix column by zero-based index."""
    return F.element_at(row, index + 1)


def pick_columns(row: Column, indices: Sequence[int]) -> Column:
    """Several matrix columns by zero-based index, as an array in the order given."""
    return F.array(*[column_at(row, i) for i in indices])


def softmax(row: Column) -> Column:
    """Row-wise class probabilities of a score row; the largest score is subtracted, so none overflows."""
    powers = lambda top: F.transform(row, lambda v: F.exp(v.cast("double") - top))
    return _let(
        _let(F.array_max(row).cast("double"), powers),
        lambda e: _let(
            F.aggregate(e, F.lit(0.0), lambda total, v: total + v),
            lambda total: F.transform(e, lambda v: v / total),
        ),
    )


def features_of(row: Column) -> Column:
    """Array to ML vector."""
    return array_to_vector(row)
