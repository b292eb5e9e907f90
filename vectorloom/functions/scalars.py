"""Scalar column expressions: paths, splits, units, timestamps and report texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    """Second-to-last part of a path; null for a path with a single part."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def split_of(row_id: Column) -> Column:
    """Deterministic 70/20/10 split by id: `train`, `test`, `validation`."""
    bucket = F.pmod(row_id, F.lit(10))
    named = F.when(bucket <= 6, "train").when(bucket <= 8, "test").when(bucket == 9, "validation")
    return F.coalesce(named, F.raise_error(F.lit("a row without an id belongs to no split")).cast("string"))


def fold_of(row_id: Column, folds: int = 3) -> Column:
    """Deterministic fold number in `0 .. folds-1`."""
    return F.pmod(row_id, F.lit(folds)).cast("int")


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def iso_shifted(instant: Column, offset_hours: int = -5) -> Column:
    """ISO text of an instant moved by whole hours; the text carries the offset it was moved by.

    The session's time zone does not matter. A timestamp without a zone is taken as UTC.
    """
    plain = instant.cast("timestamp_ntz")
    at_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), plain)
    at_utc = F.when(F.typeof(instant) == "timestamp_ntz", plain).otherwise(at_utc)
    text = (at_utc + F.make_dt_interval(hours=F.lit(offset_hours))).cast("string")
    seconds = F.translate(F.substring(text, 1, 19), " ", "T")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(seconds, F.lit("."), fraction, F.lit(f"{offset_hours:+03d}:00"))


def percent_text(share: Column) -> Column:
    """A share as percent with two decimals, for example `73.97%`."""
    return F.format_string("%.2f%%", share * F.lit(100.0))


def run_mode(kind: Column, labels: Mapping[str, str], default: str) -> Column:
    """The label a run is logged under, by kind of run."""
    mode = F.lit(default)
    for key, label in labels.items():
        mode = F.when(kind == key, label).otherwise(mode)
    return mode


def run_slots(kind: Column, cluster_kind: str, slots: int) -> Column:
    """Worker slots of a run; zero off the cluster."""
    return F.when(kind == cluster_kind, F.lit(slots)).otherwise(F.lit(0))
