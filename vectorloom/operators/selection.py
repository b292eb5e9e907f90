"""Exact order statistics without a sort.

Values are counted in cells that keep their order; only the cells that hold a wanted rank are looked into again, in finer
cells, until one value is left. The first cells are the binary exponents of the values, later ones cut a cell evenly. A double has 52
bits below its exponent, so few rounds suffice whatever the distribution, and a value with a large share of
all rows simply ends as a cell of its own. Each round is one scan with partial aggregation. Nothing is written, and what
is shuffled or brought to the driver is bounded by the number of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 1_000_000  # per round, on the driver
FINE = 4096  # cells into which one is cut at most
LAST_ROWS = 100_000  # open cells with so few rows are counted by value


@dataclass
class Rank:
    """A value in sorted order: rows below it and rows equal to it."""

    value: float
    below: int
    equal: int


@dataclass
class Group:
    total: int
    ranks: dict[int, Rank] = field(default_factory=dict)


@dataclass
class _Cell:
    group: tuple
    lo: float
    hi: float
    n: int
    before: int
    ranks: list[int]

    @property
    def single(self) -> bool:
        return self.lo == self.hi or self.lo != self.lo  # NaN has cells of its own


def exponent(value: Column) -> Column:
    """A whole number that does not fall as the value rises: zero, or the sign of the value times its shifted exponent."""
    number = value.cast("double")
    size = F.abs(number)
    power = F.when(F.isnan(number), 9000).when(size == float("inf"), 8000)
    power = power.when(size > 0, F.floor(F.log2(size)).cast("int") + 2000).otherwise(0)
    return F.when(number < 0, -power).otherwise(power)


def _counted(values: DataFrame, keys: Sequence[str | Column]) -> list:
    counts = F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    return values.groupBy(*keys).agg(*counts).limit(MAX_CELLS + 1).collect()


def _holding(group: tuple, cells: list, before: int, ranks: list[int]) -> list[_Cell]:
    """Of cells in order, those that hold a rank."""
    found = []
    for cell in cells:
        inside = [r for r in ranks if before <= r < before + cell["n"]]
        if inside:
            found.append(_Cell(group, cell["lo"], cell["hi"], cell["n"], before, inside))
        before += cell["n"]
    return found


def order_statistics(
    values: DataFrame, group: Sequence[str], ranks_of: Callable[[int], Sequence[int]]
) -> dict[tuple, Group] | None:
    """Per group the values at the zero-based ranks that `ranks_of` names for its size.

    `values` has the columns of `group` and a numeric `value`; rows without a value are left out. None if there are too many groups for
    the driver.
    """
    group = list(group)
    values = values.select(*group, "value").where(F.col("value").isNotNull())
    rows = _counted(values, [*group, exponent(F.col("value")).alias("_cell")])
    if len(rows) > MAX_CELLS:
        return None
    key = lambda row: tuple(row[c] for c in group)
    order = lambda row: [(v is not None, v if v is not None else 0) for v in key(row)]
    out: dict[tuple, Group] = {}
    cells: list[_Cell] = []
    for _, own in groupby(sorted(rows, key=lambda r: (order(r), r["_cell"])), key=order):
        own = list(own)
        name = key(own[0])
        out[name] = Group(sum(r["n"] for r in own))
        cells += _holding(name, own, 0, sorted({r for r in ranks_of(out[name].total) if 0 <= r < out[name].total}))
    while cells:
        for cell in filter(lambda c: c.single, cells):
            out[cell.group].ranks.update({r: Rank(cell.lo, cell.before, cell.n) for r in cell.ranks})
        cells = [c for c in cells if not c.single]
        if len(cells) * 16 > MAX_CELLS:
            return None
        if cells:
            cells = _finer(values, group, cells)
    return out


def _finer(values: DataFrame, group: list[str], cells: list[_Cell]) -> list[_Cell]:
    """One round: the parts of `cells` that hold their ranks."""
    kind = values.schema["value"].dataType.simpleString()
    fields = [f"_g{i} {values.schema[c].dataType.simpleString()}" for i, c in enumerate(group)]
    table = [(*c.group, k, c.lo, c.hi) for k, c in enumerate(cells)]
    wanted = values.sparkSession.createDataFrame(table, ", ".join([*fields, "_number int", f"_lo {kind}", f"_hi {kind}"]))
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.lit(True))
    inside = values.join(F.broadcast(wanted), match & F.col("value").between(F.col("_lo"), F.col("_hi")))
    if sum(c.n for c in cells) <= LAST_ROWS:
        part = F.col("value")
    else:
        # All values of a cell have one sign, so differences do not overflow.
        fine = max(16, min(FINE, MAX_CELLS // len(cells)))
        share = (F.col("value") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
        part = F.least(F.floor(share * fine), F.lit(fine - 1))
    rows = sorted(_counted(inside, ["_number", part.alias("_cell")]), key=lambda r: (r["_number"], r["_cell"]))
    found = []
    for number, own in groupby(rows, key=lambda r: r["_number"]):
        cell = cells[number]
        found += _holding(cell.group, list(own), cell.before, cell.ranks)
    return found
