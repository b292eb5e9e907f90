"""Reproducible shuffling by a keyed permutation of ids.

A Feistel network maps 64-bit ids one to one onto 64-bit keys, so different ids never tie and no random
number hangs on where a row lies. Rows go to partitions by key and are sorted there: no range bounds are
sampled, each epoch has an order of its own, and a repeated task gives the same one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
MULTIPLIER = 1_597_334_677
LOW = 0xFFFFFFFF


def round_keys(seed: int, epoch: int = 0, rounds: int = ROUNDS) -> list[int]:
    """One 32-bit key per round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{r}".encode()).digest()[:4], "big") for r in range(rounds)]


def permuted(ids: Column, seed: int, epoch: int = 0) -> Column:
    """The key of a 64-bit id; a null id has the key of 0."""
    whole = F.coalesce(ids.cast("long"), F.lit(0).cast("long"))
    left, right = F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit(LOW))
    halves = F.struct(left.alias("left"), right.alias("right"))

    def step(pair: Column, key: Column) -> Column:
        mixed = (pair["right"] * MULTIPLIER + key).bitwiseAND(F.lit(LOW))
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 15))
        return F.struct(pair["right"].alias("left"), pair["left"].bitwiseXOR(mixed).alias("right"))

    keys = F.array(*[F.lit(key).cast("long") for key in round_keys(seed, epoch)])
    end = F.aggregate(keys, halves, step)
    return F.shiftleft(end["left"], 32).bitwiseOR(end["right"])


def shuffle(rows: DataFrame, id_column: str, seed: int, epoch: int = 0, partitions: int | None = None) -> DataFrame:
    """The same rows in the order of `seed` and `epoch`; with equal `partitions` the same one every time.

    Rows of equal id lie together; a number id is taken as it is, any other by its 64-bit hash. Rows without an id,
    which may be many, are spread by their content.
    """
    numbers = ("tinyint", "smallint", "int", "bigint")
    kind = dict(rows.dtypes)[id_column]
    own = F.col(id_column) if kind in numbers else F.xxhash64(id_column)
    content = F.xxhash64(*[F.to_json(F.struct(*rows.columns))])
    key = permuted(F.when(F.col(id_column).isNull(), content).otherwise(own), seed, epoch)
    name = "_key"
    while name in {c.lower() for c in rows.columns}:
        name = "_" + name
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn(name, key).repartition(count, name).sortWithinPartitions(name).drop(name)
