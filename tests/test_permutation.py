"""Orders by a keyed permutation."""

from pyspark.sql import functions as F

from vectorloom.operators.permutation import LOW, MULTIPLIER, permuted, round_keys, shuffle


def by_hand(value, seed, epoch):
    left, right = value >> 32 & LOW, value & LOW
    for key in round_keys(seed, epoch):
        mixed = right * MULTIPLIER + key & LOW
        left, right = right, left ^ mixed ^ mixed >> 15
    key = left << 32 | right
    return key - (1 << 64) if key >> 63 else key


def test_keys_by_hand_and_one_to_one(spark):
    odd = spark.createDataFrame([(v,) for v in (0, -1, 2**63 - 1, -(2**63), 1 << 32)], "id long")
    found = spark.range(5000).union(odd).select("id", permuted(F.col("id"), 7, 3).alias("key")).collect()
    assert all(r["key"] == by_hand(r["id"], 7, 3) for r in found)
    assert len({r["key"] for r in found}) == len({r["id"] for r in found})
    # Keys fall evenly: each sixteenth of them holds about as many ids.
    held = [sum(r["key"] >> 60 == k for r in found) for k in range(-8, 8)]
    assert min(held) > 240 and max(held) < 390


def test_order_is_fixed_by_seed_and_epoch(spark):
    rows = spark.range(1000).withColumn("_key", F.lit(1))
    take = lambda seed, epoch, parts: [r["id"] for r in shuffle(rows.repartition(parts), "id", seed, epoch, 4).collect()]
    one = take(1, 0, 2)
    assert one == take(1, 0, 5) and sorted(one) == list(range(1000))
    assert one != take(1, 1, 2) and one != take(2, 0, 2) and one != sorted(one)
    plan = shuffle(rows, "id", 1)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


def test_null_text_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 3), ("", None)], "name string, v int")
    assert sorted(map(str, shuffle(rows, "name", 3).collect())) == sorted(map(str, rows.collect()))
    assert shuffle(rows.limit(0), "name", 3).count() == 0
