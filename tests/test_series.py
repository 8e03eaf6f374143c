"""Ordered and time-series operators against brute force, also with one very hot key."""

import random

from pyspark.sql import functions as F

from sluiceway.operators import lockout, metrics, ordering

SECOND = 1_000_000


def hot_samples(n=600, seed=5):
    """Most rows belong to one key."""
    rng = random.Random(seed)
    times = rng.sample(range(1, 5000), n)
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), t * SECOND, rng.randint(0, 50)) for t in times]


def test_number_rows(spark):
    rows = hot_samples()
    got = ordering.number_rows(spark.createDataFrame(rows, "k string, at long, v int").repartition(5), "k", ["at"])
    expected = {}
    for key in {r[0] for r in rows}:
        for position, row in enumerate(sorted(r for r in rows if r[0] == key)):
            expected[row] = position
    assert {(r.k, r.at, r.v): r.seq for r in got.collect()} == expected


def test_running_sum(spark):
    rows = hot_samples()
    got = ordering.running_sum(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", "v", "s", 100 * SECOND)
    expected = {(k, t): sum(v2 for k2, t2, v2 in rows if k2 == k and t2 <= t) for k, t, _ in rows}
    assert {(r.k, r.at): r.s for r in got.collect()} == expected


def brute_failures(attempts, span, clear):
    out = {}
    for key, at, failed in attempts:
        if failed:
            cleared = max([t for k, t, f in attempts if k == key and not f and t <= at], default=-1) if clear else -1
            out[key, at] = sum(1 for k, t, f in attempts if k == key and f and max(cleared, at - span) < t <= at)
    return out


def test_lockouts(spark):
    attempts = [(k, t, v % 5 != 0) for k, t, v in hot_samples()]
    frame = spark.createDataFrame(attempts, "k string, ts_us long, failed boolean")
    for clear in (True, False):
        got = {(r.k, r.ts_us): (r.failures, r.locked) for r in lockout.failure_counts(frame, "k", 5, 60, clear).collect()}
        assert got == {key: (n, n >= 5) for key, n in brute_failures(attempts, 60 * SECOND, clear).items()}


def test_counter_rates_with_resets(spark):
    rows = hot_samples()
    frame = spark.createDataFrame(rows, "series string, ts_us long, value long")
    got = {(r.series, r.ts_us): r.rate for r in metrics.counter_rates(frame, 120).collect()}
    expected = {}
    for key, at, _ in rows:
        inside = sorted((t, v) for k, t, v in rows if k == key and at - 120 * SECOND < t <= at)
        if len(inside) > 1:
            grown = sum(v if v < before else v - before for (_, before), (_, v) in zip(inside, inside[1:]))
            expected[key, at] = grown * 1_000_000 / (inside[-1][0] - inside[0][0])
    assert got == expected


def test_grid(spark):
    rows = hot_samples(60)
    frame = spark.createDataFrame(rows, "series string, ts_us long, value int")
    end = 4000 * SECOND
    got = {(r.series, r.ts_us): r.value for r in metrics.on_grid(frame, end, minutes=10, step=30).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        for point in range(end - 600 * SECOND, end + 1, 30 * SECOND):
            before = [(t, v) for k, t, v in rows if k == key and t <= point]
            if before:
                expected[key, point] = max(before)[1]
    assert got == expected


def test_bands_scaling_ratio(spark):
    values = spark.createDataFrame([(v,) for v in (-5.0, 70.0, 70.1, 90.0, 90.1, 400.0)], "p double")
    percent, colour = metrics.band(F.col("p"))
    assert [tuple(r) for r in values.select(percent, colour).collect()] == [
        (0.0, metrics.GREEN), (70.0, metrics.GREEN), (70.1, metrics.AMBER), (90.0, metrics.AMBER), (90.1, metrics.RED), (100.0, metrics.RED)
    ]
    samples = spark.createDataFrame([("a", 1, -1.0), ("a", 2, 4.0), ("b", 1, 0.0)], "series string, ts_us long, value double")
    assert sorted((r.series, r.ts_us, r.scaled) for r in metrics.scaled(samples).collect()) == [("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 0.0)]
    assert sorted(r.scaled for r in metrics.scaled(samples, top=2).collect()) == [0.0, 0.0, 1.0]
    pairs = spark.createDataFrame([("a", "u", 1, 3.0), ("a", "f", 1, 1.0), ("b", "u", 1, 0.0), ("b", "f", 1, 0.0), ("c", "u", 1, 1.0)], "series string, metric string, ts_us long, value double")
    assert sorted((r.series, r.percent) for r in metrics.ratio(pairs, "u", "f").collect()) == [("a", 75.0), ("b", 0.0)]


def burst(n=4000, seed=11):
    """90 % of the rows are one key's, all inside one window."""
    rng = random.Random(seed)
    hot = [("hot", 10_000 * SECOND + t * 10_000, rng.randint(0, 9)) for t in rng.sample(range(5000), n * 9 // 10)]
    return hot + [(f"k{i % 37}", rng.randrange(20_000) * SECOND, rng.randint(0, 9)) for i in range(n // 10)]


def test_one_key_in_one_window_spreads(spark):
    frame = spark.createDataFrame(burst(), "k string, at long, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one partition
    try:
        sliced = ordering.slices(frame, "k", "at")
        plan = ordering.running(sliced, "k", "at", F.col("v"), "s")._jdf.queryExecution().executedPlan().toString()
        tasks = [len(part) for part in sliced.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4 and sum(tasks) == 4000 and max(tasks) < 2 * sum(tasks) / 4
    # The window runs on the slices where they lie: only their totals are hashed by key.
    assert "hashpartitioning(_part" not in plan and plan.count("hashpartitioning(k") == 1


def test_running_extremes_and_previous(spark):
    rows = [(None if k == "a" else k, t, None if v % 4 == 0 else v) for k, t, v in hot_samples()]
    sliced = ordering.slices(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at")
    for how, pick in (("sum", sum), ("min", min), ("max", max)):
        got = {(r.k, r.at): r.s for r in ordering.running(sliced, "k", "at", F.col("v"), "s", how).collect()}
        inside = {(k, t): [v2 for k2, t2, v2 in rows if k2 == k and t2 <= t and v2 is not None] for k, t, _ in rows}
        assert got == {key: pick(values) if values else None for key, values in inside.items()}
    got = {(r.k, r.at): r.p for r in ordering.previous(sliced, "k", "at", "v", "p").collect()}
    before = {(k, t): max(((t2, v2) for k2, t2, v2 in rows if k2 == k and t2 < t), default=(0, None), key=lambda x: x[0])[1] for k, t, _ in rows}
    assert got == before


def test_burst_rates_and_lockouts(spark):
    rows = burst(600)
    attempts = [(k, t, v % 5 != 0) for k, t, v in rows]
    frame = spark.createDataFrame(attempts, "k string, ts_us long, failed boolean")
    got = {(r.k, r.ts_us): r.failures for r in lockout.failure_counts(frame, "k", 5, 20).collect()}
    assert got == brute_failures(attempts, 20 * SECOND, True)
    samples = [(k, t - t % (SECOND // 2), v) for k, t, v in rows]  # several samples at one instant
    got = sorted((r.series, r.ts_us, r.rate) for r in metrics.counter_rates(spark.createDataFrame(samples, "series string, ts_us long, value long"), 20).collect())
    expected = []
    for key, at, _ in samples:
        inside = sorted((t, v) for k, t, v in samples if k == key and at - 20 * SECOND < t <= at)
        if inside[-1][0] > inside[0][0]:
            grown = sum(v if v < before else v - before for (_, before), (_, v) in zip(inside, inside[1:]))
            expected.append((key, at, grown * 1_000_000 / (inside[-1][0] - inside[0][0])))
    assert got == sorted(expected)


def test_nothing_to_order(spark):
    assert metrics.counter_rates(spark.createDataFrame([], "series string, ts_us long, value long"), 20).count() == 0
    assert lockout.failure_counts(spark.createDataFrame([], "k string, ts_us long, failed boolean"), "k", 5, 20).count() == 0
