import bisect
import random

from pyspark.sql import functions as F

from dwellspark.operators.history import as_of, validity

COLUMNS = "k bigint, t bigint, v int"


def made(seed):
    rng = random.Random(seed)
    rows = {(1, rng.randrange(10**6)): rng.randrange(3) for _ in range(3000)}
    rows |= {(rng.randrange(2, 40), rng.randrange(1000)): rng.choice([None, 1, 2]) for _ in range(300)}
    return [(k, t, v) for (k, t), v in rows.items()]


def test_validity_equals_a_walk_also_of_a_hot_key(spark):
    rows = made(1)
    found = validity(spark.createDataFrame(rows + [(None, 1, 1), (1, None, 1)], COLUMNS).repartition(4), "k", "t", "v")
    expected = []
    for key in {k for k, _, _ in rows}:
        own = sorted((t, v) for k, t, v in rows if k == key)
        opened = [(t, v) for at, (t, v) in enumerate(own) if at == 0 or own[at - 1][1] != v]
        ends = [t for t, _ in opened[1:]] + [None]
        expected += [(key, v, t, end) for (t, v), end in zip(opened, ends)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert validity(spark.createDataFrame([], COLUMNS), "k", "t", "v").count() == 0


def test_as_of_takes_the_latest_not_after(spark):
    rows, rng = made(2), random.Random(3)
    probes = [(n, rng.choice([1, 1, rng.randrange(45), None]), rng.choice([rng.randrange(10**6), rng.randrange(1000), rows[n][1], None])) for n in range(800)]
    found = as_of(spark.createDataFrame(probes, "n bigint, k bigint, t bigint").repartition(3), spark.createDataFrame(rows, COLUMNS).withColumn("at", F.col("t")), "k", "t", ["at", "v"])
    times = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        times.setdefault(k, []).append((t, v))
    expected = []
    for n, k, t in probes:
        own = times.get(k, []) if t is not None else []
        place = bisect.bisect_right([x for x, _ in own], t) if own else 0
        expected.append((k, t, n, *(own[place - 1] if place else (None, None))))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert "Join" in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
