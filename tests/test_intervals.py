import random

from pyspark.sql import functions as F

from cuemill.operators.intervals import merge_intervals, periods_and_gaps

SCHEMA = "seg string, attempt int, id bigint, s bigint, e bigint, part int, n string, entity int"


def run(spark, rows, spans):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)  # columns named as the operator's own
    islands = merge_intervals(df, "seg", "attempt", "s", "e", "id")
    found = periods_and_gaps(islands, spark.createDataFrame(spans, "entity string, duration_ms bigint"))
    return sorted(map(tuple, found.collect()))


def brute(rows, spans):
    out = []
    top, cues = {}, {}
    for seg, a, i, s, e in rows:
        if seg is not None and a is not None:
            top[seg] = max(top.get(seg, a), a)
    for seg, a, i, s, e in set(rows):
        if seg is not None and a == top[seg] and s is not None and e is not None and s < e:
            cues.setdefault(seg, set()).add((s, e, i))
    for seg in {*cues, *(x for x, _ in spans)}:
        prev, islands = 0, []
        for s, e, _ in sorted(cues.get(seg, ())):
            if islands and s <= islands[-1][1]:
                islands[-1][1], islands[-1][2] = max(islands[-1][1], e), islands[-1][2] + 1
            else:
                islands.append([s, e, 1])
        for s, e, n in islands:
            if s - prev >= 2000:
                out.append(("gap", seg, prev, s))
            if n >= 2:
                out.append(("period", seg, s, e))
            prev = e
        d = dict(spans).get(seg)
        if d is not None and (d - prev >= 2000 or not islands and d > 0):
            out.append(("gap", seg, prev, d))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = []
        for i in range(900):
            # one entity holds most rows and spans partitions; some start late, so that its islands do
            seg = "hot" if rng.random() < 0.7 else f"s{rng.randrange(25)}"
            s = rng.randrange(400_000)
            e = s + rng.choice([-5, 0, 100, 1500, 40_000 if trial else 3000])
            rows.append((seg, rng.choice([0, 1, 1]) if seg != "hot" else trial % 2, i, rng.choice([s, s, s, s, None]), e))
        rows += rng.sample(rows, 60)  # delivered again
        spans = [("hot", 500_000), *((f"s{i}", rng.choice([300_000, 450_000])) for i in range(30))]
        assert run(spark, rows, spans) == brute(rows, spans)


def test_higher_version_without_usable_rows(spark):
    rows = [("a", 0, 1, 0, 5000), ("a", 1, 2, None, None), ("b", 0, 3, 10, 20), ("b", 0, 4, 20, 30)]
    assert run(spark, rows, [("a", 9000), ("b", None)]) == [("gap", "a", 0, 9000), ("period", "b", 10, 30)]


def test_carried_version_across_partitions(spark):
    # hundreds of rows of a superseded version behind the end of the highest one
    rows = [("a", 1, i, i * 10, i * 10 + 10) for i in range(300)] + [("a", 0, 1000 + i, i * 9000, i * 9000 + 10) for i in range(300)]
    assert run(spark, rows, [("a", 3500)]) == [("period", "a", 0, 3000)]


def test_empty_and_nulls(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", 100), ("z", 0), ("n", None)]) == [("gap", "a", 0, 100)]
    assert run(spark, [(None, 1, 1, 0, 10), ("a", None, 2, 0, 10)], [("a", 5000)]) == [("gap", "a", 0, 5000)]


def test_one_interval_over_many(spark):
    rows = [("a", 0, 0, 0, 1_000_000)] + [("a", 0, i, i * 100, i * 100 + 1) for i in range(1, 500)]
    assert run(spark, rows, [("a", 1_000_000)]) == [("period", "a", 0, 1_000_000)]
