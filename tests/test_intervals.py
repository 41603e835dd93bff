import collections
import random

from scriptorium.operators.intervals import periods_and_gaps

SCHEMA = "e string, f string, a int, b int, kind string"


def brute(rows):
    lines = collections.defaultdict(set)
    for e, f, a, b, _ in rows:
        if a is not None:
            b = a if b is None else b
            lines[e, f].update(range(min(a, b), max(a, b) + 1))
    out = []
    for k, v in lines.items():
        v = sorted(v)
        cuts = [i for i in range(1, len(v)) if v[i] != v[i - 1] + 1]
        runs = [v[i:j] for i, j in zip([0, *cuts], [*cuts, len(v)])]
        out += [(*k, "period", r[0], r[-1]) for r in runs]
        out += [(*k, "gap", r[-1] + 1, s[0] - 1) for r, s in zip(runs, runs[1:])]
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, periods_and_gaps(df, ["e", "f"], "a", "b").collect()), key=repr)


def test_random_intervals(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", "y", None]), r.choice(["1", None]), r.choice([None, *range(-70, 300)]), r.choice([None, *range(-70, 300)]), "extra") for _ in range(120)]
    rows += rows[:10]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [("a", "1", 0, 63, ""), ("a", "1", 64, 64, ""), ("b", "1", 500, 1, ""), ("b", "1", 502, None, ""), ("c", "1", None, 9, "")]
    assert run(spark, rows) == sorted([("a", "1", "period", 0, 64), ("b", "1", "period", 1, 500), ("b", "1", "gap", 501, 501), ("b", "1", "period", 502, 502)], key=repr)


def test_long_interval_stays_small(spark):
    assert run(spark, [("a", "1", -(2**31), 2**31 - 1, ""), ("a", "1", 5, 6, "")]) == [("a", "1", "period", -(2**31), 2**31 - 1)]


def test_empty(spark):
    assert run(spark, []) == []
