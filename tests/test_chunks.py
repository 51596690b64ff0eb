"""What looks over whole series, cut into chunks of time or of values, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridlens.operators import evaluation, learning, medians, windows


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def events(seed, n, span, series=3):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(series)}", round(rng.uniform(0, span), 1)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [7.0, 1000.0])
def test_segments_by_chunks(spark, chunk):
    rows = [(*e, i) for i, e in enumerate(events(1, 200, 100))] + [("alone", 5.0, 900)]
    marks = [*events(2, 30, 100), ("s0", 0.0), ("nowhere", 3.0)]
    out = windows.segments(spark.createDataFrame(rows, "series_id string, t_sec double, idx long"), spark.createDataFrame(marks, "series_id string, t_sec double"), chunk_s=chunk)
    assert key((r["series_id"], r["idx"], r["segment_no"]) for r in out.collect()) == key((s, i, sum(m == s and u < t for m, u in marks)) for s, t, i in rows)


@pytest.mark.parametrize("chunk", [5.0, 1000.0])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_by_chunks(spark, chunk, forward):
    left = [(*e, i) for i, e in enumerate(events(3, 150, 90))]
    right = {(s, t): f"v{i}" if i % 5 else None for i, (s, t) in enumerate(events(4, 25, 90))}
    out = evaluation._asof(spark.createDataFrame(left, "series_id string, t double, idx long"), spark.createDataFrame([(s, t, v) for (s, t), v in right.items()], "series_id string, t double, v string"), "v", forward, chunk)
    want = []
    for s, t, i in left:
        near = [(u, v) for (o, u), v in right.items() if o == s and v is not None and (u >= t if forward else u <= t)]
        want.append((i, (min if forward else max)(near)[1] if near else None))
    assert key((r["idx"], r["v"]) for r in out.collect()) == key(want)


def test_settled_windows_by_chunks(spark):
    rng = random.Random(5)
    rows = [("a", i, i / 2, 100 + rng.gauss(0, 0.5 if i % 90 < 40 else 30), rng.gauss(0, 0.2)) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, idx long, t_sec double, p double, q double")
    whole, cut = (key((r["idx"], round(r["p_std"], 9), r["settled"]) for r in windows.settled_windows(df, 3, chunk_s=c).collect()) for c in (1e9, 1.0))
    assert whole == cut and len(cut) == 400 and {x[2] for x in cut} == {True, False}


def test_a_deviation_right_at_the_limit(spark):
    rows = [("a", 0, 0.0, 4.7, 17.0), ("a", 1, 4.0, 1.7, -11.0), ("b", 0, 0.0, 1.0, 9.0), ("b", 1, 1.0, 4.0, -3.0)]
    out = windows.settled_windows(spark.createDataFrame(rows, "series_id string, idx long, t_sec double, p double, q double"), 5, share=0.0)
    # 4.7 - 1.7 is more than 3 as doubles, 4 - 1 is 3
    assert {(r["series_id"], r["idx"]): r["settled"] for r in out.collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): True, ("b", 1): True}


def test_medians_of_long_groups_are_exact(spark):
    rng = random.Random(6)
    kinds = {
        "even": [rng.gauss(0, 1) for _ in range(500)],
        "odd": [rng.uniform(-1e6, 1e6) for _ in range(501)],
        "ties": [float(rng.randrange(3)) for _ in range(400)],
        "same": [7.25] * 300,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)] + [1.7e308, -1.7e308],
        "tiny": [5e-324 * rng.randrange(9) for _ in range(301)],
        "gaps": [rng.gauss(0, 1) if rng.random() < 0.5 else None for _ in range(400)],
        "none": [None] * 300,
        "short": [3.0, 1.0, 2.0, 10.0],
    }
    rows = [(k, v) for k, vs in kinds.items() for v in vs]
    df = spark.createDataFrame(rows, "series_id string, x double").withColumn("y", -F.col("x")).repartition(5)
    out = {r["series_id"]: r for r in medians.medians(df, {"m": "x", "other": "y"}, more=(F.count("x").alias("known"),), long_rows=100).collect()}
    assert set(out) == set(kinds)
    for k, vs in kinds.items():
        known = [v for v in vs if v is not None]
        want = statistics.median(known) if known else None
        assert out[k]["known"] == len(known) and out[k]["m"] == want and out[k]["other"] == (None if want is None else -want), k


def greedy(detected, truth, tol):
    out = []
    for s in {r[0] for r in detected}:
        free = sorted((r for r in truth if r[0] == s and r[2] is not None), key=lambda r: r[1])
        for _, no, t, dp in sorted((r for r in detected if r[0] == s), key=lambda r: r[1]):
            near = [(abs(u[2] - t), u[1], u) for u in free if (u[3] > 0) - (u[3] < 0) == (dp > 0) - (dp < 0) and abs(u[2] - t) <= tol] if t is not None else []
            if near:
                best = min(near)[2]
                free.remove(best)
                out.append((s, no, best[1]))
    return key(out)


@pytest.mark.parametrize("chunk", [3.0, 40.0, 1e6])
def test_matching_by_parts(spark, chunk):
    rng = random.Random(7)
    side = lambda seed, n: [(s, i, t, rng.choice([-5.0, 5.0, 3.0])) for i, (s, t) in enumerate(sorted(events(seed, n, 300)))] + [("s0", 999, None, 1.0)]
    d, t = side(8, 120), side(9, 100)
    rng.shuffle(d)
    schema = "series_id string, no int, t_sec double, delta_p double"
    out = evaluation.match_to_truth(spark.createDataFrame(d, schema), spark.createDataFrame(t, schema), 2.0, chunk)
    assert key((r["series_id"], r["detected_no"], r["truth_no"]) for r in out.collect()) == greedy(d, t, 2.0)


def test_a_classifier_tells_its_shares(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rng = random.Random(10)
    rows = [(i, "abc"[i % 3], [i % 3 + rng.gauss(0, 0.4), rng.random()]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    model = learning.fitted(df, RandomForestClassifier(numTrees=9, seed=1))
    out = model.predict(df.withColumn("confidence", F.lit("clash")), with_shares=True).collect()
    assert model.labels == ["a", "b", "c"] and len(out) == 150
    for r in out:
        assert sum(r["shares"]) == pytest.approx(1) and r["confidence"] == max(r["shares"])
        assert r["predicted"] == model.labels[r["shares"].index(max(r["shares"]))]  # of equal ones the first
    assert sum(r["predicted"] == r["label"] for r in out) > 120
