"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ann as A


def brute(rows, asks, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    if not good:
        return []
    out = []
    for i, v in {r for r in good if asks(r[0])}:
        others = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(others)]
    return out


def run(spark, rows, k, **options):
    frame = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows], "vec_id long, embedding array<double>, score double, copy int")
    return [tuple(r) for r in A.nearest(frame, F.col("vec_id") % 5 == 0, k, **options).collect()]


def test_recall_on_hard_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows, 20), brute(rows, lambda i: i % 5 == 0, 20)
    assert len(got) == len(want)
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    exact = {(a, c): s for a, _, c, s in got}
    assert all(abs(s - float(x[a] @ x[c])) < 1e-9 for (a, c), s in exact.items())


def test_whole_recall_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)]
    odd = [(200, None), (None, [1.0, 2.0, 3.0]), (205, [0.0, 0.0, 0.0]), (210, [float("nan"), 1.0, 1.0]), (215, [None, 1.0, 1.0]), (220, [float("inf"), 1.0, 1.0]), (0, x[0][1]), (5, [1.0, 1.0, 1.0]), (225, []), (-10, [2.0, 2.0, 2.0])]
    rows = x + odd + [(300 + i, [1.0, 0.0, -1.0]) for i in range(60)]
    got = run(spark, rows, 20, recall=1 - 1e-12)
    assert sorted(got) == sorted(brute(rows, lambda i: i % 5 == 0, 20))


def test_few_rows(spark):
    rows = [(5, [1.0, 0.0]), (6, [0.5, 0.5]), (10, [-1.0, 2.0])]
    assert sorted(run(spark, rows, 20)) == sorted(brute(rows, lambda i: i % 5 == 0, 20))
    assert run(spark, [(5, None)], 20) == [] and run(spark, [(5, [1.0])], 20) == []


def test_hot_buckets_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(4) + rng.normal(size=4) * 0.01).tolist()) for i in range(400)]
    assert sorted(run(spark, rows, 20, recall=1 - 1e-12)) == sorted(brute(rows, lambda i: i % 5 == 0, 20))


def test_a_pair_is_scored_once_at_most(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 8)))], "vec_id long, vec array<double>")
    hashing = A.fit(rows, 20, tables=1, width=2.0, recall=0.95, bucket_rows=64)
    index, probes = (A._hashed(rows.select(F.col("vec_id").alias("id"), "vec"), hashing, asks, {}) for asks in (False, True))
    met = index.select("bucket", F.col("id").alias("row")).join(probes.select("bucket", F.col("id").alias("query")), "bucket")
    assert met.count() == met.select("row", "query").distinct().count() <= 500 * 500


def test_many_queries_without_enough_candidates(spark, monkeypatch):
    monkeypatch.setattr(A, "EXACT_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))]
    assert sorted(run(spark, rows, 20, recall=1e-9, bucket_rows=2)) == sorted(brute(rows, lambda i: i % 5 == 0, 20))


@pytest.mark.parametrize("seed", range(3))
def test_probes_fall_and_reach_the_target(seed):
    rng = np.random.default_rng(seed)
    hashing = A.Hashing(16, 1.0, 0.6, n_hashes=3, tables=2, width=2.0, recall=0.95, seed=seed)
    q = rng.normal(size=16)
    n = [len(hashing.probes(q, 0))]
    hashing.target = 0.3
    n.append(len(hashing.probes(q, 0)))
    assert n[1] < n[0] and len(set(hashing.probes(q, 1).tolist())) == len(hashing.probes(q, 1))
