"""Consistent weighted sampling: collision rate, sharing of draws, edits against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import weighted_minhash as M


def weighted(counts):
    h = np.array(sorted(counts), np.uint64)
    return h, np.array([counts[int(x)] for x in h], np.int64)


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


@pytest.mark.parametrize("shared,own,top", [(40, 10, 1), (20, 40, 5), (5, 100, 9), (60, 3, 30)])
def test_collision_rate_is_generalised_jaccard(shared, own, top):
    rng = random.Random(shared)
    rate, truth = [], []
    for _ in range(60):
        keys = [rng.getrandbits(64) for _ in range(shared)]
        a = {k: rng.randint(1, top) for k in keys} | {rng.getrandbits(64): rng.randint(1, top) for _ in range(own)}
        b = {k: rng.randint(1, top) for k in keys} | {rng.getrandbits(64): rng.randint(1, top) for _ in range(own)}
        x, y = (M.signatures([weighted(d)])[0] for d in (a, b))
        rate.append(M.likeness(x, y))
        truth.append(jaccard(a, b))
    assert abs(np.mean(rate) - np.mean(truth)) < 0.025


def test_sharing_draws_changes_nothing():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 4, 5, 30, 3000)]
    alone = [M.signature(t) for t in texts]
    together = M.signatures([M.terms(t) for t in texts])
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert np.array_equal(alone[4], M.signature(texts[4].upper().replace(" ", "\n")))


def test_terms_are_counted_shingles():
    h, n = M.terms("a b c d e a b c d e a")
    assert sorted(n) == [1, 1, 1, 2, 2] and len(h) == 5
    assert len(M.terms("a b")[0]) == 1 and len(M.terms(" \n")[0]) == 0
    assert M.terms("a b")[0][0] != M.terms("b a")[0][0]


@pytest.mark.parametrize("shards", [1, 4, 50])
def test_edits_match_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = [(i * 7 - 50, " ".join(rng.choice(["é", "b", "cc", "d"]) for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(11, None), (12, ""), (None, "null id text of some words"), (13, "same text twice " * 9), (13, "same text twice " * 9), (14, "x" * 50_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "a", True) for r in rows], "doc_id long, text string, place string, lead boolean")
    got = sorted((tuple(r) for r in M.fingerprint_edits(docs, shards=shards).collect()), key=str)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    expected = []
    for k, (doc, text) in enumerate(order):
        following = order[k - 1][1]
        n = len(text) // 3
        new = text[: len(text) - n] + following[:n]
        a, b, c = M.signature(text), M.signature(new), M.signature(following)
        blank = [not x.split() for x in (text, new, following)]
        expected.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), M.likeness(a, b, blank[0], blank[1]), M.likeness(a, c, blank[0], blank[2])))
    assert got == sorted(expected, key=str)
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "only one document here at all")], "doc_id long, text string")
    assert M.fingerprint_edits(docs.limit(0)).count() == 0
    row = M.fingerprint_edits(docs).first()
    assert row["near_next"] == 1.0
    assert M.fingerprint_documents(docs).first()["fingerprint"] == row["fingerprint"]
