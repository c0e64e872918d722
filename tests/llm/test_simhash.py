"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fathomline.llm import simhash as S
from fathomline.llm.components import components


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d e  f\n\tg", "É é A", "x" * 5000, "w " * 700, "a\x1cb c"])
def test_fingerprint(text):
    assert S.simhash(S.shingle_hashes(text, 3)) == brute_print(text)


@pytest.mark.parametrize("blocks", [3, 4, 16])
@pytest.mark.parametrize("distance", range(6))
def test_variants_meet_exactly_within_radius(distance, blocks):
    rng = random.Random(distance)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        meet = any(np.intersect1d(x[0], x[1]).size for x in S.variants(np.array([a, b], np.uint64), blocks))
        assert meet or distance > (4 if blocks == 3 else 3)


@pytest.mark.parametrize("blocks", [3, 4, 16])
def test_traces_give_fingerprints_back(blocks):
    own = np.random.default_rng(blocks).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for keys, trace in zip(S.variants(own, blocks), S.traces(own, blocks), strict=True):
        assert np.array_equal(S.restored(keys.ravel(), trace.ravel(), blocks), np.repeat(own, keys.shape[1]))


def test_local_roots_of_large_bucket_match_pairwise(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(base ^ rng.integers(0, 1 << 16, 700).astype(np.uint64) ^ (np.uint64(1) << rng.integers(16, 64, 700).astype(np.uint64)))
    for radius in (2, 3, 4):
        monkeypatch.setattr(S, "PAIRWISE", 2048)
        expected = S.local_roots(prints, None, S.Near(radius))
        monkeypatch.setattr(S, "PAIRWISE", 16)
        assert np.array_equal(S.local_roots(prints, None, S.Near(radius)), expected)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "   ", "solo", "solo", "Solo"]
    for _ in range(12):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(3, 400))]
        for _ in range(6):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "changed"
    rows = [(1000 - 7 * i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "solo", "x", "y"), (None, "quite alone here", "x", "y"), (5, "solo", "x", "y"), (5, "solo", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_roots(prints)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    expected = [(r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_large_near_copy_group(spark):
    rng = np.random.default_rng(1)
    prints = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    far = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    every = np.unique(np.concatenate([prints, far]))
    frame = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(S.links(frame)).collect()}
    got = [roots.get(int(x), int(x)) for x in every.view(np.int64)]
    assert same_classes(got, brute_roots([int(x) for x in every]))


def test_components_of_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}
