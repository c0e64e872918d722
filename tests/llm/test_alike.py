"""The pipeline's near copies against brute force over five-word shingle sets."""

import random

import pytest

import corpus_pipeline as C
from fathomline.llm import alike as A

SCHEMA = "doc_id long, text string, root string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def test_stage_keeps_what_only_fingerprints_call_alike(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        chunks = [words(rng, 10) for _ in range(30)]
        for i in range(3):
            rows.append((10 * g + i, " ".join(w for c in chunks for w in c), "x"))
            rng.shuffle(chunks)
    rows += [(500, "?!", "x"), (501, "...", "x"), (502, "", "x")]
    assert brute_kept(rows) == {r[0] for r in rows}
    got = C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}


def running_text(rng, n):
    """Words with the frequencies of running text: a few make up most of it."""
    vocabulary = words(rng, 400)
    return rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=n)


def test_stage_finds_near_copies_in_running_text(spark):
    rng = random.Random(2)
    rows = []
    for g in range(100):
        own = running_text(rng, 250)
        rows.append((10 * g, " ".join(own), "x"))
        for at in rng.sample(range(250), 4):
            own[at] = words(rng, 1)[0]
        rows.append((10 * g + 1, " ".join(own) + "!", "x"))
    pairs = len(rows) - len(brute_kept(rows))
    got = C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert pairs > 60 and len(rows) - got.count() >= 0.97 * pairs


def test_what_the_fingerprints_can_not_gather(spark):
    """Of texts without a repeated word, a twelfth of them exchanged at one place, most pairs at 0.8 lie beyond the balls."""
    rng = random.Random(2)
    rows = []
    for g in range(40):
        own = words(rng, 150)
        rows.append((10 * g, " ".join(own), "x"))
        own[60:72] = words(rng, 12)
        rows.append((10 * g + 1, " ".join(own), "x"))
    assert len(brute_kept(rows)) == 40
    got = C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {10 * g for g in range(40)} <= {r["doc_id"] for r in got} and len(got) < 80


@pytest.mark.parametrize("group_shingles", [None, 700])
def test_matches_brute_force(spark, group_shingles):
    rng = random.Random(3)
    rows = [(0, "", "e"), (1, None, "e"), (2, " \n", "e"), (3, "One two", "e"), (4, "one  TWO", "e"), (5, "one two three", "e")]
    for g in range(8):
        own = running_text(rng, 300)
        for i in range(12):
            rows.append((100 * g + 10 + i, " ".join(own), "x"))
            for _ in range(rng.choice([0, 1, 1, 2, 24])):
                own[rng.randrange(len(own))] = f"other{rng.randrange(1000)}"
    kept = brute_kept(rows)
    assert 20 < len(kept) < 90
    docs = spark.createDataFrame([*rows, (10, rows[6][1], "x"), (None, "no id", "e"), (None, "no id", "e")], SCHEMA)
    got = A.one_of_each(docs, group_shingles=group_shingles).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(kept)
    assert len(got) == len(kept) + 2 and got[0].asDict().keys() == {"doc_id", "text", "root"}


NAMES = ["dropped id", "fathomline row", "row", "copy", "goes", "n", "fathomline pii hits", "pii hits", "a.b", "it`s"]


def test_names_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    long = " ".join(f"w{i % 5003}" for i in range(60_000)) + " "
    rows = [(1, "some text here", "b"), (1, "some text here", "a"), (1, "another text entirely, of the same id", "x"), (2, "Some  text here", "x"), (3, long, "x"), (4, long + "end", "x"), (5, None, None), (6, "", "x"), (None, "some text here", "x")]
    docs = spark.createDataFrame([(i, t, *[v] * len(NAMES)) for i, t, v in rows], schema)
    got = A.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n"] or "") for r in got.collect()) == sorted([(1, "some text here", "a"), (1, "another text entirely, of the same id", "x"), (3, long, "x"), (5, "", ""), (0, "some text here", "x")])
    assert A.one_of_each(docs.limit(0)).count() == 0
