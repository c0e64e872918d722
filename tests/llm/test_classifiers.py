"""Quality and mixture: held-out accuracy, targets met, odd inputs."""

import math
import random

import numpy as np
import pytest

from fathomline.llm import mixing as X
from fathomline.llm import quality as Q
from fathomline.llm.features import meta_features, text_features

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed):
    """Plain sentences, sentences with insults, and junk of two kinds; some without labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "er", "on", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        kind = rng.choices(["clean", "toxic", "mark", "repeat"], [75, 10, 8, 7])[0]
        if kind == "toxic":
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(["idiot", "scum"])
        if kind == "mark":
            own = [w + "$$$" for w in own]
        if kind == "repeat":
            own = [w for w in own[:10] for _ in range(12)]
        docs.append((i, " ".join(own), rng.choice(["en", "de"]), f"src{i % 3}", 0))
        labels.append((i, int(kind in ("clean", "toxic")), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(1500, 1)
    rng = random.Random(2)
    known = {i for i in range(1500) if rng.random() < 0.5}
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([x for x in labels if x[0] in known], LABELS), labels, known


def test_quality_on_unlabelled_documents(frames):
    docs, known_labels, labels, known = frames
    truth = {i: q for i, q, _ in labels}
    rows = [r for r in Q.score_documents(docs, known_labels).collect() if r["doc_id"] not in known]
    right = [r["keep"] == bool(truth[r["doc_id"]]) for r in rows]
    assert np.mean(right) > 0.98
    good = [r for r in rows if truth[r["doc_id"]]]
    assert np.mean([r["keep"] for r in good]) > 0.99
    assert all(0 <= r["score"] <= 1 and 0 <= r["p_meta"] <= 1 for r in rows)


def plain_counts(model, rows, labels, sure):
    """What the views teach each other, document by document."""
    told = [({}, [0, 0]), ({}, [0, 0])]
    for i in range(len(labels)):
        if labels[i] >= 0:
            continue
        odds = []
        for view, own in zip(model.views, (rows[0][i], rows[1][i]), strict=True):
            taught = sum(float(view.ratios[s]) for s in own) / len(own) ** 0.5 * view.mix[0] + view.mix[1]
            odds.append((taught + sum(float(view.regression[s]) for s in own)) * view.line[0] + view.line[1])
        good = [1 / (1 + math.exp(-z)) for z in odds]
        for v in (0, 1):
            for label in (0, 1):
                own, other = (g if label else 1 - g for g in (good[v], good[1 - v]))
                if own >= sure and other >= 1 - sure:
                    seen, documents = told[1 - v]
                    documents[label] += 1
                    for s in rows[1 - v][i]:
                        seen.setdefault(int(s), [0, 0])[label] += 1
    return told


def as_arrays(taught):
    out = []
    for (seen, documents), size in zip(taught, Q.SIZES, strict=True):
        counts = np.zeros((2, size), np.int64)
        for s, n in seen.items():
            counts[:, s] = n
        out.append((counts, np.array(documents)))
    return out


def test_scores_match_a_plain_version(spark):
    """The distributed rounds give what a loop over all documents gives."""
    docs, labels = corpus(700, 5)
    docs += [(3000, None, None, None, None), (3001, "", "en", "src0", 0), (3002, "long " * 30_000, "en", "src0", 0)]
    text = [text_features(t) for _, t, *_ in docs]
    meta = [meta_features(t, {"lang": a, "source": b}) for _, t, a, b, _ in docs]
    given = np.full(len(docs), -1)
    given[:300] = [q for _, q, _ in labels[:300]]
    known = given >= 0
    model = Q.co_train(tuple([r for r, k in zip(rows, known, strict=True) if k] for rows in (text, meta)), given[known], lambda m: as_arrays(plain_counts(m, (text, meta), given, 0.98)))
    want = model.of_rows((Q.Rows.of(text), Q.Rows.of(meta)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in Q.score_documents(frame, spark.createDataFrame(labels[:300], LABELS)).collect()}
    for k, name in enumerate(("p_text", "p_meta", "score")):
        assert np.allclose([got[d[0]][name] for d in docs], want[k], atol=1e-9)
    again = {r["doc_id"]: r["score"] for r in Q.score_quality(frame, Q.fit_quality(frame, spark.createDataFrame(labels[:300], LABELS))).collect()}
    assert np.allclose([again[d[0]] for d in docs], want[2], atol=1e-9)


def test_rounds_teach_and_stay_right():
    """With few labels each view is taught by unlabelled documents, all of them asked, and held-out accuracy stays high."""
    docs, labels = corpus(900, 5)
    text = [text_features(t) for _, t, *_ in docs]
    meta = [meta_features(t, {"lang": a, "source": b}) for _, t, a, b, _ in docs]
    truth = np.array([q for _, q, _ in labels])
    given = np.where(np.arange(900) < 300, truth, -1)
    taught = []

    def teach(model):
        taught.append(as_arrays(plain_counts(model, (text, meta), given, 0.98)))
        return taught[-1]

    model = Q.co_train((text[:300], meta[:300]), given[:300], teach)
    assert all(documents.sum() > 100 for _, documents in taught[0]) and len(taught) >= 2
    score = model.score([d[1] for d in docs[300:]], [{"lang": d[2], "source": d[3]} for d in docs[300:]])[2]
    assert ((score >= 0.5) == truth[300:]).mean() > 0.97


def test_keep_good_keeps_columns_and_odd_rows(spark, frames):
    docs, known_labels, _, _ = frames
    model = Q.fit_quality(docs, known_labels)
    odd = spark.createDataFrame([(None, None, None, None, None, "z"), (5, "", "en", "s", 0, "z"), (5, "", "en", "s", 0, "z"), (6, "one " + "x" * 100_000, "en", "s", 1, "z")], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    assert Q.score_quality(odd, model).count() == 4
    assert Q.keep_good(odd, model).columns == odd.columns
    assert Q.score_quality(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("labels,kept", [([], True), ([(1, 1, 0)], True), ([(1, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], False)])
def test_quality_without_both_classes(spark, frames, labels, kept):
    docs = frames[0].limit(20)
    got = Q.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 20 and all(r["keep"] == kept for r in got)


def test_mixture_meets_its_targets(frames):
    docs, known_labels, labels, _ = frames
    weights = {"clean": 0.9, "toxic": 0.03, "junk": 0.07}
    rows = X.mix(docs, known_labels, weights=weights).collect()
    p = np.array([[r["p_clean"], r["p_toxic"], r["p_junk"]] for r in rows])
    n, rate = np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    available, got = n @ p, (n * rate) @ p
    want = X.target_totals(available, np.array([0.9, 0.03, 0.07]), 0)
    assert np.abs(got - want).max() < 0.01 * available.sum()
    assert (rate >= 0).all() and (rate <= 1).all() and set(r["copies"] for r in rows) <= {0, 1}
    kind = {i: 2 if q == 0 else t for i, q, t in labels}
    clean = [r for r in rows if kind[r["doc_id"]] == 0]
    assert np.mean([r["copies"] for r in clean]) > 0.98
    assert np.mean([r["copies"] for r in rows if kind[r["doc_id"]] == 1]) < 0.7
    taken = X.take_mixture(docs, known_labels, weights=weights)
    assert taken.columns == docs.columns
    assert sorted(r["doc_id"] for r in taken.select("doc_id").collect()) == sorted(r["doc_id"] for r in rows for _ in range(r["copies"]))


def test_rates_match_a_plain_solver(spark):
    """The steps end where long plain projected gradient descent ends."""
    rng = np.random.default_rng(0)
    n, p = rng.integers(1, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    amounts = n[:, None] * p
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    metric = np.linalg.inv(amounts.T @ amounts)
    for weights in ([0.6, 0.1, 0.3], [0.1, 0.8, 0.1]):
        targets = X.target_totals(amounts.sum(axis=0), np.array(weights), 0)
        fit = X.fit_rates(X.cells(table), weights)
        got = X.rates_after(p, fit.steps, 1.0) @ amounts
        assert np.allclose(got, fit.reached) and np.allclose(targets, fit.targets)
        if (targets > amounts.sum(axis=0)).any():
            assert (got <= amounts.sum(axis=0) + 1e-6).all()  # wanted more than there is: shown, not hidden
            continue
        slow = np.ones(300)
        for _ in range(20_000):
            slow = np.clip(slow - 0.5 * amounts @ (metric @ (slow @ amounts - targets)), 0, 1)
        assert fit.settled and np.abs(got - slow @ amounts).max() < 0.01 * amounts.sum()


def test_report_shows_what_is_scarce(spark, frames):
    docs, known_labels, _, _ = frames
    rows = {r["domain"]: r for r in X.mixture_report(docs, known_labels, weights={"clean": 0.5, "toxic": 0.45, "junk": 0.05}).collect()}
    assert rows["toxic"]["reached"] <= rows["toxic"]["available"] * (1 + 1e-9) < rows["toxic"]["wanted"]
    assert rows["junk"]["weight"] == 0.05 and rows["clean"]["wanted"] == rows["clean"]["available"]


def test_rates_depend_on_chances_alone(spark):
    table = spark.createDataFrame([(5, [0.25, 0.75]), (7, [0.25, 0.75]), (1, [1.0, 0.0])], "n_tokens long, p array<double>")
    assert sorted((r["p"], r["n_tokens"]) for r in X.cells(table).collect()) == [([0.25, 0.75], 12), ([1.0, 0.0], 1)]


def test_mixture_of_odd_tables(spark, frames):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some words", "c"), (3, "more words here", "d"), (3, "more words here", "d")], "doc_id long, text string, rate string")
    none = spark.createDataFrame([], LABELS)
    docs = docs.unionAll(spark.createDataFrame([(9, "very long " * 100_000, "e")], docs.schema))
    got = X.mix(docs, none, weights={"clean": 1.0}).collect()
    assert len(got) == 6 and all(r["p_clean"] == 1 for r in got) and max(r["n_tokens"] for r in got) == 200_000
    thirds = X.mix(docs, none, weights={"clean": 1.0, "toxic": 1.0, "junk": 1.0}).collect()
    assert all(abs(r["p_junk"] - 1 / 3) < 1e-12 for r in thirds)
    assert X.mix(docs.limit(0), none, weights={"clean": 1.0}).count() == 0
    assert X.take_mixture(docs, none, weights={"clean": 1.0}).columns == docs.columns


def test_copies_round_to_the_rate():
    ids = list(range(20_000))
    copies = X.copies_of(np.full(20_000, 1.3), ids, [5] * 20_000)
    assert set(copies.tolist()) == {1, 2} and abs(copies.mean() - 1.3) < 0.02
    assert (X.copies_of(np.ones(100), ids[:100], [1] * 100) == 1).all() and (X.copies_of(np.zeros(100), ids[:100], [1] * 100) == 0).all()
