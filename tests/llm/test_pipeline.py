"""The pipeline on a small corpus with planted copies, junk, personal data and insults."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from fathomline.llm.common import materialise, work_dir
from fathomline.llm.queries import ORACLES, QUERIES
from fathomline.session import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "the", "er", "on", "st", "ea"]) for _ in range(rng.randrange(1, 5))) for _ in range(2000)]
    weights = [1 / (k + 1) for k in range(2000)]
    docs, labels, kind = [], [], {}
    for i in range(900):
        own = rng.choices(words, weights, k=rng.randrange(60, 300))
        kind[i] = rng.choices(["clean", "toxic", "junk"], [80, 10, 10])[0]
        if kind[i] == "toxic":
            for _ in range(5):
                own[rng.randrange(len(own))] = "scumbag"
        if kind[i] == "junk":
            own = [w + "###" for w in own]
        if i % 10 == 3:
            own[5] = f"4.{i % 200}.17.{i % 250}"
        text = " ".join(own)
        docs.append((i, text, rng.choice(["en", "de"]), f"src{i % 4}", len(text)))
        labels.append((i, int(kind[i] != "junk"), int(kind[i] == "toxic")))
    for n, (i, text, lang, source, size) in enumerate(docs[:60]):
        parts = text.split(" ")
        if n % 2:
            parts[30] = "altered"
        docs.append((1000 + i, " ".join(parts), lang, source, size))
        kind[1000 + i] = kind[i]
    docs.append((5000, None, None, None, None))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(rng.sample(labels, 600), "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", kind


def test_stages_take_effect(spark, corpus):
    folder, kind = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), work_dir(spark, f"test-{name}"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    of = lambda ids, *kinds: [i for i in ids if kind.get(i) in kinds]
    assert len(of(kept[0], "junk")) <= 0.05 * len(of(kind, "junk")) and len(of(kept[0], "clean")) >= 0.99 * len(of(kind, "clean"))
    copies = [i for i in kept[0] if 1000 <= i < 2000]
    assert len(copies) > 30 and not [i for i in copies if i in kept[1] and i % 2 == 0]
    assert sum(i in kept[1] for i in copies) <= 0.2 * len(copies)
    originals = [i for i in kept[0] if i < 1000]
    assert sum(i in kept[1] for i in originals) >= 0.99 * len(originals)
    assert kept[2] == kept[1]
    assert not docs.filter(F.col("text").rlike(r"\b4\.[0-9]+\.17\.[0-9]+")).count()
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert len(of(kept[3], "clean")) >= 0.98 * len(of(kept[2], "clean")) and len(of(kept[3], "toxic")) < len(of(kept[2], "toxic"))
    packed = C.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == kept[3]


def test_run_and_registration(spark, corpus):
    import os

    def folders():
        root = shared_folder(spark).removeprefix("file://")
        return {f for f in os.listdir(root) if re.match("quality|near_dup|personal|mixture", f)} if os.path.isdir(root) else set()

    before = folders()
    rows = C.run(spark, corpus[0])
    assert [f.split("-")[0] for f in folders() - before] == ["mixture"]
    assert rows.count() > 500 and C.ORACLE_SQL is None
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "packing"]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_clashing_names_and_odd_rows(spark, corpus, tmp_path):
    """Stages keep extra columns whatever their names, and take nulls, repeated rows and long texts."""
    names = ["label", "dropped id", "fathomline pii hits", "pii hits", "copy", "row", "goes", "domain", "rate", "copies", "p", "node", "fp"]
    rows = [(1, "one good text " * 40, "en", "s", 1), (1, "one good text " * 40, "en", "s", 1), (None, None, None, None, None), (3, "word " * 40_000, "en", "s", 1), (4, "", "en", "s", 0), (5, "call 415-555-0199 now please my friend", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *["own"] * len(names)) for r in rows], DOCS + ", " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, corpus[0])
        assert got.columns == docs.columns, name
        assert all(set(r[5:]) == {"own"} for r in got.collect()), name
    assert C.STAGES[-1][1](spark, docs, corpus[0]).count() >= 6


def test_work_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from fathomline.session import shared_folder as shared

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared(fake)


def test_empty_corpus(spark, corpus, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0
