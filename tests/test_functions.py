"""Functions: chunks, questions, lexemes, ranks, vectors, embedding."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.config import Settings, origins
from fathomline.functions import text as T
from fathomline.functions.chunking import chunk_documents, chunks_of
from fathomline.functions.embedding import HashingEmbedder, checked_width, embed_chunks, embed_text
from fathomline.functions.ranking import rank
from fathomline.functions.stemming import lexemes, query_lexemes, simple, stem
from fathomline.functions.vectors import cosine_distance


def test_chunk_lengths_of_a_known_text():
    chunks = list(chunks_of("word " * 500))
    assert [len(c) for c in chunks] == [999, 999, 899]
    assert list(chunks_of("Short paragraph.")) == ["Short paragraph."]
    assert list(chunks_of("")) == list(chunks_of("  \n ")) == []
    assert [len(c) for c in chunks_of("x" * 2500)] == [1000, 1000, 900]
    assert list(chunks_of("y" * 1000)) == ["y" * 1000]


@pytest.mark.parametrize("seed", range(8))
def test_chunk_properties(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", " ", "\n", "\n\n", "é" * rng.randrange(1, 300), "😀"]) for _ in range(2000))
    chunks = list(chunks_of(text))
    assert all(0 < len(c) <= 1000 and c == c.strip() for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    at = 0
    for c in chunks:
        at = text.index(c, max(0, at - 1200))
    short = text[:900]
    assert list(chunks_of(short)) == ([short.strip()] if short.strip() else [])


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("a", "word " * 500), ("b", None), ("c", " "), (None, "x")], "doc_id string, text string")
    got = chunk_documents(docs).orderBy("document_id", "chunk_index").collect()
    assert [(r["document_id"], r["chunk_index"], len(r["content"])) for r in got] == [(None, 0, 1), ("a", 0, 999), ("a", 1, 999), ("a", 2, 899)]


QUESTIONS = {
    "What is the Corporate Name?": "Corporate Name",
    "Find the total in the document.": "total",
    "what is?": "what is",
    "plugin document": "plug",
    "X???": "X?",
    "  ?  ": "?",
    "what's X": "what's X",
    "": "",
    " Tell me the sum ": "sum",
}


def test_rewrite_question(spark):
    rows = spark.createDataFrame([(q,) for q in QUESTIONS], "q string").select("q", T.rewrite_question(F.col("q")).alias("core")).collect()
    assert {r["q"]: r["core"] for r in rows} == QUESTIONS


def test_small_text_functions(spark):
    names = {"a.PDF": ".pdf", "dir.x/name": "", ".bashrc": "", "..x": "", "x.tar.GZ": ".gz", "x.": ".", "a b.DocX": ".docx", "..a.b": ".b"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.extension(F.col("n")).alias("e")).collect()
    assert {r["n"]: r["e"] for r in rows} == names
    row = spark.range(1).select(
        T.falsy_default(F.lit(""), "d").alias("a"), T.falsy_default(F.lit(None).cast("string"), "d").alias("b"), T.plural(F.lit(1), "source").alias("c"),
        T.plural(F.lit(0), "source").alias("d"), T.ordinal_label(F.lit(4)).alias("e"), T.batch_count(F.lit(201)).alias("f"), T.batch_number(F.lit(100)).alias("g"), T.is_blank(F.lit(" \n")).alias("h"), T.head(F.lit("😀bc"), 2).alias("i"),
    ).first()
    assert tuple(row) == ("d", "d", "source", "sources", "#5", 3, 2, True, "😀b")


STEMS = {
    "consign": "consign", "consigned": "consign", "consisting": "consist", "consolations": "consol", "knightly": "knight", "knives": "knive", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
    "hopping": "hop", "hoped": "hope", "agreed": "agre", "feed": "feed", "generous": "generous", "generically": "generic", "communism": "communism", "communication": "communic", "happily": "happili", "relational": "relat", "conditional": "condit",
    "vietnamization": "vietnam", "analogously": "analog", "hopefulness": "hope", "adjustable": "adjust", "adoption": "adopt", "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "proceed": "proceed", "controlling": "control", "roll": "roll", "say": "say", "by": "by", "youth": "youth", "boy's": "boy", "rate": "rate", "luxuriated": "luxuri",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_lexemes_and_rank():
    assert lexemes("The revenues of the company's revenue") == {"revenu": [2, 6], "compani": [5]}
    assert query_lexemes("the of") == [] and query_lexemes("revenue Revenues total") == ["revenu", "total"]
    one = rank({"a": [1, 5]}, ["a"])
    assert math.isclose(one, 0.1 * (1 + 1 / 4) / 1.64493406685)
    near, far = rank({"a": [1], "b": [2]}, ["a", "b"]), rank({"a": [1], "b": [50]}, ["a", "b"])
    assert math.isclose(near, 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))) and near > far > 0
    assert rank({"a": [1]}, ["a", "b"]) == rank({}, []) == 0.0
    assert [x for x, _ in simple("É a-B 12")] == ["a", "b", "12"]


def test_cosine_distance(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [-3.0, 0.0])]
    frame = spark.createDataFrame(rows, "id int, v array<double>").withColumn("d", cosine_distance(F.col("v"), F.array(F.lit(2.0), F.lit(0.0))))
    got = [(r["id"], r["d"]) for r in frame.orderBy(F.col("d").asc_nulls_last()).collect()]
    assert got[:3] == [(1, 0.0), (2, 1.0), (5, 2.0)] and math.isnan(got[3][1]) and got[4] == (4, None)


def test_embedding(spark):
    e = HashingEmbedder(16)
    assert embed_text(e, "a b") == e(["a b"])[0] and math.isclose(sum(x * x for x in e.one("some words")), 1)

    class Counting(HashingEmbedder):
        def __call__(self, texts):
            assert len(texts) <= 2
            return super().__call__(texts)

    chunks = spark.createDataFrame([(i, f"t {i}") for i in range(7)], "chunk_index int, content string")
    got = embed_chunks(chunks, lambda: Counting(16), width=16, batch=2).orderBy("chunk_index").collect()
    assert all(r["embedding"] == pytest.approx(e.one(f"t {i}"), rel=1e-6) for i, r in enumerate(got)) and len(got) == 7
    with pytest.raises(Exception, match="vectors of width 8"):
        embed_chunks(chunks, lambda: HashingEmbedder(16), width=8).collect()
    with pytest.raises(Exception, match="wrong vector width"):
        spark.createDataFrame([([1.0],)], "e array<double>").select(checked_width("e", 2)).collect()
    assert spark.createDataFrame([(None,)], "e array<double>").select(checked_width("e", 2).alias("e")).first()["e"] is None


def test_settings():
    s = Settings.from_env({"FATHOMLINE_TOP_K": "3", "FATHOMLINE_UPLOAD_DIR": "/x"})
    assert (s.top_k, s.upload_dir, s.chunk_size, Settings().max_upload_bytes) == (3, "/x", 1000, 20 * 1024 * 1024)
    assert origins("a, b,c") == ["a", " b", "c"]
