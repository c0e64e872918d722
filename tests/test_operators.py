"""Search, lifecycle, messages, agent, sources, streaming."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from fathomline import agent as A
from fathomline.config import Settings
from fathomline.functions.embedding import HashingEmbedder
from fathomline.logs import log_to
from fathomline.operators import lifecycle as L
from fathomline.operators import messages as M
from fathomline.operators import search as S
from fathomline.schemas import STATUS_LOG
from fathomline.service import DocumentService, Rejected
from fathomline.sources import tables, uploads
from fathomline.streaming import ingest, status

CHUNK = "document_id string, chunk_index int, content string, embedding array<float>"


def chunk_table(spark, sizes, width=4):
    e = HashingEmbedder(width)
    rows = [(d, i, t, e.one(t)) for d, n in sizes.items() for i in range(n) for t in [f"passage {i} of {d} revenue {i % 3}"]]
    return spark.createDataFrame(rows, CHUNK)


@pytest.mark.parametrize("k", [1, 8])
def test_vector_topk_edges(spark, k):
    rows = [("d", 0, "a", [1.0, 0.0]), ("d", 1, "b", [1.0, 0.0]), ("d", 2, "z", [0.0, 0.0]), ("d", 3, "n", None), ("e", 0, "o", [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNK)
    got = [r["chunk_index"] for r in S.vector_topk(chunks, [1.0, 0.0], "d", k).collect()]
    assert got == [0, 1, 2, 3][:k]
    queries = spark.createDataFrame([(1, "d", [1.0, 0.0]), (2, "none", [1.0, 0.0])], "query_id int, document_id string, vector array<double>")
    assert [r["chunk_index"] for r in S.vector_topk_batch(chunks, queries, k).orderBy("rank").collect()] == [0, 1, 2, 3][:k]


def test_text_hits_never_change_the_merged_result(spark):
    chunks = chunk_table(spark, {"a": 0, "b": 1, "c": 7, "d": 8, "e": 9, "f": 30})
    queries = spark.createDataFrame([(i, d, HashingEmbedder(4).one("revenue 1"), "revenue 1") for i, d in enumerate("abcdef")], "query_id int, document_id string, vector array<double>, query string")
    vector, text = S.vector_topk_batch(chunks, queries), S.fts_topk(chunks, queries.drop("vector"))
    both, alone = (S.merge_legs(vector, text, fill=fill).orderBy("query_id", "rank").collect() for fill in (True, False))
    assert [tuple(r) for r in both] == [tuple(r) for r in alone] and len(alone) == 0 + 1 + 7 + 8 + 8 + 8
    short = S.merge_legs(vector.filter("rank <= 2"), text, k=4, fill=True).filter("query_id = 5")
    assert short.count() == 4
    assert S.reciprocal_rank_fusion([vector, text]).count() > 0


def test_full_text(spark):
    rows = [("d", 0, "The revenue was $100M in Q3.", None), ("d", 1, "Revenues and total revenue, total", None), ("d", 2, None, None), ("e", 0, "revenue", None)]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame([(1, "d", "revenue revenue"), (2, "d", "total revenue"), (3, "d", "!!"), (4, "d", "absent")], "query_id int, document_id string, query string")
    assert sorted(map(tuple, S.fts_match(chunks, queries).collect())) == [(1, "d", 0, 1), (1, "d", 1, 1), (2, "d", 1, 3)]
    best = S.fts_topk_english(chunks, [(1, "revenue"), (2, "the of"), (3, "Q3 revenues")]).collect()
    assert [(r["query_id"], r["document_id"], r["chunk_index"]) for r in sorted(best)] == [(1, "d", 0), (1, "d", 1), (1, "e", 0), (3, "d", 0)]


def test_ranked_search_matches_a_plain_one(spark):
    import math
    import random
    from itertools import combinations

    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "running", "runs", "the"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(40)]
    chunks = spark.createDataFrame([("d", i, t, None) for i, t in enumerate(texts)] + [("e", 0, None, None)], CHUNK)
    queries = [(1, "alpha beta"), (2, "run"), (3, "gamma gamma the beta alpha"), (4, "the"), (5, "absent alpha")]
    stems = {"running": "run", "runs": "run"}

    def plain(text, query):
        places = {}
        for at, w in enumerate(text.split(), 1):
            if w != "the":
                places.setdefault(stems.get(w, w), []).append(at)
        wanted = list(dict.fromkeys(w for w in query.split() if w != "the"))
        if not wanted or any(w not in places for w in wanted):
            return None
        if len(wanted) == 1:
            return sum(0.1 / (j * j) for j in range(1, len(places[wanted[0]]) + 1)) / 1.64493406685
        out = None
        for a, b in combinations(wanted, 2):
            for x in places[a]:
                for y in places[b]:
                    near = 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
                    out = near if out is None else 1 - (1 - out) * (1 - near)
        return out

    got = {(r["query_id"], r["chunk_index"]): (r["score"], r["rank"]) for r in S.fts_topk_english(chunks, queries, k=100).collect()}
    want = {(q, i): s for q, query in queries for i, t in enumerate(texts) if (s := plain(t, query)) is not None}
    assert got.keys() == want.keys() and {q for q, _ in got} == {1, 2, 3}
    assert all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
    for q in (1, 2, 3):
        ranks = sorted((rank, -score, i) for (k, i), (score, rank) in got.items() if k == q)
        assert ranks == sorted(ranks, key=lambda r: (r[1], r[2])) and [r[0] for r in ranks] == list(range(1, len(ranks) + 1))
    home = spark.createDataFrame([(1, "e", "alpha"), (2, "d", "alpha")], "query_id int, document_id string, query string")
    assert {r["query_id"] for r in S.fts_topk_ranked(chunks, home, by_document=True).collect()} == {2}


def test_ranked_search_shuffles_scores_alone(spark):
    # 300 texts that hold nearly all lexemes of 40 queries: places of texts that don't match must not travel
    words = [f"w{i}" for i in range(41)]
    texts = [" ".join(w for w in words if w != words[i % 41]) for i in range(300)]
    chunks = spark.createDataFrame([("d", i, t, None) for i, t in enumerate(texts)], CHUNK)
    queries = spark.createDataFrame([(i, " ".join(words[: i + 2])) for i in range(40)], "query_id int, query string")
    found = S.fts_topk_ranked(chunks, queries, analyzer="simple")
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert plan.index("Exchange ") < plan.index("WindowGroupLimit", plan.index("Exchange "))
    got = found.collect()
    assert {r["query_id"] for r in got} == set(range(39))
    assert all(r["chunk_index"] % 41 > r["query_id"] + 1 for r in got)


def test_ranked_search_like_sql_on_odd_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from fathomline.plans import queries as P

    long = "x " * 16_390 + "alpha beta"
    texts = [(1, "a", long), (2, "a", "beta " + long), (None, "a", "alpha beta"), (3, None, "alpha, beta alpha"), (4, "b", None), (5, "b", "")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha beta. alpha\nbeta. !"), (1, None), (2, "x beta")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, P.fts_ranked_simple(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(P.ORACLES["fts_ranked_simple"]).fetchall(), key=str) and len(got) == 10


@pytest.mark.parametrize("block", [1, 2, 20_000])
def test_ranked_search_by_blocks_of_queries(spark, monkeypatch, block):
    rows = [("d", 0, "alpha beta", None), ("d", 1, "beta alpha alpha", None), ("e", 0, "alpha", None), (None, 3, "alpha beta", None), ("e", None, "alpha", None)]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = [(1, "d", "alpha beta"), (2, "e", "alpha"), (3, "d", "absent"), (4, None, "alpha"), (5, "e", None), (None, "d", "alpha"), (6, "d", "alpha")]
    asked = spark.createDataFrame(queries, "query_id int, document_id string, query string")
    monkeypatch.setattr(S, "QUERY_BLOCK", block)

    def got(k=8, **options):
        return {(r["query_id"], r["rank"]): (r["document_id"], r["chunk_index"]) for r in S.fts_topk_ranked(chunks, asked, k, analyzer="simple", **options).collect()}

    assert got(by_document=True) == {(1, 1): ("d", 1), (1, 2): ("d", 0), (2, 1): ("e", 0), (2, 2): ("e", None), (6, 1): ("d", 1), (6, 2): ("d", 0)}
    alpha = [("d", 1), ("d", 0), ("e", 0), ("e", None), (None, 3)]
    assert got() == {(1, 1): ("d", 1), (1, 2): ("d", 0), (1, 3): (None, 3)} | {(q, k): v for q in (2, 4, 6) for k, v in enumerate(alpha, 1)}
    assert got(k=1)[6, 1] == ("d", 1) and S.fts_topk_ranked(chunks, asked.limit(0)).count() == 0


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(1, 0, 5, "x" * 500), (1, 1, 3, "b"), (1, 2, 5, "again"), (2, 0, 0, "")], "q int, rank int, chunk_index int, content string")
    got = {r["q"]: r["context"] for r in S.context(hits, ["q"], "rank").collect()}
    assert got == {1: "x" * 500 + "\n\n---\n\nb\n\n---\n\nagain", 2: "No relevant content found."}
    cited = S.citations(hits.filter("q = 1"), ["q"], ["rank"]).orderBy("rank").collect()
    assert [(r["chunk_index"], len(r["content"])) for r in cited] == [(5, 400), (3, 1)]


def test_lifecycle(spark):
    log = spark.createDataFrame([("a", 0, "pending", None), ("a", 1, "processing", None), ("a", 2, "failed", ""), ("a", 3, "processing", None), ("a", 4, "done", None), ("b", 0, "pending", None), ("b", 1, "done", None)], STATUS_LOG)
    assert {r["document_id"]: r["status"] for r in L.latest(log).collect()} == {"a": "done", "b": "done"}
    seen = [(r["seq"], r["message"]) for r in L.told(log).filter("document_id = 'a'").orderBy("seq").collect()]
    assert seen == [(0, L.WORKING), (1, L.WORKING), (2, L.FAILED)]
    assert [r["allowed"] for r in L.allowed(log).orderBy("document_id", "seq").collect()] == [True] * 5 + [True, False]
    docs = spark.createDataFrame([("1", "done"), ("2", "processing")], "id string, status string")
    L.require_ready(docs, "1")
    with pytest.raises(L.NotFound):
        L.require_ready(docs, "not a uuid")
    with pytest.raises(L.NotReady):
        L.require_ready(docs, "2")
    assert list(status.watch([("processing", None), ("failed", ""), ("done", None)])) == [{"status": "processing", "message": L.WORKING}, {"status": "failed", "message": L.FAILED}]


def test_frames():
    reader = M.FrameReader()
    whole = M.frame({"type": "token", "content": "é\n"}) + ": note\ndata: {bad\n" + M.frame({"type": "done"})
    assert '"type": "token"' in whole and "\\u00e9" in whole
    got = [e for i in range(0, len(whole), 7) for e in reader.feed(whole[i : i + 7])]
    assert got == [{"type": "token", "content": "é\n"}, {"type": "done"}] and not reader.incomplete
    assert list(reader.feed('data: {"type": "late"}')) == [] and reader.incomplete


def test_fold(spark):
    rows = [("m", 0, "token", "a", None), ("m", 1, "token", "", None), ("m", 3, "token", "c", None), ("m", 2, "token", "b", None), ("m", 4, "citations", None, [(1, "x")]), ("m", 5, "done", None, None), ("n", 0, "token", "t", None), ("n", 1, "error", None, None), ("o", 0, "token", "u", None)]
    events = spark.createDataFrame(rows, "message_id string, seq long, type string, content string, chunks array<struct<chunk_index: int, content: string>>")
    got = {r["message_id"]: (r["content"], len(r["citations"]), r["streaming"], r["error"]) for r in M.fold(events).collect()}
    assert got == {"m": ("abc", 1, False, False), "n": ("t", 0, False, True), "o": ("u", 0, True, False)}
    late = spark.createDataFrame([*rows, ("m", 6, "token", "LATE", None), ("m", 7, "citations", None, []), ("m", 8, "error", None, None), ("n", 2, "done", None, None)], events.schema)
    assert {r["message_id"]: (r["content"], len(r["citations"]), r["streaming"], r["error"]) for r in M.fold(late).collect()} == got
    assert M.fold(events).agg(M.any_streaming().alias("s")).first()["s"]


def test_markup(spark):
    talk = spark.createDataFrame([(1, "1. **A**: x\n\n2. **B**: **y**\npara **b**\n3. **C**: z\n   ")], "id int, text string")
    rows = M.markup_blocks(M.markup_lines(M.split_lines(talk, "text")), ["id"]).orderBy("line_no").collect()
    assert [(r["kind"], r["label"], r["body"], r["block"]) for r in rows] == [("item", "A:", "x", 1), ("item", "B:", "**y**", 1), ("paragraph", None, "para <strong>b</strong>", 2), ("item", "C:", "z", 3)]


def test_answer_events(spark):
    chunks = spark.createDataFrame([("d", 0, "The revenue was $100M in Q3.", HashingEmbedder(8).one("revenue q3"))], CHUNK)
    search = A.search_tool(chunks, "d", HashingEmbedder(8))
    model = A.ScriptedModel([A.Reply(tool_calls=[A.ToolCall("1", {"query": "What is Q3 revenue?"}), A.ToolCall("2", {"query": "again"})]), A.Reply("thrown away")], ["Revenue", "", " was $100M."])
    events = list(A.answer("How much?", model, search))
    assert events == [{"type": "token", "content": "Revenue"}, {"type": "token", "content": " was $100M."}, {"type": "citations", "chunks": [{"chunk_index": 0, "content": "The revenue was $100M in Q3."}]}, {"type": "done"}]
    assert [m.role for m in model.seen[-1]] == ["system", "human", "ai", "tool", "tool"]
    assert A.search_tool(chunks, "none", HashingEmbedder(8))("x") == (S.NOTHING_FOUND, [])
    forever = A.ScriptedModel([A.Reply(tool_calls=[A.ToolCall("1", {"query": "x"})])] * 9, ["ok"])
    assert list(A.answer("?", forever, lambda q: ("", [])))[0]["content"] == "ok" and len(forever.replies) == 6


def test_chat_frames(spark):
    docs = spark.createDataFrame([("d", "done")], "id string, status string")
    chunks = chunk_table(spark, {"d": 2})

    class Broken(A.ScriptedModel):
        def stream(self, messages):
            yield "a"
            raise RuntimeError("gone")

    got = [json.loads(f[6:]) for f in A.chat(docs, chunks, "d", "q", Broken([], []), HashingEmbedder(4))]
    assert got == [{"type": "token", "content": "a"}, {"type": "error", "message": "gone"}]
    with pytest.raises(L.NotFound):
        A.chat(docs, chunks, "x", "q", Broken([], []), HashingEmbedder(4))


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    parts = [b"%PDF-1.4\n"]
    for page in pages:
        data = zlib.compress(f"BT /F1 12 Tf ({page}) Tj ET".encode())
        parts.append(b"1 0 obj <</Length %d /Filter /FlateDecode>>\nstream\n" % len(data) + data + b"\nendstream endobj\n")
    return b"".join(parts)


def test_parse(spark):
    files = [("a.DOCX", docx("Hello from DOCX", "  ", "two")), ("b.pdf", pdf("page one", "page \\(two\\)")), ("c.pdf", b"junk"), ("photo.png", b"x"), ("report.bin", pdf("x")), ("d.docx", None)]
    rows = uploads.parse(spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in files], "file_name string, content binary")).collect()
    got = {r["file_name"]: (r["text"], r["error"] is None) for r in rows}
    assert got["a.DOCX"] == ("Hello from DOCX\ntwo", True) and got["b.pdf"] == ("page one\npage (two)", True)
    assert got["photo.png"] == ("[image: photo.png]", True) and got["report.bin"] == ("[image: report.bin]", True)
    assert got["c.pdf"] == (None, False) and got["d.docx"] == (None, False)


def test_validate(spark):
    mb = 1024 * 1024
    rows = [("application/pdf", 20 * mb), ("application/pdf", 20 * mb + 1), ("text/x-python", 10**9), ("image/webp", 0)]
    got = uploads.validate(spark.createDataFrame(rows, "content_type string, length long")).collect()
    assert [(r["stored_ext"], r["error"]) for r in got] == [(".pdf", None), (".pdf", "File exceeds 20MB limit"), (None, "Unsupported file type"), (".webp", None)]


def test_land_and_read(spark, tmp_path):
    up = spark.createDataFrame([("a.pdf", "application/pdf", bytearray(b"1")), ("b.py", "text/x-python", bytearray(b"2"))], "file_name string, content_type string, content binary")
    got = uploads.land(up, f"file://{tmp_path}/land").collect()
    assert [(r["file_name"], r["status"]) for r in got] == [("a.pdf", "pending")]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert uploads.read_files(spark, f"file://{tmp_path}/f.bin").first()["length"] == 3


def test_chunk_store(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    first = chunk_table(spark, {"a": 3, "b": 2})
    tables.write_chunks(first, path, width=4)
    tables.write_chunks(chunk_table(spark, {"b": 1, "c": 4}), path, width=4)
    tables.write_chunks(chunk_table(spark, {"c": 4}), path, width=4)
    got = {r["document_id"]: r["count"] for r in tables.read_chunks(spark, path).groupBy("document_id").count().collect()}
    assert got == {"a": 3, "b": 1, "c": 4}
    assert tables.read_chunks(spark, path, "c").count() == 4 and tables.read_chunks(spark, path, "zzz").count() == 0
    with pytest.raises(Exception, match="wrong vector width"):
        tables.write_chunks(first, path, width=5)
    kids, parents = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "id int")
    assert [r["k"] for r in tables.orphans(kids, parents, "k", "id").collect()] == [2, None]
    assert tables.delete_cascade(kids, parents.withColumnRenamed("id", "k"), "k").count() == 2
    tables.create_tables(spark, f"file://{tmp_path}/db")
    assert tables.read_table(spark, f"file://{tmp_path}/db", "documents").count() == 0
    tables.drop_tables(spark, f"file://{tmp_path}/db")
    assert not (tmp_path / "db" / "documents.parquet").exists()
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("odd",)], "s string").select(tables.check_status(F.col("s"))).collect()


def test_ingest_stream(spark, tmp_path):
    folder = tmp_path / "in"
    files = spark.createDataFrame([("1", "a.docx", bytearray(docx("word " * 400))), ("2", "b.pdf", bytearray(b"junk")), ("3", "c.docx", bytearray(docx()))], "id string, file_name string, content binary")
    files.write.parquet(f"file://{folder}")
    log, chunks = f"file://{tmp_path}/log", f"file://{tmp_path}/chunks"
    options = {"settings": Settings(retry_seconds=0), "log_path": log, "chunk_path": chunks, "make_embedder": lambda: HashingEmbedder(8), "width": 8}
    source = spark.readStream.schema(files.schema).parquet(f"file://{folder}")
    for _ in range(2):
        ingest.ingest_stream(source, checkpoint=f"file://{tmp_path}/cp", **options).awaitTermination(120)
    table = spark.read.schema(STATUS_LOG).parquet(log)
    assert {r["document_id"]: (r["status"], r["error_msg"]) for r in L.latest(table).collect()} == {"1": ("done", None), "2": ("failed", "not a PDF"), "3": ("done", None)}
    assert [r["status"] for r in table.filter("document_id = '2'").orderBy("seq").collect()] == ["processing", "failed"] * 2
    assert table.filter("document_id = '1'").count() == 2
    stored = tables.read_chunks(spark, chunks)
    assert stored.count() == 3 and stored.select("document_id").distinct().count() == 1
    ingest.ingest_batch(files, **options)
    assert tables.read_chunks(spark, chunks).count() == 3
    live = status.status_stream(spark, log).writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    live.awaitTermination(60)
    assert spark.sql("select * from live where message = 'not a PDF'").count() >= 2


def test_embedding_fails_alone_and_once_more(spark, tmp_path):
    rows = [("1", "a.docx", docx("good words")), ("2", "b.docx", docx("poison here")), ("3", "c.pdf", b"junk"), ("4", "d.docx", docx("first", "second"))]
    frame = lambda rows: spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], "id string, file_name string, content binary")
    waited = []

    class Picky(HashingEmbedder):
        def __call__(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("model said no" + "!" * 600)
            return [self.one(t) for t in texts]

    options = {"settings": Settings(), "log_path": f"file://{tmp_path}/log", "chunk_path": f"file://{tmp_path}/chunks", "width": 8, "wait": waited.append}
    ingest.ingest_batch(frame(rows), make_embedder=lambda: Picky(8), **options)
    log = spark.read.schema(STATUS_LOG).parquet(options["log_path"])
    last = {r["document_id"]: (r["status"], r["error_msg"]) for r in L.latest(log).collect()}
    assert last == {"1": ("done", None), "2": ("failed", ("model said no" + "!" * 600)[:500]), "3": ("failed", "not a PDF"), "4": ("done", None)}
    for i, n in (("1", 2), ("2", 4), ("3", 4)):
        assert [r["status"] for r in log.filter(F.col("document_id") == i).orderBy("seq").collect()] == (["processing", "done"] if n == 2 else ["processing", "failed"] * 2)
    assert waited == [10] and spark._jsc.getPersistentRDDs().isEmpty()
    assert {r["document_id"] for r in tables.read_chunks(spark, options["chunk_path"]).collect()} == {"1", "4"}
    # a document that has become empty loses its chunks, whatever else lies in its folder
    ingest.ingest_batch(frame([("1", "a.docx", docx()), ("4", "d.docx", docx())]), make_embedder=lambda: HashingEmbedder(8), **options)
    assert tables.read_chunks(spark, options["chunk_path"]).count() == 0


def test_storing_fails_for_the_batch(spark, tmp_path, monkeypatch):
    calls, real = [], ingest.write_chunks

    def write(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("disk full")
        real(*args, **kwargs)

    monkeypatch.setattr(ingest, "write_chunks", write)
    files = spark.createDataFrame([("1", "a.docx", bytearray(docx("good words"))), ("2", "b.pdf", bytearray(b"junk"))], "id string, file_name string, content binary")
    options = {"settings": Settings(retry_seconds=0), "log_path": f"file://{tmp_path}/log", "chunk_path": f"file://{tmp_path}/chunks", "make_embedder": lambda: HashingEmbedder(8), "width": 8}
    ingest.ingest_batch(files, **options)
    log = spark.read.schema(STATUS_LOG).parquet(options["log_path"])
    assert [(r["status"], r["error_msg"]) for r in log.filter("document_id = '1'").orderBy("seq").collect()] == [("processing", None), ("failed", "disk full"), ("processing", None), ("done", None)]
    assert {r["document_id"]: r["status"] for r in L.latest(log).collect()} == {"1": "done", "2": "failed"}


def test_service_picks_up_and_cleans_up(spark, tmp_path, monkeypatch):
    service = DocumentService(spark, f"file://{tmp_path}/app", lambda: HashingEmbedder(8), 8, Settings(retry_seconds=0))
    cut_off = service.upload("a.docx", "image/png", docx("left in processing"))
    spark.createDataFrame([(cut_off["id"], 7, "processing", None)], STATUS_LOG).write.mode("append").parquet(service.log_path)
    service.ingest_pending()
    assert [r["id"] for r in service.ready().collect()] == [cut_off["id"]]
    before = set((tmp_path / "app" / "files").iterdir())

    def fail(*_):
        raise OSError("no row")

    monkeypatch.setattr(service, "_add_row", fail)
    with pytest.raises(OSError, match="no row"):
        service.upload("b.pdf", "application/pdf", b"x")
    assert set((tmp_path / "app" / "files").iterdir()) == before and service.documents().count() == 1


def test_service(spark, tmp_path):
    service = DocumentService(spark, f"file://{tmp_path}/app", lambda: HashingEmbedder(8), 8, Settings(retry_seconds=0, max_upload_mb=1))
    with pytest.raises(Rejected, match="Unsupported"):
        service.upload("x.py", "text/x-python", b"x" * 2**21)
    with pytest.raises(Rejected, match="1MB"):
        service.upload("x.png", "image/png", b"x" * (2**20 + 1))
    good = service.upload("a.docx", "image/png", docx("The revenue was high.", "Costs fell."))
    bad = service.upload("b.pdf", "application/pdf", b"junk")
    assert good["status"] == "pending" and service.ready().count() == 0
    with pytest.raises(L.NotReady):
        service.chat(good["id"], "?", A.ScriptedModel([], []))
    service.ingest_pending()
    service.ingest_pending()
    assert [r["file_name"] for r in service.ready().collect()] == ["a.docx"]
    read = lambda frames: [json.loads(f[6:]) for f in frames]
    assert read(service.status(good["id"], lambda s: None)) == [{"status": "done", "message": L.READY}]
    assert read(service.status(bad["id"], lambda s: None)) == [{"status": "failed", "message": "not a PDF"}]
    with pytest.raises(L.NotFound):
        service.status("nobody")
    model = A.ScriptedModel([A.Reply(tool_calls=[A.ToolCall("1", {"query": "revenue"})])], ["High."])
    events = read(service.chat(good["id"], "What is the revenue?", model))
    assert [e["type"] for e in events] == ["token", "citations", "done"] and events[1]["chunks"][0]["content"].startswith("The revenue")
    assert service.health() == {"status": "ok"}


def test_client_side(spark, tmp_path):
    def broken():
        yield {"status": "processing"}
        raise OSError

    assert list(status.follow(broken())) == [{"status": "processing"}, {"status": "failed", "message": status.LOST}]
    assert list(status.follow(iter([{"status": "done"}, {"status": "late"}]))) == [{"status": "done"}]
    rows = spark.createDataFrame([("hi", "d", False), (" ", "d", False), ("hi", None, False), ("hi", "d", True), (None, "d", False)], "t string, d string, p boolean")
    assert [r[0] for r in rows.select(L.can_send(F.col("t"), F.col("d"), F.col("p"))).collect()] == [True, False, False, False, False]
    states = spark.createDataFrame([(None,), ("pending",), ("processing",), ("failed",)], "s string").select(L.client_state(F.col("s"))).collect()
    assert [r[0] for r in states] == ["idle", "uploading", "processing", "failed"]
    logger = log_to(str(tmp_path / "app.log"))
    logger.info("hello")
    assert "hello" in (tmp_path / "app.log").read_text()


def test_fold_stream(spark, tmp_path):
    rows = [("m", 1, "token", "b", None), ("m", 0, "token", "a", None), ("m", 2, "citations", None, [(4, "é")]), ("m", 3, "done", None, None), ("m", 4, "token", "late", None), ("n", 0, "token", "x", None)]
    schema = "message_id string, seq long, type string, content string, chunks array<struct<chunk_index: int, content: string>>"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/ev")
    run = status.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["message_id"]: (r["content"], [tuple(c) for c in r["citations"]], r["streaming"]) for r in spark.sql("select * from folded").collect()}
    assert got == {"m": ("ab", [(4, "é")], False), "n": ("x", [], True)}
    lines = spark.createDataFrame([('data: {"type": "done"}',), ("data: {bad",), (": x",)], "value string")
    assert status.typed_events(lines).count() == 1
