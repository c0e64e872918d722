"""Registered queries over the test tables, and the DuckDB SQL of the same results.

Tables stand in for the stored ones: embeddings are chunks (label is the document, vec_id the chunk),
documents are texts, conversations are messages, events are a status log, benchmark passages give
the search words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import chunk_documents
from ..functions.embedding import HashingEmbedder, embed_chunks
from ..operators import lifecycle as L
from ..operators import messages as M
from ..operators import search as S
from ..session import shared_folder
from ..sources.tables import bucket, delete_cascade, orphans, read_table
from ..sources.uploads import docx_bytes, parse, pdf_bytes, validate
from ..streaming.status import fold_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_index"), "embedding")


def _questions(chunks: DataFrame) -> DataFrame:
    """Each document's first chunk asks for its neighbours."""
    return chunks.groupBy("document_id").agg(F.min_by("embedding", "chunk_index").alias("vector")).withColumn("query_id", F.col("document_id").cast("long"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of their sources: one chunk a document."""
    return read_table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))


def _word_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every benchmark passage: query_id tells passage and place."""
    each = F.posexplode(F.split("text", r"[.\n]+")).alias("place", "query")
    return read_table(spark, d, "benchmark").select("item_id", each).select((F.col("item_id") * 1000 + F.col("place")).alias("query_id"), "query")


_DISTANCE = "CASE WHEN sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v)) = 0 THEN 'nan'::DOUBLE ELSE 1 - list_inner_product(e, v) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v))) END"
_VECTOR_SQL = f"""
    c AS (SELECT label AS document_id, vec_id AS chunk_index, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT document_id, arg_min(e, chunk_index) AS v FROM c GROUP BY document_id),
    near AS (SELECT c.document_id AS query_id, c.document_id, chunk_index, {_DISTANCE} AS distance FROM c JOIN q USING (document_id)),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, chunk_index) AS rank FROM near QUALIFY rank <= 8)
"""


@query(f"WITH {_VECTOR_SQL} SELECT chunk_index, round(distance, 6) + 0.0 AS distance FROM vec WHERE document_id = 0")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    first = chunks.filter("document_id = 0").orderBy("chunk_index").limit(1).collect()
    hits = S.vector_topk(chunks, [float(x) for x in first[0]["embedding"]], 0) if first else S.vector_topk(chunks, [0.0], 0)
    return hits.select("chunk_index", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"WITH {_VECTOR_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, chunk_index, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM vec")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return S.vector_topk_batch(chunks, _questions(chunks)).select("query_id", "chunk_index", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "rank")


_WORDS_SQL = r"""
    sentences AS (SELECT item_id, regexp_split_to_array(text, '[.\n]+') AS parts FROM benchmark),
    placed AS (SELECT item_id, unnest(parts) AS query, generate_subscripts(parts, 1) - 1 AS place FROM sentences),
    q AS (SELECT item_id * 1000 + place AS query_id, query, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS wanted FROM placed),
    ql AS (SELECT query_id, len(wanted) AS n, unnest(wanted) AS lexeme FROM q),
    w AS (SELECT source AS document_id, doc_id AS chunk_index, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM documents),
    wc AS (SELECT document_id, chunk_index, lexeme, count(*) AS n FROM w WHERE lexeme IN (SELECT lexeme FROM ql) GROUP BY ALL),
    match AS (SELECT query_id, document_id, chunk_index, CAST(sum(wc.n) AS BIGINT) AS hits FROM wc JOIN ql USING (lexeme) GROUP BY query_id, document_id, chunk_index, ql.n HAVING count(*) = ql.n),
    fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, document_id, chunk_index) AS rank FROM match QUALIFY rank <= 8)
"""


@query(f"WITH {_WORDS_SQL} SELECT * FROM match")
def fts_match_simple(spark: SparkSession, d: str) -> DataFrame:
    return S.fts_match(_texts(spark, d), _word_queries(spark, d), by_document=False)


@query(f"WITH {_WORDS_SQL} SELECT query_id, document_id, chunk_index, hits, CAST(rank AS INTEGER) AS rank FROM fts")
def fts_topk_simple(spark: SparkSession, d: str) -> DataFrame:
    return S.fts_topk(_texts(spark, d), _word_queries(spark, d), by_document=False)


_RANK_SQL = r"""
    pos AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
    tokens AS (SELECT doc_id, source, unnest(ws) AS lexeme, least(generate_subscripts(ws, 1), 16383) AS x FROM pos),
    places AS (SELECT doc_id, source, lexeme, list_sort(list_distinct(list(x)))[1:256] AS xs FROM tokens WHERE lexeme IN (SELECT lexeme FROM ql) GROUP BY ALL),
    own AS (SELECT query_id, doc_id, source, places.lexeme, xs, n FROM places JOIN ql USING (lexeme)),
    whole AS (SELECT query_id, doc_id FROM own GROUP BY query_id, doc_id, n HAVING count(*) = n),
    kept AS (SELECT own.* FROM own JOIN whole USING (query_id, doc_id)),
    single AS (SELECT query_id, source, doc_id, list_sum(list_transform(range(1, len(xs) + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685::DOUBLE AS score FROM kept WHERE n = 1),
    pairs AS (SELECT a.query_id, a.source, a.doc_id, a.xs AS xa, b.xs AS xb FROM kept a JOIN kept b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.lexeme < b.lexeme),
    ends AS (SELECT query_id, source, doc_id, x, unnest(xb) AS y FROM (SELECT query_id, source, doc_id, xb, unnest(xa) AS x FROM pairs)),
    near AS (SELECT query_id, source, doc_id, CASE WHEN abs(x - y) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x - y) / 1.5::DOUBLE - 2)) END AS w FROM ends WHERE x <> y),
    many AS (SELECT query_id, source, doc_id, 1 - product(1 - sqrt(0.1::DOUBLE * 0.1::DOUBLE * w)) AS score FROM near GROUP BY ALL),
    scored AS (SELECT query_id, source AS document_id, doc_id AS chunk_index, round(score, 12) AS score FROM single UNION ALL SELECT query_id, source, doc_id, round(score, 12) FROM many),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM scored QUALIFY rank <= 8)
"""


@query(f"WITH {_WORDS_SQL}, {_RANK_SQL} SELECT query_id, document_id, chunk_index, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def fts_ranked_simple(spark: SparkSession, d: str) -> DataFrame:
    hits = S.fts_topk_ranked(_texts(spark, d).filter("chunk_index IS NOT NULL"), _word_queries(spark, d), analyzer="simple")
    return hits.withColumn("score", F.round("score", 9))


@query()
def fts_english(spark: SparkSession, d: str) -> DataFrame:
    return S.fts_topk_english(_texts(spark, d), _word_queries(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks: every vector and every text, joined where ids meet; texts without a vector belong to a tenth of the documents each."""
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_index"), F.col("label").cast("long").alias("label"), "embedding")
    texts = read_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return vectors.join(texts, "chunk_index", "full").select(F.coalesce("label", F.col("chunk_index") % 10).alias("document_id"), "chunk_index", "embedding", "content")


_STORED_VECTOR_SQL = f"""
    c AS (SELECT coalesce(CAST(label AS BIGINT), doc_id % 10) AS document_id, coalesce(vec_id, doc_id) AS chunk_index, embedding::DOUBLE[] AS e, text AS content FROM embeddings FULL JOIN documents ON vec_id = doc_id),
    v AS (SELECT document_id, arg_min(e, chunk_index) FILTER (WHERE e IS NOT NULL) AS v FROM c GROUP BY document_id),
    near_all AS (SELECT c.document_id, chunk_index, {_DISTANCE} AS distance FROM c JOIN v USING (document_id)),
    vec AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY distance ASC NULLS LAST, chunk_index) AS rank FROM near_all QUALIFY rank <= 8)
"""


def _asked(chunks: DataFrame) -> DataFrame:
    """Each document's first vector asks for its neighbours."""
    first = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("chunk_index")))
    return chunks.groupBy("document_id").agg(first.alias("vector")).withColumn("query_id", F.col("document_id"))


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """For every sentence of the passage that bears a document's number: vector hits and text hits in the document's chunks."""
    chunks = _stored(spark, d)
    words = _word_queries(spark, d).withColumn("document_id", F.floor(F.col("query_id") / 1000))
    vector = S.vector_topk_batch(chunks, _asked(chunks)).drop("query_id").join(words.select("query_id", "document_id"), "document_id")
    return vector, S.fts_topk(chunks, words)


_LEGS_SQL = r"""
    hq AS (SELECT query_id, query_id // 1000 AS document_id FROM q),
    legv AS (SELECT query_id, document_id, chunk_index, rank FROM vec JOIN hq USING (document_id)),
    ww AS (SELECT document_id, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS lexeme FROM c),
    wwc AS (SELECT document_id, chunk_index, lexeme, count(*) AS n FROM ww GROUP BY ALL),
    m AS (SELECT query_id, document_id, chunk_index, sum(wwc.n) AS hits FROM wwc JOIN ql ON wwc.lexeme = ql.lexeme AND ql.query_id // 1000 = wwc.document_id GROUP BY query_id, document_id, chunk_index, ql.n HAVING count(*) = ql.n),
    legt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, document_id, chunk_index) AS rank FROM m QUALIFY rank <= 8)
"""
#: The vector leg is cut to three, so that text hits show.
_MERGED_SQL = """
    shortv AS (SELECT * FROM legv WHERE rank <= 3),
    extra AS (SELECT query_id, document_id, chunk_index, 1 AS leg, rank FROM legt ANTI JOIN shortv USING (query_id, document_id, chunk_index)),
    both_legs AS (SELECT query_id, document_id, chunk_index, 0 AS leg, rank AS leg_rank FROM shortv UNION ALL SELECT query_id, document_id, chunk_index, leg, rank FROM extra),
    merged AS (SELECT query_id, document_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY leg, leg_rank) AS rank FROM both_legs QUALIFY rank <= 8)
"""


@query(f"WITH {_WORDS_SQL}, {_STORED_VECTOR_SQL}, {_LEGS_SQL} SELECT query_id, document_id, chunk_index, CAST(rank AS INTEGER) AS rank FROM legv")
def hybrid_reference(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_legs(*_legs(spark, d), fill=True)


@query(f"WITH {_WORDS_SQL}, {_STORED_VECTOR_SQL}, {_LEGS_SQL}, {_MERGED_SQL} SELECT query_id, document_id, chunk_index, CAST(rank AS INTEGER) AS rank FROM merged")
def hybrid_filled(spark: SparkSession, d: str) -> DataFrame:
    vector, text = _legs(spark, d)
    return S.merge_legs(vector.filter("rank <= 3"), text, fill=True)


@query(
    f"""WITH {_WORDS_SQL}, {_STORED_VECTOR_SQL}, {_LEGS_SQL},
    u AS (SELECT query_id, document_id, chunk_index, 1.0::DOUBLE / (60 + rank) AS part FROM legv UNION ALL SELECT query_id, document_id, chunk_index, 1.0::DOUBLE / (60 + rank) FROM legt),
    f AS (SELECT query_id, document_id, chunk_index, sum(part) AS score FROM u GROUP BY ALL)
    SELECT query_id, document_id, chunk_index, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_index, document_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return S.reciprocal_rank_fusion(list(_legs(spark, d))).withColumn("score", F.round("score", 9))


_HITS_SQL = f"WITH {_STORED_VECTOR_SQL}, h AS (SELECT vec.document_id AS query_id, vec.chunk_index, vec.rank, content FROM vec JOIN c ON c.document_id = vec.document_id AND c.chunk_index = vec.chunk_index)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = _stored(spark, d)
    return S.vector_topk_batch(chunks, _asked(chunks))


@query(_HITS_SQL + " SELECT query_id, coalesce(nullif(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), ''), 'No relevant content found.') AS context FROM h GROUP BY query_id")
def context_string(spark: SparkSession, d: str) -> DataFrame:
    return S.context(_hits(spark, d), ["query_id"], "rank")


@query(_HITS_SQL + " SELECT query_id, chunk_index, substring(content, 1, 400) AS content FROM h")
def citations(spark: SparkSession, d: str) -> DataFrame:
    rounds = _hits(spark, d).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return S.citations(rounds, ["query_id"], ["round", "rank"]).select("query_id", "chunk_index", "content")


@query("SELECT doc_id, substring(text, 1, 400) AS excerpt, substring(text, 1, 120) AS log_head, length(text) AS n FROM documents")
def text_heads(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", T.head(F.col("text"), 400).alias("excerpt"), T.head(F.col("text"), 120).alias("log_head"), F.length("text").cast("long").alias("n"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """documents with the status that their labels stand for."""
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("pending")
    return read_table(spark, d, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), status.alias("status"))


_DOCUMENTS_SQL = "WITH docs AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, source || '-' || d.doc_id || '.pdf' AS file_name, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels USING (doc_id))"


@query(_DOCUMENTS_SQL + " SELECT id, file_name FROM docs WHERE status = 'done'")
def ready_documents(spark: SparkSession, d: str) -> DataFrame:
    return L.ready(_documents(spark, d)).select("id", "file_name")


@query(_DOCUMENTS_SQL + " SELECT * FROM docs WHERE id = '42'")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    return L.lookup(_documents(spark, d), "42")


@query(
    _DOCUMENTS_SQL
    + """, r AS (SELECT conv_id, turn, CAST(conv_id * 3 AS VARCHAR) AS document_id, text AS message FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, document_id, CAST(CASE WHEN id IS NULL THEN 404 WHEN status <> 'done' OR trim(message) = '' THEN 400 END AS INTEGER) AS error_code FROM r LEFT JOIN docs ON id = document_id"""
)
def chat_preflight(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 3).cast("string").alias("document_id"), F.col("text").alias("message"))
    return L.preflight(asked, _documents(spark, d)).select("conv_id", "turn", "document_id", "error_code")


_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "image/jpeg", "image/webp", "text/x-python")


@query(
    f"""WITH u AS (SELECT doc_id, n_chars, [{", ".join(f"'{t}'" for t in _TYPES)}][doc_id % 6 + 1] AS content_type FROM documents),
    e AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' WHEN 4 THEN '.webp' END AS stored_ext FROM u)
    SELECT doc_id, stored_ext, CASE WHEN stored_ext IS NULL THEN 'Unsupported file type' WHEN n_chars * 1024 > 2 * 1024 * 1024 THEN 'File exceeds 2MB limit' END AS error FROM e"""
)
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    kind = F.array(*map(F.lit, _TYPES))[(F.col("doc_id") % 6).cast("int")]
    uploads = read_table(spark, d, "documents").select("doc_id", kind.alias("content_type"), (F.col("n_chars") * 1024).alias("length"))
    return validate(uploads, max_mb=2).select("doc_id", "stored_ext", "error")


_NAMES = ("scan.PNG", "no extension", ".hidden", "a.b.Webp", "archive.tar.gz", "x.", "text.docx", "Text.DOCX", "page.pdf")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose names and contents follow from the documents: whole texts as Word documents, a number as a PDF page."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                content = []
                for number, name, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    kind = name.lower().rpartition(".")[2]
                    content.append(docx_bytes((text or "").split("\n")) if kind == "docx" else pdf_bytes([f"page of {number}"]) if kind == "pdf" else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(content, pa.binary())], ["doc_id", "file_name", "content"])

    names = F.array(*map(F.lit, _NAMES))
    docs = read_table(spark, d, "documents").select("doc_id", names[(F.col("doc_id") % len(_NAMES)).cast("int")].alias("file_name"), "text")
    return docs.mapInArrow(write, "doc_id long, file_name string, content binary")


@query(
    f"""WITH f AS (SELECT doc_id, {list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS file_name, doc_id % {len(_NAMES)} AS kind, text AS body FROM documents)
    SELECT doc_id, file_name, CASE kind WHEN 0 THEN '.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.gz' WHEN 5 THEN '.' WHEN 6 THEN '.docx' WHEN 7 THEN '.docx' WHEN 8 THEN '.pdf' ELSE '' END AS extension,
        CASE WHEN kind IN (6, 7) THEN array_to_string(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: trim(x) <> ''), chr(10)) WHEN kind = 8 THEN 'page of ' || doc_id ELSE '[image: ' || file_name || ']' END AS text FROM f"""
)
def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return parse(_files(spark, d)).select("doc_id", "file_name", T.extension(F.col("file_name")).alias("extension"), "text")


_LOG_SQL = "WITH log AS (SELECT CAST(user_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'error ' || event_id WHEN event_type = 'error' THEN '' END AS error_msg FROM events)"
_MESSAGE_SQL = "CASE status WHEN 'done' THEN 'Document ready for Q&A.' WHEN 'failed' THEN coalesce(nullif(error_msg, ''), 'Ingestion failed.') ELSE 'Ingesting document...' END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a status log: users are documents."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("processing")
    error = F.when(status == "failed", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("error "), F.col("event_id").cast("string"))).otherwise(""))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), place.cast("long").alias("seq"), status.alias("status"), error.alias("error_msg"))


@query(_LOG_SQL + " SELECT document_id, arg_max(status, seq) AS status, arg_max(error_msg, seq) FILTER (WHERE TRUE) AS last_error FROM log GROUP BY document_id".replace("arg_max(error_msg, seq) FILTER (WHERE TRUE)", "list(error_msg ORDER BY seq DESC)[1]"))
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(_log(spark, d)).withColumnRenamed("error_msg", "last_error")


@query(_LOG_SQL + f", last AS (SELECT document_id, list(status ORDER BY seq DESC)[1] AS status, list(error_msg ORDER BY seq DESC)[1] AS error_msg FROM log GROUP BY document_id) SELECT document_id, status, {_MESSAGE_SQL} AS message FROM last")
def status_message(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(_log(spark, d)).select("document_id", "status", L.message(F.col("status"), F.col("error_msg")).alias("message"))


@query(_LOG_SQL + f", e AS (SELECT *, coalesce(sum(CASE WHEN status IN ('done', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM log) SELECT document_id, seq, status, {_MESSAGE_SQL} AS message FROM e WHERE ended = 0")
def status_events(spark: SparkSession, d: str) -> DataFrame:
    return L.told(_log(spark, d)).select("document_id", "seq", "status", "message")


@query(_LOG_SQL + """, b AS (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY seq) AS was FROM log)
    SELECT document_id, seq, CASE WHEN was IS NULL THEN status = 'pending' WHEN was = 'pending' THEN status = 'processing' WHEN was = 'processing' THEN status IN ('done', 'failed') WHEN was = 'failed' THEN status = 'processing' ELSE FALSE END AS allowed FROM b""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return L.allowed(_log(spark, d)).select("document_id", "seq", "allowed")


_CASES = ("What is the Corporate Name?", "Find the total in the document.", "what is?", "plugin document", "X???", "  ?  ", "TELL ME the sum from document?", "show me  the   rows", "what are the names in the document?", "what is the value of tax", "give me it", "")
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


#: The same rules as written for DuckDB, step by step: an opening, then "the", then "value of", then a closing with a mark before or after it.
_REWRITE_SQL = r"""
    q AS (SELECT text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {cases})),
    s AS (SELECT question, regexp_replace(question, '^\s+|\s+$', '', 'g') AS bare FROM q),
    o AS (SELECT *, regexp_replace(bare, '(?i)^(what\s+(is|are)|(tell|show|give)\s+me|find)\s+', '') AS cut FROM s),
    t AS (SELECT *, CASE WHEN cut <> bare THEN regexp_replace(cut, '(?i)^the\s+', '') ELSE bare END AS no_the FROM o),
    v AS (SELECT *, CASE WHEN regexp_matches(bare, '(?i)^what\s+is\s') THEN regexp_replace(no_the, '(?i)^value\s+of\s+', '') ELSE no_the END AS opened FROM t),
    c AS (SELECT *, regexp_replace(regexp_replace(opened, '(?i)[.?]?\s*((in|from)\s+(the\s+)?document)?[.?]?\s*$', ''), '^\s+|\s+$', '', 'g') AS core FROM v)
    SELECT question, CASE WHEN core = '' THEN bare ELSE core END AS core FROM c
"""


@query("WITH" + _REWRITE_SQL.replace("{cases}", ", ".join(f"('{c}')" for c in _CASES)))
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "conversations").filter("role = 'user'").select(F.col("text").alias("question"))
    cases = spark.createDataFrame([(c,) for c in _CASES], "question string")
    return asked.unionAll(cases).select("question", T.rewrite_question(F.col("question")).alias("core"))


#: Pieces by the coarsest separator that a piece of 1,000 characters or more holds, level by level; runs of pieces with
#: one parent fill windows of 1,000, and each window starts with what fits into 200 of the last one.
_CHUNK_SQL = (
    "p0 AS (SELECT doc_id, coalesce(text, '') AS piece, [0] AS path, [0] AS parent FROM documents), "
    + ", ".join(
        f"""p{k} AS (
        SELECT doc_id, CASE WHEN place = 1 OR NOT cut THEN part ELSE {sep} || part END AS piece, list_append(path, CAST(place AS INTEGER)) AS path, CASE WHEN cut THEN path ELSE parent END AS parent
        FROM (SELECT doc_id, path, parent, cut, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
              FROM (SELECT *, length(piece) >= 1000 AND contains(piece, {sep}) AS cut, CASE WHEN length(piece) >= 1000 AND contains(piece, {sep}) THEN string_split(piece, {sep}) ELSE [piece] END AS parts FROM p{k - 1})))"""
        for k, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "' '"), 1)
    )
    + f""",
    p4 AS (SELECT doc_id, unnest(parts) AS piece, list_append(path, CAST(generate_subscripts(parts, 1) AS INTEGER)) AS path, parent
           FROM (SELECT doc_id, path, CASE WHEN length(piece) >= 1000 THEN path ELSE parent END AS parent, CASE WHEN length(piece) >= 1000 THEN string_split(piece, '') ELSE [piece] END AS parts FROM p3)),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS place FROM p4 WHERE piece <> ''),
    turns AS (SELECT *, CASE WHEN parent = lag(parent) OVER (PARTITION BY doc_id ORDER BY place) THEN 0 ELSE 1 END AS turn FROM leaves),
    runs AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM turns),
    sums AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, run ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM runs),
    gathered AS (SELECT doc_id, run, list(piece ORDER BY place) AS pieces, list_concat([0::BIGINT], list(CAST(upto AS BIGINT) ORDER BY place)) AS q FROM sums GROUP BY doc_id, run),
    walk AS (
        SELECT doc_id, run, pieces, q, 1 AS s, len(list_filter(q, lambda x: x <= 1000)) - 1 AS e FROM gathered
        UNION ALL
        SELECT doc_id, run, pieces, q, s, len(list_filter(q, lambda x: x <= q[s] + 1000)) - 1 AS e
        FROM (SELECT doc_id, run, pieces, q, CAST(greatest(s, len(list_filter(q, lambda x: x < greatest(q[e + 1] - 200, q[e + 2] - 1000))) + 1) AS INTEGER) AS s FROM walk WHERE e < len(pieces))
    ),
    cut_out AS (SELECT doc_id, run, s, {_STRIP.format("array_to_string(pieces[s:e], '')")} AS content FROM walk),
    chunks AS (SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, s) - 1 AS INTEGER) AS chunk_index, content FROM cut_out WHERE content <> '')"""
)


@query(f"WITH RECURSIVE {_CHUNK_SQL} SELECT * FROM chunks")
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return chunk_documents(read_table(spark, d, "documents"))


@query(f"WITH RECURSIVE {_CHUNK_SQL} SELECT document_id, count(*) AS n_chunks, CAST(max(length(content)) AS INTEGER) AS longest, CAST(ceil(count(*) / 100) AS BIGINT) AS batches FROM chunks GROUP BY document_id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_documents(read_table(spark, d, "documents"))
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("content")).alias("longest"), T.batch_count(F.count(F.lit(1))).alias("batches"))


@query("SELECT doc_id // 100 + 1 AS batch, count(*) AS n, min(doc_id) AS first_id, CAST(ceil(max(doc_id) / 100) AS BIGINT) AS batches_before FROM documents GROUP BY doc_id // 100 + 1")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").withColumn("batch", T.batch_number(F.col("doc_id")))
    return docs.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), T.batch_count(F.max("doc_id")).alias("batches_before"))


@query(
    f"""WITH RECURSIVE {_CHUNK_SQL},
    words AS (SELECT document_id, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS word FROM chunks),
    hashed AS (SELECT document_id, chunk_index, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM words),
    slots AS (SELECT document_id, chunk_index, CAST(h % 64 AS INTEGER) AS slot, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM hashed GROUP BY ALL),
    lengths AS (SELECT document_id, chunk_index, sqrt(sum(v * v)) AS size FROM slots GROUP BY ALL)
    SELECT document_id, chunk_index, slot, round(CAST(CAST(v / size AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM slots JOIN lengths USING (document_id, chunk_index) WHERE v <> 0"""
)
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all chunks, slot by slot where they aren't zero."""
    chunks = chunk_documents(read_table(spark, d, "documents"))
    vectors = embed_chunks(chunks.repartition("document_id", "chunk_index"), lambda: HashingEmbedder(64), width=64)
    slots = vectors.select("document_id", "chunk_index", F.posexplode("embedding").alias("slot", "value"))
    return slots.filter("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5) + F.lit(0.0))


@query("SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return S.first_seen(read_table(spark, d, "conversations"), ["conv_id", "text"], ["turn"]).select("conv_id", "text", "turn")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as tokens of their conversation, user turns as citations, system turns as the end."""
    kind = F.when(F.col("role") == "assistant", "token").when(F.col("role") == "system", "done").otherwise("citations")
    chunk = F.array(F.struct(F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content")))
    return read_table(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), kind.alias("type"), F.when(kind == "token", F.col("text")).alias("content"), F.when(kind == "citations", chunk).alias("chunks"), F.lit(None).cast("string").alias("message"))


_FOLD_SQL = """
    WITH ends AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'system') AS last FROM conversations GROUP BY conv_id),
    heard AS (SELECT c.* FROM conversations c JOIN ends e USING (conv_id) WHERE last IS NULL OR turn < last),
    said AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant' AND text <> '') AS content, max(turn) FILTER (WHERE role = 'user') AS cited, arg_max(text, turn) FILTER (WHERE role = 'user') AS excerpt FROM heard GROUP BY conv_id)
    SELECT e.conv_id AS message_id, coalesce(content, '') AS content, CAST(cited AS INTEGER) AS cited, excerpt, last IS NULL AS streaming, FALSE AS error FROM ends e LEFT JOIN said USING (conv_id)
"""


def _folded(messages: DataFrame) -> DataFrame:
    first = F.try_element_at("citations", F.lit(1))
    return messages.select("message_id", "content", first["chunk_index"].alias("cited"), first["content"].alias("excerpt"), "streaming", "error")


@query(_FOLD_SQL)
def message_fold(spark: SparkSession, d: str) -> DataFrame:
    return _folded(M.fold(_events(spark, d)))


@query(_FOLD_SQL)
def message_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same messages from the events as a stream; what it has told last of each."""
    folder = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    _events(spark, d).write.parquet(f"{folder}/events")
    arriving = spark.readStream.schema(spark.read.parquet(f"{folder}/events").schema).parquet(f"{folder}/events")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/told/number={number}")

    fold_stream(arriving).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{folder}/told").withColumn("message_id", F.col("message_id").cast("long"))
    return _folded(told.groupBy("message_id").agg(F.max_by(F.struct("content", "citations", "streaming", "error"), "batch").alias("last")).select("message_id", "last.*"))


@query("SELECT conv_id, turn, 'token' AS type, text AS content FROM conversations WHERE role = 'assistant'")
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    event = F.to_json(F.struct(F.lit("token").alias("type"), F.col("text").alias("content")))
    framed = read_table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit(": note\ndata: {broken\ndata: "), event, F.lit("\n\n")).alias("frame"))
    return M.parse_frames(framed).select("conv_id", "turn", "event.type", "event.content")


_MARKED = ("1. **Name**: Ada", "", "2.  **Born**:  1815", "plain **bold** and **more**", "3. **Again**: x **y**", "   ", "4. no bold", "**alone**")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    talk = read_table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("\n".join(_MARKED) + "\n"), F.coalesce("text", F.lit(""))).alias("message"))
    return M.markup_lines(M.split_lines(talk, "message"))


_LINES_SQL = (
    "WITH t AS (SELECT conv_id, turn, unnest(string_split('"
    + "\n".join(_MARKED)
    + "' || chr(10) || coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split('"
    + "\n".join(_MARKED)
    + r"""' || chr(10) || coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM conversations),
    m AS (SELECT *, regexp_matches(line, '^(\d+)\.\s+\*\*(.+?)\*\*[:]\s*(.*)$') AS item FROM t WHERE trim(line) <> ''),
    k AS (SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, CASE WHEN item THEN 'item' ELSE 'paragraph' END AS kind,
        CASE WHEN item THEN regexp_extract(line, '^(\d+)\.\s+\*\*(.+?)\*\*[:]\s*(.*)$', 2) || ':' END AS label,
        CASE WHEN item THEN regexp_extract(line, '^(\d+)\.\s+\*\*(.+?)\*\*[:]\s*(.*)$', 3) ELSE regexp_replace(line, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') END AS body FROM m)"""
)


@query(_LINES_SQL + " SELECT * FROM k")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).drop("line")


@query(_LINES_SQL + ", s AS (SELECT *, CASE WHEN kind = 'item' AND lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY line_no) = 'item' THEN 0 ELSE 1 END AS starts FROM k) SELECT conv_id, turn, line_no, kind, CAST(sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM s")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return M.markup_blocks(_lines(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "line_no", "kind", "block")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    parents = read_table(spark, d, "documents").filter("lang = 'en'")
    return orphans(read_table(spark, d, "labels"), parents, "doc_id", "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    deleted = read_table(spark, d, "documents").filter("source = 'src0'").select("doc_id")
    return delete_cascade(read_table(spark, d, "labels"), deleted, "doc_id").select("doc_id", "quality")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def fetch_back(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "labels").filter("toxic = 1")
    return S.fetch(read_table(spark, d, "documents"), ids, ["doc_id"]).select("doc_id", "lang")


@query(
    "SELECT conv_id, count(*) AS n, CASE count(*) WHEN 1 THEN 'source' ELSE 'sources' END AS noun, CAST(sum(length(text)) AS BIGINT) AS n_chars, '#' || (max(turn) + 1) AS last_label, bool_or(role = 'assistant') AS any_answer FROM conversations GROUP BY conv_id"
)
def message_counts(spark: SparkSession, d: str) -> DataFrame:
    talk = read_table(spark, d, "conversations").groupBy("conv_id")
    return talk.agg(F.count(F.lit(1)).alias("n"), T.plural(F.count(F.lit(1)), "source").alias("noun"), F.sum(F.length("text")).alias("n_chars"), T.ordinal_label(F.max("turn")).alias("last_label"), F.bool_or(F.col("role") == "assistant").alias("any_answer"))


@query("SELECT CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS n_documents FROM documents GROUP BY 1")
def chunk_buckets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").groupBy(bucket(F.col("doc_id")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_documents"))
