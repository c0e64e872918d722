"""Ingestion as a stream: pending documents in, chunks and status changes out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..functions.chunking import chunk_documents
from ..functions.embedding import Embedder, embed_chunks
from ..schemas import STATUS_LOG
from ..sources.tables import write_chunks
from ..sources.uploads import parse


def _log(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(f.name).cast(f.dataType) for f in STATUS_LOG]).write.mode("append").parquet(path)


def _store(parsed: DataFrame, chunk_path: str, make_embedder: Callable[[], Embedder], width: int, settings: Settings) -> DataFrame:
    """Chunk, embed and store what was parsed; gives (document_id, error) of the documents that could not be embedded."""
    chunks = chunk_documents(parsed.filter("error is null"), size=settings.chunk_size, overlap=settings.chunk_overlap, id_col="id")
    # one long document must not keep a task busy: chunks are dealt out before they are embedded
    dealt = chunks.repartition("document_id", "chunk_index")
    embedded = embed_chunks(dealt, make_embedder, width=width, batch=settings.embed_batch, error_by="document_id", error_chars=settings.error_chars).persist()
    try:
        errors = embedded.filter("embed_error is not null").groupBy("document_id").agg(F.min("embed_error").alias("embed_error"))
        told = [(r["document_id"], r["embed_error"]) for r in errors.collect()]  # a row a failed document of this batch
        errors = parsed.sparkSession.createDataFrame(told, "document_id string, embed_error string")
        whole = parsed.filter("error is null").select(F.col("id").cast("string").alias("document_id")).join(errors, "document_id", "left_anti")
        write_chunks(embedded.drop("embed_error").join(errors, "document_id", "left_anti"), chunk_path, width=width, ids=whole)
        return errors
    finally:
        embedded.unpersist()


def ingest_batch(files: DataFrame, *, log_path: str, chunk_path: str, make_embedder: Callable[[], Embedder], width: int, settings: Settings | None = None, first_seq: int = 1, wait: Callable[[float], None] = time.sleep) -> None:
    """Take files (id, file_name, content) from pending to done or failed.

    Every document's changes are appended in order: processing, then done or failed; a failed one is
    tried once more after a pause, whatever failed: parsing or embedding (told of the document alone) or
    storing (told of all documents of the batch, as they are stored together).  The log holds the head of
    the error.  A blank document has no chunks and is done; chunks that it had before go.  Chunk ids
    follow from their place and a document's chunks are replaced as a whole, so a batch that is run
    twice leaves the same table.
    """
    settings = settings or Settings()
    waiting, seq = files.select("id", "file_name", "content"), first_seq
    for attempt in range(settings.retries + 1):
        _log(waiting.select(F.col("id").alias("document_id"), F.lit(seq).alias("seq"), F.lit("processing").alias("status"), F.lit(None).alias("error_msg")), log_path)
        parsed = parse(waiting, error_chars=settings.error_chars).persist()
        try:
            ids = parsed.select(F.col("id").cast("string").alias("document_id"), F.col("error"))
            try:
                errors = _store(parsed, chunk_path, make_embedder, width, settings)
                ends = ids.join(errors, "document_id", "left").select("document_id", F.coalesce("error", "embed_error").alias("error"))
            except Exception as error:  # told to every document that was to be stored
                ends = ids.select("document_id", F.coalesce("error", F.lit((str(error) or type(error).__name__)[: settings.error_chars])).alias("error"))
            _log(ends.select("document_id", F.lit(seq + 1).alias("seq"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.col("error").alias("error_msg")), log_path)
            # names of the failed documents of this batch, which lies in one task's memory as it is
            failed = [r["document_id"] for r in ends.filter("error is not null").select("document_id").collect()]
        finally:
            parsed.unpersist()
        if attempt == settings.retries or not failed:
            return
        wait(settings.retry_seconds)
        waiting, seq = waiting.filter(F.col("id").cast("string").isin(failed)), seq + 2


def ingest_stream(files: DataFrame, *, log_path: str, chunk_path: str, checkpoint: str, make_embedder: Callable[[], Embedder], width: int, settings: Settings | None = None) -> StreamingQuery:
    """Ingest a stream of files batch by batch, as far as there are any; ``checkpoint`` remembers which have been taken."""

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(batch, log_path=log_path, chunk_path=chunk_path, make_embedder=make_embedder, width=width, settings=settings)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
