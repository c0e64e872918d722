"""The whole application over one folder: upload, ingest, list, watch, chat."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agent import ChatModel, chat
from .config import Settings
from .functions.embedding import Embedder
from .operators import lifecycle
from .operators.messages import frame
from .schemas import STATUS_LOG
from .sources.tables import create_tables, delete_path, read_chunks, read_table
from .sources.uploads import ACCEPTED, parse_pending
from .streaming.ingest import ingest_batch
from .streaming.status import watch


class Rejected(ValueError):
    """An upload that isn't accepted."""


class DocumentService:
    """Tables below ``root``: documents, status_log, document_chunks, and the files that were uploaded."""

    def __init__(self, spark: SparkSession, root: str, make_embedder: Callable[[], Embedder], width: int, settings: Settings | None = None):
        self.spark, self.root, self.make_embedder, self.width = spark, root.rstrip("/"), make_embedder, width
        self.settings = settings or Settings()
        self.chunk_path, self.log_path = f"{self.root}/chunks", f"{self.root}/status_log.parquet"
        create_tables(spark, self.root)

    def _log(self, document_id: str, status: str) -> None:
        self.spark.createDataFrame([(document_id, 0, status, None)], STATUS_LOG).write.mode("append").parquet(self.log_path)

    def upload(self, file_name: str, content_type: str, content: bytes) -> dict[str, str]:
        """Store one file as pending; its type is checked before its size."""
        if content_type not in ACCEPTED:
            raise Rejected("Unsupported file type")
        if len(content) > self.settings.max_upload_bytes:
            raise Rejected(f"File exceeds {self.settings.max_upload_mb}MB limit")
        document_id = str(uuid.uuid4())
        path = f"{self.root}/files/{document_id}{ACCEPTED[content_type]}"
        # the file first: a row never names a file that isn't there; and no file stays that no row names
        try:
            self.spark.createDataFrame([(document_id, file_name, bytearray(content))], "id string, file_name string, content binary").coalesce(1).write.parquet(path)
            self._add_row(document_id, file_name, path)
        except Exception:
            delete_path(self.spark, path)
            raise
        self._log(document_id, "pending")
        return {"id": document_id, "file_name": file_name, "status": "pending"}

    def _add_row(self, document_id: str, file_name: str, path: str) -> None:
        row = self.spark.createDataFrame([(document_id, file_name, path)], "id string, file_name string, file_path string")
        stamped = row.select("*", F.current_timestamp().alias("uploaded_at"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"))
        stamped.write.mode("append").parquet(f"{self.root}/documents.parquet")

    def documents(self) -> DataFrame:
        """All documents with the status that the log gives them."""
        stored = read_table(self.spark, self.root, "documents").drop("status", "error_msg")
        last = lifecycle.latest(self.spark.read.schema(STATUS_LOG).parquet(self.log_path)).withColumnRenamed("document_id", "id")
        return stored.join(last, "id", "left")

    def ready(self) -> DataFrame:
        return lifecycle.ready(self.documents()).select("id", "file_name", "uploaded_at")

    def ingest_pending(self) -> None:
        """Take every pending document to done or failed, and those that an earlier run left in processing when it was cut off.

        Runs don't overlap: one service ingests at a time.
        """
        waiting = self.documents().filter("coalesce(status, 'pending') in ('pending', 'processing')").select("id", "file_path")
        paths = [r["file_path"] for r in waiting.collect()]
        if paths:
            last = self.spark.read.schema(STATUS_LOG).parquet(self.log_path).agg(F.max("seq").alias("seq")).first()["seq"]
            ingest_batch(parse_pending(self.spark, paths), first_seq=(last or 0) + 1, log_path=self.log_path, chunk_path=self.chunk_path, make_embedder=self.make_embedder, width=self.width, settings=self.settings)

    def status(self, document_id: str, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
        """Frames of a document's status, one a poll, up to the first terminal one; an unknown document is an error."""
        if lifecycle.lookup(self.documents(), document_id).isEmpty():
            raise lifecycle.NotFound("Document not found")

        def polls() -> Iterator[tuple[str, str | None]]:
            while True:
                row = lifecycle.lookup(self.documents(), document_id).first()
                yield ("failed", None) if row is None else (row["status"], row["error_msg"])
                sleep(self.settings.poll_seconds)

        return map(frame, watch(polls()))

    def chat(self, document_id: str, question: str, model: ChatModel) -> Iterator[str]:
        documents = self.documents()
        lifecycle.require_ready(documents, document_id)
        return chat(documents, read_chunks(self.spark, self.chunk_path), document_id, question, model, self.make_embedder(), self.settings)

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}
