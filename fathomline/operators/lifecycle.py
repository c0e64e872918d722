"""Documents' way from upload to readiness, as an append-only log of status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_default, is_blank

#: What a status tells a client.
READY, FAILED, WORKING = "Document ready for Q&A.", "Ingestion failed.", "Ingesting document..."
#: The changes that a document may make; failed documents are tried once more.
CHANGES = {"pending": ("processing",), "processing": ("done", "failed"), "failed": ("processing",), "done": ()}


class NotFound(LookupError):
    """No such document."""


class NotReady(ValueError):
    """The document can't be asked yet."""


def latest(log: DataFrame) -> DataFrame:
    """document_id, status and error_msg of each document's last change; partial maxima before the shuffle."""
    last = F.max_by(F.struct("status", "error_msg"), F.col("seq"))
    return log.groupBy("document_id").agg(last.alias("last")).select("document_id", "last.status", "last.error_msg")


def message(status: Column, error: Column) -> Column:
    """What a client is told: a missing document counts as failed, an empty error has the standard text."""
    state = F.coalesce(status, F.lit("failed"))
    return F.when(state == "done", READY).when(state == "failed", falsy_default(error, FAILED)).otherwise(WORKING)


def told(log: DataFrame) -> DataFrame:
    """The changes that a client sees: up to and with the first terminal one of each document.

    The first terminal change is aggregated before the shuffle, so a document with very many
    changes isn't gathered; its rows may be split over tasks when they meet it.
    """
    ends = log.filter(F.col("status").isin("done", "failed")).groupBy("document_id").agg(F.min("seq").alias("last_seq"))
    seen = log.join(ends, "document_id", "left").filter("last_seq is null or seq <= last_seq").drop("last_seq")
    return seen.withColumn("message", message(F.col("status"), F.col("error_msg")))


def allowed(log: DataFrame) -> DataFrame:
    """The log with ``allowed``: whether each change may follow the one before (a first one is pending)."""
    before = F.lag("status").over(Window.partitionBy("document_id").orderBy("seq"))
    legal = F.when(before.isNull(), F.col("status") == "pending")
    for old, new in CHANGES.items():
        legal = legal.when(before == old, F.col("status").isin(*new) if new else F.lit(False))
    return log.withColumn("allowed", F.coalesce(legal, F.lit(False)))


def lookup(documents: DataFrame, document_id: str) -> DataFrame:
    """The document of an id; any text is a legal id and may find nothing."""
    return documents.filter(F.col("id") == document_id).limit(1)


def ready(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "done")


def require_ready(documents: DataFrame, document_id: str) -> None:
    row = lookup(documents, document_id).first()
    if row is None:
        raise NotFound("Document not found")
    if row["status"] != "done":
        raise NotReady("Document not ready for querying")


def preflight(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests`` (document_id, message) with error_code: 404 unknown, 400 not ready or blank, null where it may go on."""
    known = documents.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"))
    code = F.when(F.col("document_status").isNull(), 404).when((F.col("document_status") != "done") | (F.trim("message") == ""), 400)
    return requests.join(known, "document_id", "left").withColumn("error_code", code).drop("document_status")


def can_send(text: Column, document_id: Column, pending: Column) -> Column:
    """Whether a client may send: a message that isn't blank, a chosen document, and no answer under way."""
    return F.coalesce(~is_blank(text) & document_id.isNotNull() & ~pending, F.lit(False))


def client_state(status: Column) -> Column:
    """What an uploading client shows for a stored status; nothing chosen is idle, stored but not begun is uploading."""
    return F.when(status.isNull(), "idle").when(status == "pending", "uploading").otherwise(status)
