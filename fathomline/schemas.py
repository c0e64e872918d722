"""Schemas of the stored tables and of the rows that travel; never inferred."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_msg", T.StringType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    ]
)
#: Append-only log of status changes; seq orders a document's changes.
STATUS_LOG = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_msg", T.StringType()),
    ]
)
CITATION = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
CHAT_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("chunks", T.ArrayType(CITATION)),
        T.StructField("message", T.StringType()),
    ]
)
STATUSES = ("pending", "processing", "done", "failed")
