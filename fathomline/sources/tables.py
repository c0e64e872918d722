"""Stored tables: schemas checked on write, idempotent chunk writes, integrity without a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import checked_width
from ..schemas import CHUNKS, STATUSES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """An id that follows from the chunk's place, so that a repeated write makes no second chunk."""
    return F.sha2(F.concat_ws("#", document_id.cast("string"), chunk_index.cast("string")), 256)


def chunk_rows(chunks: DataFrame, width: int) -> DataFrame:
    """Chunks in the stored schema; a vector of another width is an error, a null one is not."""
    columns = [chunk_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", "chunk_index", "content", checked_width("embedding", width).alias("embedding")]
    ready = chunks.select(*columns)
    return ready.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in CHUNKS])


def write_chunks(chunks: DataFrame, path: str, *, width: int, ids: DataFrame | None = None) -> None:
    """Write whole documents' chunks; a document that was there before is replaced, others stay.

    ``ids`` (document_id) names the documents that are written, those that have no chunks any more
    included; without it they are the documents of ``chunks``.  The table is partitioned by the
    document's hash bucket, so a document's chunks lie together and a reader of one document opens few files.
    """
    spark = chunks.sparkSession
    rows = chunk_rows(chunks, width).withColumn("bucket", bucket(F.col("document_id")))
    if not _exists(spark, path):
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return
    replaced = (rows if ids is None else ids).select(F.col("document_id").cast("string")).distinct()
    old = spark.read.schema(rows.schema).parquet(path)
    # untouched documents of the touched buckets are written again beside the new ones
    touched = replaced.select(bucket(F.col("document_id")).alias("bucket")).distinct()
    others = old.join(F.broadcast(touched), "bucket", "left_semi").join(replaced, "document_id", "left_anti")
    staged = f"{path.rstrip('/')}-staged"
    rows.unionByName(others.select(*rows.columns)).repartition("bucket").write.mode("overwrite").parquet(staged)
    both = spark.read.schema(rows.schema).parquet(staged)
    for number in sorted({r["bucket"] for r in touched.collect()} - {r["bucket"] for r in both.select("bucket").distinct().collect()}):
        delete_path(spark, f"{path.rstrip('/')}/bucket={number}")
    both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


#: Folders of the chunk table; the list of touched ones, at most this many, is broadcast.
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucket(document_id: Column) -> Column:
    """The first 32 bits of the id's MD5, by the number of folders: a rule that any engine can follow."""
    return (F.conv(F.substring(F.md5(document_id.cast("string")), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def read_chunks(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """The chunk table, or one document of it: the bucket prunes folders."""
    # the schema is told, as a table that has lost its last chunk has no file to tell it
    table = spark.read.schema(T.StructType([*CHUNKS, T.StructField("bucket", T.IntegerType())])).parquet(path)
    if document_id is None:
        return table.drop("bucket")
    number = spark.range(1).select(bucket(F.lit(document_id)).alias("b")).first()["b"]
    return table.filter((F.col("bucket") == number) & (F.col("document_id") == document_id)).drop("bucket")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent isn't there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left of the children when parents are deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def check_status(status: Column) -> Column:
    """The status, or an error for one that isn't known."""
    return F.when(F.assert_true(status.isin(*STATUSES), F.lit("unknown status")).isNull(), status)


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables in the stored schemas."""
    from ..schemas import DOCUMENTS, STATUS_LOG

    for name, schema in (("documents", DOCUMENTS), ("document_chunks", CHUNKS), ("status_log", STATUS_LOG)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")


def drop_tables(spark: SparkSession, folder: str) -> None:
    """Remove the tables that ``create_tables`` makes."""
    for name in ("document_chunks", "status_log", "documents"):
        delete_path(spark, f"{folder}/{name}.parquet")
