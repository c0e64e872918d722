"""Shared pieces of the corpus operators: work folders, files, text columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: the folder below which work folders lie while a ``scratch`` is open.
_SCOPE = "fathomline.work.scope"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, in a folder of the application.

    On a cluster without that setting this is an error; in one local process (tests) a local folder is
    chosen.  ``scratch`` and ``remove_work`` delete what operators have written.
    """
    ship_package(spark)
    return f"{spark.conf.get(_SCOPE, None) or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Work folders that are made inside are deleted at the end; what must stay has to be written elsewhere by then."""
    folder, before = work_dir(spark, name), spark.conf.get(_SCOPE, None)
    spark.conf.set(_SCOPE, folder)
    try:
        yield
    finally:
        if before:
            spark.conf.set(_SCOPE, before)
        else:
            spark.conf.unset(_SCOPE)
        delete_folder(spark, folder)


def remove_work(spark: SparkSession) -> None:
    """Delete this application's work folders; results that weren't stored elsewhere can't be read any more."""
    delete_folder(spark, shared_folder(spark))


def free_name(base: str, *taken: str) -> str:
    """A column name that none of ``taken`` equals, in any case."""
    used, name = {t.lower() for t in taken}, base
    while name.lower() in used:
        name += "_"
    return name


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; executors reach shared folders through it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def put_file(fs: pafs.FileSystem, path: str, write) -> None:
    """Write a whole file under a name of its own and move it into place.

    A task that is run twice (a lost executor, speculation) replaces the file by the same bytes.
    """
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        write(out)
    fs.move(temp, path)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def give_back() -> None:
    """Return what a finished task has freed to the system: workers live on, and allocators keep their peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into smaller ones, so that Python objects of few rows live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)
    give_back()


def portions(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a text column has about ``max_bytes`` in each (a longer text is alone)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = min(max_rows, max(1, int(np.searchsorted(ends, before + max_bytes, "right")) - at))
            yield batch.slice(at, n)
            at += n
    give_back()


def fan_out(spark: SparkSession) -> int:
    """How many partitions a wide step should have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
