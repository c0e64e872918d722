"""Token-id files with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents, one after the other, and two Elias-Fano sequences:
where each document ends, and the documents' ids.  No 64-bit table is stored: a non-decreasing
sequence of n values below u takes about n(2 + log2(u/n)) bits, and a select structure over its
unary half (the place of every 256th one, in as few bytes as needed) returns any entry directly.

Layout of a shard, all little-endian::

    FLTOKEF1 | ids (2 or 4 bytes each) | ends: low, high, samples | doc_ids: low, high, samples | trailer

The trailer has fixed size and says where the sections are, so that writing needs one pass.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fan_out, file_system, materialise, portions, put_file, text_of, work_dir
from .tokens import encoder

MAGIC = b"FLTOKEF1"
SAMPLE = 256
#: documents, null doc_ids at the start, ids, bytes of an id, least doc_id; then for each sequence: n, low bits, bytes of low, high and samples, bytes of a sample.
_TRAILER = struct.Struct("<QQQQq" + "QQQQQQ" * 2 + "8s")


class EliasFano:
    """A non-decreasing sequence of unsigned integers; ``select(i)`` reads one entry."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        samples = ones[::SAMPLE]
        width = next(w for w in (1, 2, 4, 8) if not n or int(ones[-1]) < 1 << (8 * w))
        return cls(n, low_bits, np.packbits(bits, bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), samples.astype(f"<u{width}"))

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        block = at // 64
        here = self._block(block) >> (at % 64) << (at % 64)
        while (count := here.bit_count()) <= left:
            left -= count
            block += 1
            here = self._block(block)
        for _ in range(left):
            here &= here - 1
        one = 64 * block + (here & -here).bit_length() - 1
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return (one - i) << self.low_bits | word >> first % 8 & (1 << self.low_bits) - 1

    def _block(self, block: int) -> int:
        """64 bits of the unary half."""
        return int.from_bytes(self.high[8 * block : 8 * block + 8], "little")

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low, self.high, self.samples.tobytes()

    def head(self) -> tuple[int, ...]:
        return (self.n, self.low_bits, *map(len, self.parts()), self.samples.dtype.itemsize)


class ShardReader:
    """Reads a shard through a file that can seek; holds its boundaries, never its ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - _TRAILER.size)
        self.n_docs, self.nulls, self.n_ids, self.width, self.least, *rest, magic = _TRAILER.unpack(file.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(len(MAGIC) + self.n_ids * self.width)
        self.ends, self.ids = (self._sequence(rest[k : k + 6]) for k in (0, 6))

    def _sequence(self, head: list[int]) -> EliasFano:
        n, low_bits, low, high, samples, width = head
        return EliasFano(n, low_bits, self.file.read(low), self.file.read(high), np.frombuffer(self.file.read(samples), f"<u{width}"))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.ids.select(i - self.nulls) + self.least

    def span(self, i: int) -> tuple[int, int]:
        """The first id of document ``i`` and the one after its last, counted in the shard."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(len(MAGIC) + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}").astype("<u4")

    def documents(self, block_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start, length and crc32 of each document's ids as uint32; boundaries by select, ids read in blocks."""
        lo, block, end = 0, self.read(0, min(block_ids, self.n_ids)), 0
        for i in range(self.n_docs):
            doc, start, end = self.doc_id(i), end, self.ends.select(i)
            crc, at = 0, start
            while at < end:
                if at >= lo + len(block):
                    lo, block = at, self.read(at, min(at + block_ids, self.n_ids))
                part = block[at - lo : end - lo]
                crc, at = zlib.crc32(part.tobytes(), crc), at + len(part)
            yield doc, start, end - start, crc


def write_shard(out, documents: Iterator[tuple[int | None, bytes | np.ndarray]], id_bytes: int) -> tuple[int, int]:
    """Write documents (ids as uint32, or their bytes), nulls first and then by doc_id; gives documents and ids."""
    out.write(MAGIC)
    names, ends, nulls, total = [], [], 0, 0
    for doc, ids in documents:
        part = np.frombuffer(ids, "<u4")
        out.write(part.astype(f"<u{id_bytes}").tobytes())
        total += len(part)
        ends.append(total)
        if doc is None:
            nulls += 1
        else:
            names.append(doc)
    least = names[0] if names else 0
    ef = EliasFano.of(np.array(ends, np.uint64)), EliasFano.of((np.array(names, np.int64) - least).astype(np.uint64))
    for sequence in ef:
        for part in sequence.parts():
            out.write(part)
    out.write(_TRAILER.pack(len(ends), nulls, total, id_bytes, least, *ef[0].head(), *ef[1].head(), MAGIC))
    return len(ends), total


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents and write shards in ascending doc_id order; gives the manifest.

    Manifest: shard int, path string, n_docs long, n_ids long, first_id long (ids in all shards
    before).  Null doc_ids come first, equal doc_ids by text; null text is empty; an empty table has
    no shards.  Documents are range-partitioned by doc_id before they are encoded, so that
    sampling the ranges costs a scan and not an encoding.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer_path)
        id_bytes = 2 if max(code.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        shard, told = TaskContext.get().partitionId(), []
        rows = ((doc, np.append(ids, end)) for b in portions(batches, "text") for doc, ids in zip(b.column(0).to_pylist(), code.encode_many(b.column(1)), strict=True))
        if (first := next(rows, None)) is None:
            return
        fs, path = file_system(f"{folder}/shard-{shard:08d}.tok")
        put_file(fs, path, lambda out: told.append(write_shard(out, _chain(first, rows), id_bytes)))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/shard-{shard:08d}.tok", "n_docs": told[0][0], "n_ids": told[0][1]}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # rows that share an id are told apart by their text's head, so that an id many rows share is not one shard
    order = F.col("doc_id").asc_nulls_first()
    by_range = rows.repartitionByRange(shards or fan_out(spark), order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
    manifest = materialise(by_range.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _chain(first, rest):
    yield first
    yield from rest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as file:
                    rows: list[tuple] = []
                    for doc, start, n, crc in ShardReader(file).documents():
                        rows.append((doc, first + start, n, crc))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return manifest.select("path", "first_id").repartition(fan_out(manifest.sparkSession), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_to_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder, then read them back, boundaries through select.

    A row a document: doc_id, start, n_tokens, ids_crc32.  Null and empty texts are the end id alone; texts
    of any length are encoded whole; null doc_ids come first, and rows that share an id are documents
    of their own, by text; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, work_dir(docs.sparkSession, "tokens"), end_id=end_id))
