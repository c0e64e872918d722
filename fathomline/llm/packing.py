"""Packing documents into token windows: best-fit decreasing over a segment tree of capacities.

A document (its ids and one end id) longer than a window is first cut into full windows; what is
left of it, and every shorter document, is one item.  Items are packed largest first into the open
window that they fit most tightly.  Open windows are found in a segment tree indexed by remaining
capacity: the leftmost leaf at or above an item's length that holds a window.

Only piece rows travel: documents are encoded where they are read, and a piece is its place, its
length and a checksum.  Pieces are dealt evenly to packing groups, each a bounded number of items
that one task packs in memory, so that neither a task's memory nor its time grows with the corpus.
A group wastes about the square root of its items in windows at most, so groups are large.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, portions, text_of, work_dir
from .tokens import encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"
#: Group numbers stand above this bit of a sequence id, windows of the group below.
GROUP_BIT = 32


class CapacityTree:
    """Open windows by remaining capacity, 1 to ``size``; a node knows whether any leaf below holds one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.held = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = capacity + self.leaves
        while node and not self.held[node]:
            self.held[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with at least this capacity, taken out of the tree."""
        node, held = least + self.leaves, self.held
        if not held[node]:
            while node > 1 and (node & 1 or not held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not held[2 * node])
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            held[node] = 0
            node >>= 1
            while node and not (held[2 * node] or held[2 * node + 1]):
                held[node] = 0
                node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item the window it goes to, and its offset there.  Lengths are 1 to ``window``."""
    tree, opened = CapacityTree(window), 0
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if found := tree.take(n):
            capacity, at = found
        else:
            capacity, at, opened = window, opened, opened + 1
        place[item], offset[item] = at, window - capacity
        if capacity > n:
            tree.put(capacity - n, at)
    return place, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: full windows, then what is left; each id lies in one piece."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in portions(batches, "text"):
            rows: list[list] = [[], [], [], [], []]
            for doc, text_ids in zip(batch.column(0).to_pylist(), code.encode_many(batch.column(1)), strict=True):
                ids = np.append(text_ids, end)
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for column, value in zip(rows, (doc, at, len(piece), zlib.crc32(piece), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, *, window: int = 2048, group_items: int = 20_000) -> DataFrame:
    """Give every piece a sequence and an offset there.

    Pieces are dealt round-robin (Spark sorts rows first, so a repeated task deals alike) to
    groups of about ``group_items``; no key decides, so no hot document can fill a group.
    """
    groups = max(1, -(-pieces.count() // group_items))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << GROUP_BIT
        if not (got := list(batches)):
            return
        table = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        place, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        out = table.append_column("sequence_id", pa.array(group + place)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return pieces.repartition(groups).mapInArrow(fill, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, group_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; texts of any length are packed whole; a null doc_id is an id like another; repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored, whatever their
    names.  A sequence is ``window`` ids at most, filled from offset 0 without gaps; the rest of it
    is padding.  Pieces are written once to the shared folder, so that counting and packing don't
    encode twice and a lost executor repeats little.
    """
    pieces = token_pieces(docs, tokenizer_path, window=window, end_id=end_id, id_col=id_col, text_col=text_col)
    return pack(materialise(pieces, work_dir(docs.sparkSession, "pieces")), window=window, group_items=group_items)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (``window`` long, padded), n_tokens.

    For unique doc_ids.  Piece rows (small) meet the documents on doc_id; a group of one sequence
    holds ``window`` ids at most, so no group is large.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in portions(batches, "text"):
            rows = []
            for row_places, text_ids in zip(batch.column("places").to_pylist(), code.encode_many(batch.column("text")), strict=True):
                ids = np.append(text_ids, end).astype(np.int32)
                rows += [{"sequence_id": p["sequence_id"], "offset": p["offset"], "part": ids[p["start"] : p["start"] + p["length"]]} for p in row_places]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.list_(pa.int32()))]))

    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(places, "doc_id")
    parts = parts.mapInArrow(cut, "sequence_id long, offset long, part array<int>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"]))
    return parts.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), window - F.size("ids"))).alias("ids"), F.size("ids").alias("n_tokens"))
