"""Splitting texts into overlapping chunks at paragraph, line, word and character boundaries, in that order.

A text is cut before every occurrence of the coarsest separator that it holds.  Neighbouring pieces
are gathered into windows of at most ``size`` characters; a new window starts with as many of the
last pieces as fit into ``overlap``.  A piece that alone is too long is cut by the finer separators.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


class _Window:
    """Pieces of the chunk being filled."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.pieces, self.length = size, overlap, deque(), 0

    def chunk(self) -> Iterator[str]:
        if whole := "".join(self.pieces).strip():
            yield whole

    def add(self, piece: str) -> Iterator[str]:
        if self.pieces and self.length + len(piece) > self.size:
            yield from self.chunk()
            while self.length > self.overlap or (self.length and self.length + len(piece) > self.size):
                self.length -= len(self.pieces.popleft())
        self.pieces.append(piece)
        self.length += len(piece)


def chunks_of(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """The chunks of a text, without outer white space, in order; none for a blank text."""
    level = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1 :]
    window = _Window(size, overlap)
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            yield from window.add(piece)
            continue
        yield from window.chunk()
        window = _Window(size, overlap)
        if finer:
            yield from chunks_of(piece, size, overlap, finer)
        else:
            yield piece
    yield from window.chunk()


def chunk_documents(docs: DataFrame, *, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_id, chunk_index (from 0) and content of every chunk; a null or blank text has none.  No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                who, index, content = [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for i, chunk in enumerate(chunks_of(text or "", size, overlap)):
                        who.append(k)
                        index.append(i)
                        content.append(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["document_id", "chunk_index", "content"])

    return docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text")).mapInArrow(run, f"document_id {kind}, chunk_index int, content string")
