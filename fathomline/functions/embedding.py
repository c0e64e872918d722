"""Embedding sources: the protocol, a deterministic stand-in, and batched embedding of a chunk table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stemming import simple


class Embedder(Protocol):
    """Vectors of texts, in order; one client serves a whole partition."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashing of words into a unit vector; says something about shared words and nothing about meaning."""

    def __init__(self, width: int = 64):
        self.width = width

    def one(self, text: str) -> list[float]:
        v = [0.0] * self.width
        for word, _ in simple(text):
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            v[h % self.width] += 1.0 if h & 0x80000000 else -1.0
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v] if length else v

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]


def embed_text(embedder: Embedder, text: str) -> list[float]:
    return embedder([text])[0]


def _vectors(embedder: Embedder, texts: list[str], width: int) -> list[list[float]]:
    vectors = embedder(texts)
    if len(vectors) != len(texts) or any(len(v) != width for v in vectors):
        raise ValueError(f"the embedder must answer {len(texts)} vectors of width {width}")
    return vectors


def embed_chunks(chunks: DataFrame, make_embedder: Callable[[], Embedder], *, width: int, batch: int = 100, text_col: str = "content", error_by: str | None = None, error_chars: int = 500) -> DataFrame:
    """``chunks`` with an ``embedding``: batches of ``batch`` texts, one embedder a partition.

    An answer of another length or width is an error: vectors stay on the row of their text, so
    nothing is cut off in silence.  With ``error_by``, the column of the owner of a text, an error is
    data: column ``embed_error`` holds its head, the vector is null, and a batch that fails is asked
    again owner by owner, so that one owner's failure is not another's.
    """
    base = chunks.drop("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", embedding array<float>" + (", embed_error string" if error_by else "")
    at = base.columns.index(text_col)

    def parts(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owners = part.column(error_by).to_pylist()
        for owner in dict.fromkeys(owners):
            yield part.filter(pa.array([o == owner for o in owners]))

    def asked(embedder: Embedder, part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list, str | None]]:
        texts = lambda p: [t or "" for t in p.column(at).to_pylist()]
        try:
            yield part, _vectors(embedder, texts(part), width), None
            return
        except Exception:
            if not error_by:
                raise
        for own in parts(part):
            try:
                yield own, _vectors(embedder, texts(own), width), None
            except Exception as error:  # one owner's failure is data
                yield own, [None] * own.num_rows, (str(error) or type(error).__name__)[:error_chars]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                for part, vectors, error in asked(embedder, whole.slice(start, batch)):
                    out = part.append_column("embedding", pa.array(vectors, pa.list_(pa.float32())))
                    yield out.append_column("embed_error", pa.array([error] * part.num_rows, pa.string())) if error_by else out

    return base.mapInArrow(run, schema)


def checked_width(embedding: str, width: int):
    """The vector, or an error for another width (null stays null)."""
    return F.when(F.col(embedding).isNull() | F.assert_true(F.size(embedding) == width, F.lit("wrong vector width")).isNull(), F.col(embedding))
