"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its five-word shingles, weighted by how often they occur.
For each of 64 slots every term draws r and c from a gamma distribution (shape 2) and b uniformly,
by hashing term and slot alone, so all documents see the same draws.  The term's weight S is rounded
down on the grid that r and b lay over log weights, to step t = floor(ln S / r + b), and the term
whose c / (y e^r), y = e^(r (t - b)), is least is the slot's sample; the slot keeps 16 bits of (term, t).
Two documents agree in a slot with probability sum(min) / sum(max) of their weights, the generalised
Jaccard similarity, so the share of equal slots estimates it (standard error 0.06 at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import fan_out, slices, text_of

SLOTS, WORDS = 64, 5
_BLOCK = 512
_U = np.uint64
#: Odd multipliers of the slots, and those of the mixing steps (fixed values, public constants of a 64-bit finaliser).
_SLOT = (np.array([xxhash.xxh64_intdigest(f"slot {k}", 1) for k in range(SLOTS)], np.uint64) | _U(1))[:, None]
_MIX = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def terms(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs; lower case, words between white space.

    A text of fewer words is one term, its whole sequence; a text without words has none.
    """
    found = text.lower().encode().split()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    own = np.full(n, min(words, len(found)), np.uint64)
    for k in range(min(words, len(found))):
        own = own * _MIX[0] + each[k : k + n]
        own ^= own >> _U(32)
    return np.unique(own * _MIX[1], return_counts=True)


def _draws(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each slot and term, as (slots, terms)."""
    x = h[None, :] * _SLOT
    x ^= x >> _U(32)
    x *= _MIX[0]
    x ^= x >> _U(29)
    y = x * _MIX[1]
    y ^= y >> _U(32)
    # 24 bits of each half word make four numbers, and three left-over bytes the fifth
    (x_low, x_high), (y_low, y_high) = (np.moveaxis(w.view(np.uint32).reshape(*w.shape, 2), 2, 0) for w in (x, y))
    unit = lambda bits: (bits.view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    r = -np.log(unit(x_high >> 8) * unit(x_low >> 8))
    c = np.log(-np.log(unit(y_high >> 8) * unit(y_low >> 8)))
    spare = ((x_low & 255) << 16) | ((x_high & 255) << 8) | (y_low & 255)
    return r, c, unit(spare)


def _steps(weights: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.floor(np.log(weights).astype(np.float32) / r + b)


class _Sample:
    """The least term of each slot so far."""

    def __init__(self):
        self.least = np.full(SLOTS, np.inf, np.float32)
        self.bits = np.zeros(SLOTS, np.uint64)

    def see(self, h: np.ndarray, weights: np.ndarray, r: np.ndarray, c: np.ndarray, b: np.ndarray, at_one: np.ndarray) -> None:
        """at_one: ln of the terms' values at weight 1, where t is 0."""
        here = np.flatnonzero(weights)
        if not len(here):
            return
        value = at_one[:, here]
        many = np.flatnonzero(weights[here] > 1)
        if len(many):
            cols = here[many]
            rr, bb = r[:, cols], b[:, cols]
            value[:, many] = c[:, cols] - rr * (_steps(weights[cols], rr, bb) - bb + 1)
        own = value.argmin(axis=1)
        slot = np.arange(SLOTS)
        won = value[slot, own] < self.least
        self.least = np.where(won, value[slot, own], self.least)
        col = here[own]
        t = _steps(weights[col], r[slot, col], b[slot, col]).astype(np.int64).astype(np.uint64)
        bits = (h[col] + t * _MIX[0]) * _MIX[1]
        self.bits = np.where(won, bits ^ (bits >> _U(32)), self.bits)

    def signature(self) -> np.ndarray:
        return (self.bits & _U(0xFFFF)).astype(">u2")


def signatures(documents: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Signatures of a few documents that share terms; each term's draws are made once."""
    every = np.unique(np.concatenate([h for h, _ in documents])) if len(documents) > 1 else documents[0][0]
    weights = []
    for h, n in documents:
        own = np.zeros(len(every), np.int64)
        own[np.searchsorted(every, h)] = n
        weights.append(own)
    samples = [_Sample() for _ in documents]
    for at in range(0, len(every), _BLOCK):
        h = every[at : at + _BLOCK]
        r, c, b = _draws(h)
        at_one = c + r * (b - 1)
        for sample, own in zip(samples, weights, strict=True):
            sample.see(h, own[at : at + _BLOCK], r, c, b, at_one)
    return [s.signature() for s in samples]


def signature(text: str, words: int = WORDS) -> np.ndarray:
    return signatures([terms(text, words)])[0]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool = False, b_empty: bool = False) -> float:
    """The share of equal slots; empty documents are like each other and like nothing else."""
    return float(a_empty and b_empty) if a_empty or b_empty else float((a == b).mean())


def fingerprint_documents(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (64 slots of four hex digits) of every document; no shuffle.

    Odd rows are treated as in ``fingerprint_edits``.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [signature(t, words).tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_predecessors(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, text) in ascending order over partitions, each partition led by the row before its first.

    Adds ``lead``: true for those leading rows, which are the last of the partition before; the
    first partition is led by the very last row.  Ranges come from quantiles over all doc_ids, and
    from each range one number reaches the driver.  Texts are shuffled once.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = rows.select(F.percentile_approx(F.col("place").cast("double"), [k / shards for k in range(1, shards)] or [0.5], 20 * shards)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="real", outputCol="range").transform(rows.withColumn("real", F.col("place").cast("double")))
    ranged = ranged.withColumn("range", F.col("range").cast("int")).drop("real")
    last = sorted((r["range"], r["last"]) for r in ranged.groupBy("range").agg(F.max("place").alias("last")).collect())
    leads = [(last[k][1], last[(k + 1) % len(last)][0]) for k in range(len(last))]
    leading = F.broadcast(spark.createDataFrame(leads, "place long, leads int"))  # a row for each range
    dealt = ranged.join(leading, "place", "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("lead"))
    ahead = F.struct(F.col("leads").alias("range"), F.lit(True).alias("lead"))
    copies = F.when(F.col("leads").isNull(), F.array(own)).otherwise(F.array(own, ahead))
    dealt = dealt.select("doc_id", "text", "place", F.explode(copies).alias("to")).select("doc_id", "text", "place", "to.range", "to.lead")
    return dealt.repartitionById(len(splits) - 1, "range").sortWithinPartitions(F.desc("lead"), "place", "text").select("doc_id", "text", "lead")


def fingerprint_edits(docs: DataFrame, *, words: int = WORDS, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and the next document's are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the one with the next smaller doc_id; after the smallest comes the
    largest.  Null texts are empty.  A null doc_id counts as smaller than all; equal doc_ids stand
    in order of their texts, so repeated rows have one another as next.  A single document is its
    own next.  Texts without words have a fingerprint of zeros, alike to each other only; texts of any
    length count whole.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        before: tuple[str, np.ndarray, bool] | None = None
        for batch in slices(batches, 256):
            out: list[list] = [[] for _ in range(7)]
            for doc, text, lead in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = terms(text, words)
                if lead:
                    before = text, signatures([own])[0], not len(own[0])
                    continue
                new = edited_text(text, before[0])
                changed = terms(new, words)
                a, b = signatures([own, changed])
                empty, new_empty = not len(own[0]), not len(changed[0])
                values = doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b, empty, new_empty), likeness(a, before[1], empty, before[2])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                before = text, a, empty
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return with_predecessors(rows, shards or fan_out(docs.sparkSession)).mapInArrow(run, schema)
