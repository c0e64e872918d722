"""Near-duplicate documents by SimHash, found by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` = 3 bits meet half-way: both emit every variant of themselves within
half the radius, 1.5 bits, and share one.  The half bit is an erasure, which counts half a flip: one
of four 16-bit blocks is blanked and at most one other bit is flipped.  Of 1 to 3 differing bits at
least one lies in some block; with that block blanked at most two remain, and the two sides' single
flips meet between them.  That is 4 * (1 + 48) = 196 variants, where whole balls of radius 2 would
be 2,081.  Variants keep 48 fixed bits, so unrelated fingerprints hardly ever meet, at any corpus size.

``near_duplicates`` is that alone, over three-word shingles.  ``alike.one_of_each`` drops documents for
good, so its fingerprints only gather candidates: of single words (letters and digits, lower case), in three
blocks of 21 or 22 bits, 132 variants.  That is exact for 4 differing bits (the fullest block holds two)
and meets many pairs beyond.  A second fingerprint, of five-word shingles, travels along and screens
what meets, as long texts of one language have much the same words.  The shingle sets decide.

Equal fingerprints are one before anything is emitted, so copies cost nothing.  Variants are
shuffled with the few bits that give the fingerprint back, sorted, and verified bucket by bucket; a bucket tells the forest
of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fan_out, materialise, slices, text_of, work_dir
from .components import components

RADIUS = 3
#: Buckets up to this size are compared pair by pair in memory; larger ones are split again.
PAIRWISE = 2048


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle: A-Z lower-cased, words between ASCII white space, joined by spaces.

    Fewer words than a shingle has: the whole sequence; no words: none.
    """
    found = text.encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    count, digest = len(found) - words + 1, xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:count].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, count)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed long (fp), of whole texts (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array([simhash(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks_of(n: int) -> list[tuple[int, int]]:
    """The 64 bits in n blocks: lowest bit and width of each."""
    return [(k * 64 // n, (k + 1) * 64 // n - k * 64 // n) for k in range(n)]


def _flips(low: int, width: int) -> tuple[np.uint64, np.ndarray]:
    """A block's bits, and what its variants flip outside it: nothing, or one bit."""
    blank = np.uint64(((1 << width) - 1) << low)
    return blank, np.array([0, *(1 << i for i in range(64) if not int(blank) >> i & 1)], np.uint64)


def variants(prints: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """For each block: the fingerprints with it blanked and at most one other bit flipped, all of one in a row."""
    for number, (low, width) in enumerate(blocks_of(blocks)):
        blank, flips = _flips(low, width)
        # the block's number stands in the blank, so that blocks don't meet each other
        yield ((prints & ~blank) | np.uint64((number & ((1 << width) - 1)) << low))[:, None] ^ flips[None, :]


def traces(prints: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """What each variant needs besides itself to give its fingerprint back: the block's bits, the flip and the block, in few bits."""
    for number, (low, width) in enumerate(blocks_of(blocks)):
        flips = np.arange(65 - width, dtype=np.uint64) << np.uint64(4)
        yield ((prints >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(11))[:, None] | flips[None, :] | np.uint64(number)


def restored(keys: np.ndarray, trace: np.ndarray, blocks: int) -> np.ndarray:
    """The fingerprints of variants and their traces."""
    out = np.empty_like(keys)
    number, flip = trace & np.uint64(15), (trace >> np.uint64(4) & np.uint64(127)).astype(np.int64)
    for k, (low, width) in enumerate(blocks_of(blocks)):
        at = np.flatnonzero(number == k)
        blank, flips = _flips(low, width)
        out[at] = ((keys[at] ^ flips[flip[at]]) & ~blank) | trace[at] >> np.uint64(11) << np.uint64(low)
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of equal runs in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after linking positions a and b, to the end."""
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: A fingerprint and the two halves of its check.
CHECKED = ("fp", "check", "check2")


class Near:
    """When two fingerprints link: in ``radius`` bits, and their checks, if there are any, in ``check_radius``."""

    def __init__(self, radius: int = RADIUS, check_radius: int = 128):
        self.radius, self.check_radius = radius, check_radius

    def __call__(self, p: np.ndarray, q: np.ndarray, c: np.ndarray | None, d: np.ndarray | None) -> np.ndarray:
        near = np.bitwise_count(p ^ q) <= self.radius
        return near if c is None else near & (np.bitwise_count(c ^ d).sum(axis=-1, dtype=np.int64) <= self.check_radius)


def local_roots(prints: np.ndarray, checks: np.ndarray | None, near: Near) -> np.ndarray:
    """For distinct fingerprints of one bucket, the position of the first one of each's component."""
    n = len(prints)
    label = np.arange(n)
    part = lambda x, at: None if x is None else x[at]

    def pairwise(own: np.ndarray) -> None:
        nonlocal label
        for at in range(0, len(own), 512):
            here = own[at : at + 512]
            a, b = np.nonzero(near(prints[here][:, None], prints[own][None, :], None if checks is None else checks[here][:, None], part(checks, own)))
            label = _spread(label, here[a], own[b])

    if n <= PAIRWISE:
        pairwise(np.arange(n))
    elif near.radius <= 3 and checks is None:
        # a large bucket: the same meeting again with blocks of four bits, whose buckets hold 16 * 61 fingerprints at most
        for keys in variants(prints, 16):
            owner = np.repeat(np.arange(n), keys.shape[1])
            flat = keys.ravel()
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            starts, sizes = _groups(flat)
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = owner[start : start + size]
                if np.ptp(label[own]):
                    pairwise(own)
    else:
        # from one to all that it reaches: a fingerprint is held against those that nothing has reached yet
        left = np.arange(n)
        while len(left):
            root, reached, left = left[0], [int(left[0])], left[1:]
            while reached and len(left):
                k = reached.pop()
                hit = near(prints[left], prints[k], part(checks, left), part(checks, k))
                label[left[hit]] = root
                reached += left[hit].tolist()
                left = left[~hit]
    return label


def _nodes(prints: np.ndarray, checks: np.ndarray | None) -> np.ndarray:
    """Fingerprints with their checks (two columns) as values that compare and sort."""
    if checks is None:
        return prints
    out = np.empty(len(prints), [(c, "<u8") for c in CHECKED])
    out["fp"], out["check"], out["check2"] = prints, checks[:, 0], checks[:, 1]
    return out


#: How many neighbours in its bucket every fingerprint is held against before buckets are looked at one by one.
NEIGHBOURS = 16


def bucket_links(keys: np.ndarray, prints: np.ndarray, checks: np.ndarray | None = None, near: Near | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, another one of its component) of whole buckets, given sorted by key.

    Neighbours are compared for all buckets at once.  That is every pair of small buckets; a larger
    one is searched through by itself only if it isn't one component by then.
    """
    near = near or Near()
    starts, sizes = _groups(keys)
    some = np.repeat(sizes > 1, sizes)
    keys, nodes = keys[some], _nodes(prints, checks)[some]
    if not len(keys):
        return nodes, nodes
    every, at = np.unique(nodes, return_inverse=True)
    split = lambda x: (x, None) if checks is None else (x["fp"], np.stack([x["check"], x["check2"]], axis=1))
    p, c = split(nodes)
    ends = []
    starts, sizes = _groups(keys)
    for shift in range(1, min(int(sizes.max()) - 1, NEIGHBOURS) + 1):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        linked = same[near(p[same + shift], p[same], None if c is None else c[same + shift], None if c is None else c[same])]
        ends.append((at[linked + shift], at[linked]))
    label = _spread(np.arange(len(every)), *(np.concatenate(x) for x in zip(*ends, strict=True)))
    large, done = np.flatnonzero(sizes > NEIGHBOURS + 1).tolist(), 0
    while done < len(large):
        ends = [(label[:0], label[:0])]
        for k in large[done : done + 64]:
            own = np.unique(at[starts[k] : starts[k] + sizes[k]])
            if np.ptp(label[own]):
                root = local_roots(*split(every[own]), near)
                ends.append((own, own[root]))
        label, done = _spread(label, *(np.concatenate(x) for x in zip(*ends, strict=True))), done + 64
    child = np.flatnonzero(label != np.arange(len(every)))
    return every[child], every[label[child]]


def links(prints: DataFrame, *, blocks: int = 4, radius: int = RADIUS, check_radius: int = 128) -> DataFrame:
    """From distinct rows (fp) or (fp, check, check2): (a, b), which link exactly what lies within the radius, or in chains of it.

    Ends are fingerprints, or structs of a fingerprint and its 128 bits of check, which must lie within their own radius.
    Four blocks are exact for a radius of 3, three for one of 4; fewer blocks emit less and meet more
    often by chance.  Beyond the exact radius some links are missed, never added.
    """
    checked, near = "check" in prints.columns, Near(radius, check_radius)
    columns = list(CHECKED) if checked else ["fp"]
    sent = ["key", "trace", *CHECKED[1:]] if checked else ["key", "trace"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys, trace in zip(variants(own, blocks), traces(own, blocks), strict=True):
                at = pa.array(np.repeat(np.arange(len(own)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(trace.ravel().view(np.int64)), *(c.take(at) for c in batch.columns[1:])], sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            # most buckets hold one fingerprint; only the others' are restored
            starts, sizes = _groups(rows[0])
            some = np.repeat(sizes > 1, sizes)
            keys, trace, *check = (x[some] for x in rows)
            return _links(*bucket_links(keys, restored(keys, trace, blocks), np.stack(check, axis=1) if checked else None, near))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            if len(held) < 64 or held[0][0][0] == held[-1][0][-1]:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            whole = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1]))  # the last bucket may go on
            held = [[x[whole:] for x in rows]]
            yield linked([x[:whole] for x in rows])
        if held:
            yield linked([np.concatenate(x) for x in zip(*held, strict=True)])

    # few distinct fingerprints become many variants: deal them out first
    n = fan_out(prints.sparkSession)
    emitted = prints.select(*columns).repartition(n).mapInArrow(emit, ", ".join(f"{c} long" for c in sent))
    end = "struct<fp: long, check: long, check2: long>" if checked else "long"
    return emitted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, f"a {end}, b {end}").distinct()


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    ends = [signed(x) if x.dtype.names is None else pa.StructArray.from_arrays([signed(x[c]) for c in CHECKED], list(CHECKED)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"])


def fingerprint_hex(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that chains of links (fingerprints that differ in at most
    ``radius`` bits) reach, itself included.  Null texts count as empty; a text without words has
    fingerprint zero and links like any other.  A null doc_id is in its component but never names
    it; a component of such documents alone has the id null.  Texts of any length count whole.  Repeated
    rows give repeated rows, an empty table gives none; other columns are ignored, whatever their names.
    """
    folder = work_dir(docs.sparkSession, "simhash")
    prints = materialise(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), f"{folder}/prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct), name="simhash-links").withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, f"{folder}/named")
    # written, so that the join on a large component's root is one that adaptive execution can split
    least = materialise(named.groupBy("root").agg(F.min("first_id").alias("component_id")), f"{folder}/least")
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
