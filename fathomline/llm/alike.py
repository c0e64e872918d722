"""One document of each group of near copies: gathered by SimHash balls, decided by five-word shingle sets.

Equal shingle sets are one node.  Each has a SimHash fingerprint of its single words, whose balls meet
(``simhash.links``), and one of its shingles, which screens what meets; chains of what passes are a
loose group.  Such links only gather: in each loose group the shingle sets themselves are compared,
every pair that isn't in one component yet, and only what these exact links join (Jaccard ``likeness``
or more) is a group.  A set travels once; of a loose group with more shingles than a task should hold,
blocks of it meet in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_out, file_system, materialise, quoted, slices, text_of, work_dir
from .components import components
from .simhash import CHECKED, links, shingle_hashes, simhash

WORDS, LIKENESS = 5, 0.8
#: Three blocks meet all pairs within 4 bits, six tenths of those at 5 and fewer beyond; what meets counts up to RADIUS.
BLOCKS, RADIUS = 3, 8
#: Sets at 0.8 differ in 19.4 +- 4.1 of the 128 bits of their fingerprints, unrelated ones in 64 +- 5.7.
CHECK_RADIUS = 31
#: Shingles of a loose group that one task holds; larger groups are cut into blocks of half of it.
GROUP_SHINGLES = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MARKS = re.compile(r"[^\w\s]+")


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def node_of(shingles: np.ndarray) -> int:
    """64 bits that name a shingle set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 5)).astype(np.int64))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    again = hashes * _ODD
    return (again ^ again >> np.uint64(29)) * _ODD


def word_print(text: str) -> int:
    """The fingerprint of single words without marks and case; of the raw words where only marks are left."""
    hashes = shingle_hashes(_MARKS.sub("", text).lower(), 1)
    return simhash(hashes if len(hashes) else shingle_hashes(text, 1))


def prints(docs: DataFrame) -> DataFrame:
    """Of (doc_id, copy, text): doc_id, copy, node, and the fingerprints of words (fp) and shingles (check, check2), null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t) for t in texts]
            none = pa.array([not len(s) for s in sets])
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64), mask=none.to_numpy(zero_copy_only=False))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(map(node_of, sets), pa.int64()), *(signed(v) for v in (list(map(word_print, texts)), list(map(simhash, sets)), [simhash(mixed(s)) for s in sets]))], ["doc_id", "copy", "node", *CHECKED])

    return docs.mapInArrow(run, "doc_id long, copy long, node long, fp long, check long, check2 long")


def forest(n: int, near) -> tuple[list[int], list[int]]:
    """Links (position, another one) that join 0..n-1 into their components; ``near(k, others)`` says which of others k links to.

    Every pair is compared until its ends are in one component.
    """
    left, a, b = np.arange(n), [], []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            k = reached.pop()
            hit = near(k, left)
            found = left[hit].tolist()
            a += [k] * len(found)
            b += found
            reached += found
            left = left[~hit]
    return a, b


def loose_links(nodes: DataFrame, folder: str) -> DataFrame:
    """From (node, fp, check, check2): (a, b), nodes with equal fingerprints or with near ones, or chains of that."""
    pair = list(CHECKED)
    owners = materialise(nodes.groupBy(*pair).agg(F.min("node").alias("owner"), F.count(F.lit(1)).alias("n")), f"{folder}/owners")
    near = materialise(links(owners, blocks=BLOCKS, radius=RADIUS, check_radius=CHECK_RADIUS), f"{folder}/near")
    shared = nodes.join(owners.filter("n > 1"), pair).select(F.col("node").alias("a"), F.col("owner").alias("b"))
    a, b = (owners.select(F.struct(*pair).alias(end), F.col("owner").alias(f"own_{end}")) for end in ("a", "b"))
    return shared.unionAll(near.join(a, "a").join(b, "b").select("own_a", "own_b")).filter("a <> b")


def exact_links(sets: list[np.ndarray], likeness: float) -> tuple[list[int], list[int]]:
    """Links by the Jaccard likeness of ascending shingle sets, as ``forest`` gives them."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(flat.max()) + 1, bool)

    def near(k: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        able = np.flatnonzero((sizes[others] >= likeness * sizes[k]) & (likeness * sizes[others] <= sizes[k]))
        own = flat[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        for at in range(0, len(able), 1024):
            here = others[able[at : at + 1024]]
            lengths = sizes[here]
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            shared = np.add.reduceat(mark[flat[np.arange(lengths.sum()) + np.repeat(starts[here] - first, lengths)]], first, dtype=np.int64)
            out[able[at : at + 1024]] = shared >= likeness * (lengths + sizes[k] - shared)
        mark[own] = False
        return out

    return forest(len(sets), near)


def verified(members: DataFrame, *, likeness: float, group_shingles: int | None = None) -> DataFrame:
    """From (text, node, root), root the loose group: (a, b), chains of which join exactly what lies in chains of ``likeness``."""
    group_shingles = group_shingles or GROUP_SHINGLES
    folder = work_dir(members.sparkSession, "alike-sets")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            # hashes name the rows; a clash must not bring a foreign set in
            same = pa.array([node_of(s) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "node", "shingles"])
            yield out.filter(same)

    def compare(table: pa.Table) -> pa.Table:
        names, first = np.unique(table["node"].to_numpy(), return_index=True)
        raw = table["shingles"]
        a, b = exact_links([np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first], likeness)
        return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})

    sets = materialise(members.select("text", "node", "root").mapInArrow(read, "root long, node long, shingles binary"), f"{folder}/sets")
    blocks = F.ceil(F.sum(F.length("shingles")) / F.lit(4 * group_shingles)).cast("int").alias("blocks")
    large = sets.groupBy("root").agg(F.sum(F.length("shingles")).alias("bytes"), blocks).filter(F.col("bytes") > 8 * group_shingles).drop("bytes")
    large = materialise(large, f"{folder}/large")
    schema = "a long, b long"
    found = sets.join(large, "root", "left_anti").groupBy("root").applyInArrow(compare, schema)
    if large.isEmpty():
        return found.distinct()
    # blocks of a large group are written once; a task reads two of them, so that no set travels once more for each pair
    own = F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("own")
    blocks = sets.join(large, "root").select("node", "shingles", "root", own)
    blocks.repartition("root", "own").write.partitionBy("root", "own").parquet(f"{folder}/blocks")
    pairs = large.select("root", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    # every two nodes of a block are compared with any other block beside them
    pairs = pairs.select("root", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).filter("i < j")

    def block(root: int, k: int) -> list[pa.Table]:
        fs, path = file_system(f"{folder}/blocks/root={root}/own={k}")
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
        return [pq.ParquetFile(fs.open_input_file(f)).read(["node", "shingles"]) for f in files]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held := block(root, i) + block(root, j):
                    yield from compare(pa.concat_tables(held)).to_batches()

    dealt = pairs.repartition(fan_out(members.sparkSession), "root", "i", "j").mapInArrow(meet, schema)
    return found.unionAll(dealt).distinct()


def groups(docs: DataFrame, *, likeness: float = LIKENESS, group_shingles: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, copy, text): its rows (doc_id, copy, node), and all nodes with their least row and, but for nodes alone, the least node of the group.

    ``copy`` is a hash of the text, so that (doc_id, copy) names a row up to repetition.
    """
    folder = work_dir(docs.sparkSession, "alike")
    rows = materialise(prints(docs), f"{folder}/prints")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("first"), *[F.min(c).alias(c) for c in CHECKED])
    nodes = materialise(nodes, f"{folder}/nodes")
    loose = components(loose_links(nodes.filter("fp is not null").select("node", *CHECKED), folder), name="alike-loose")
    loose = materialise(nodes.select("node", "first.*").join(loose, "node"), f"{folder}/loose")
    # the same plan at every size: what is joined to the texts grows with them
    members = docs.hint("merge").join(loose, ["doc_id", "copy"])
    roots = components(verified(members, likeness=likeness, group_shingles=group_shingles), name="alike")
    return rows.select("doc_id", "copy", "node"), nodes.select("node", "first").join(roots, "node", "left")


def one_of_each(docs: DataFrame, *, likeness: float = LIKENESS, group_shingles: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies; all columns stay.

    Documents link if their sets of five-word shingles (lower case, between ASCII white space) are at
    least ``likeness`` alike; groups are chains of links.  A shorter text is one shingle.  Null texts count
    as empty, and texts without words are copies of each other; texts of any length count whole.  Of
    rows with one id and one text one stays (ties by its other columns); rows with one id and other texts
    are documents of their own.  Rows without an id can't be named as dropped and stay; an empty table
    stays empty; no other column's name matters.
    """
    folder = work_dir(docs.sparkSession, "one-of-each")
    text = text_of(quoted(text_col))
    named = docs.select(F.struct("*").alias("row"), quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"))
    known = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text")).filter("doc_id is not null")
    rows, nodes = groups(known, likeness=likeness, group_shingles=group_shingles)
    nodes = materialise(nodes, f"{folder}/nodes")
    kept = materialise(nodes.filter("root is not null").groupBy("root").agg(F.min("first").alias("kept")), f"{folder}/kept")
    # of a node alone its own least row stays
    kept = nodes.join(kept, "root").select("node", "kept").unionAll(nodes.filter("root is null").select("node", "first"))
    told = rows.groupBy("doc_id", "copy", "node").agg(F.count(F.lit(1)).alias("n"))
    told = told.join(kept, "node").select("doc_id", "copy", (F.struct("doc_id", "copy") != F.col("kept")).alias("goes"), "n").filter("goes or n > 1")
    told = materialise(told.groupBy("doc_id", "copy").agg(F.max("goes").alias("goes"), F.sum("n").alias("n")), f"{folder}/told")
    left = named.filter("doc_id is not null").hint("merge").join(told, ["doc_id", "copy"], "left").filter("not coalesce(goes, false)")
    out = left.filter("n is null").select("row").unionAll(named.filter("doc_id is null").select("row"))
    if not told.filter("not goes").isEmpty():
        again = left.filter("n > 1").groupBy("doc_id", "copy").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionAll(again.select("row"))
    return out.select("row.*")
