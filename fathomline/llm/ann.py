"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors
(queries get zero there), so the largest inner product is the smallest Euclidean distance.  Each of
``tables`` hash tables cuts ``n_hashes`` Gaussian (2-stable) projections into cells of width
``width``; more vectors get more projections, so buckets keep their size.  Every row is in one
bucket of every table.

A query visits perturbed buckets in order of their estimated chance to hold a neighbour: given the
query's projection f, a neighbour at cosine s has projection N(s f, 1 - s^2), so a bucket's chance is
a product over its cells, and buckets are taken from a heap in falling order until their chances add
up to what the wanted recall asks of a table.  ``s`` is fitted on a bounded sample.  Candidates are
scored inside their bucket by exact inner products in double precision on the original vectors,
and only the best of each query leave a task; tables merge by (query, vector).

With one table, the default, a pair meets in one bucket at most and is scored once; probes, not tables,
carry the recall.

Of equal vectors only the k + 1 with the smallest ids are indexed: no query can see more of them.
Buckets above a bound are dealt over chunks (their list is short: at most ``HOT_BUCKETS`` buckets can
hold that share of all rows).  Queries that find fewer than k candidates are answered exactly: blocks of
them are dealt to tasks, each with a part of all rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fan_out, materialise, work_dir

HOT_BUCKETS = 20_000
CHUNK_ROWS = 256
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
EXACT_BLOCK = 512
#: Scores of BLAS blocks may differ in the last places from the final ones; candidates within this are kept.
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double; equal vectors get equal scores wherever they stand."""
    return (queries * rows).sum(axis=1)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in x.ravel()]).reshape(x.shape))


class Hashing:
    """The projections of all tables, made from a seed, and the order of probes."""

    def __init__(self, dim: int, largest: float, cosine: float, *, n_hashes: int, tables: int, width: float, recall: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.largest, self.width, self.n_hashes, self.tables = largest, width, n_hashes, tables
        self.planes = rng.normal(size=(tables, n_hashes, dim + 1))
        self.shifts = rng.uniform(0, width, (tables, n_hashes))
        self.cosine = min(max(cosine, 0.0), 0.999)
        self.target = 1 - (1 - recall) ** (1 / tables)
        self.codes = rng.integers(1, 1 << 62, n_hashes).astype(np.int64) | 1

    def code(self, cells: np.ndarray) -> np.ndarray:
        """A bucket's number from its cells; the rare clash only adds candidates."""
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.int64) * self.codes).sum(axis=-1)
            return mixed ^ (mixed >> 29)

    def buckets(self, rows: np.ndarray, table: int) -> np.ndarray:
        unit = rows / self.largest
        extra = np.sqrt(np.clip(1 - (unit * unit).sum(axis=1), 0, None))
        f = unit @ self.planes[table, :, :-1].T + extra[:, None] * self.planes[table, :, -1]
        return self.code(np.floor((f + self.shifts[table]) / self.width))

    def probes(self, query: np.ndarray, table: int) -> np.ndarray:
        """Buckets in falling order of their chance, until the chances add up to the target."""
        f = self.planes[table, :, :-1] @ (query / np.sqrt((query * query).sum()))
        spread = math.sqrt(1 - self.cosine**2)
        mean = self.cosine * f + self.shifts[table]
        first = np.floor((mean - 4 * spread) / self.width).astype(np.int64)
        n = int(np.max(np.floor((mean + 4 * spread) / self.width) - first)) + 1
        cells = first[:, None] + np.arange(n)
        edges = (np.concatenate([cells, cells[:, -1:] + 1], axis=1) * self.width - mean[:, None]) / spread
        chance = np.diff(_normal_cdf(edges), axis=1)
        order = np.argsort(-chance, axis=1, kind="stable")
        cells, chance = np.take_along_axis(cells, order, 1), np.take_along_axis(chance, order, 1).tolist()
        start = (0,) * self.n_hashes
        heap = [(-math.prod(c[0] for c in chance), start, 0)]
        total, found = 0.0, []
        while heap and total < self.target:
            less, at, last = heapq.heappop(heap)
            total -= less
            found.append(at)
            for i in range(last, self.n_hashes):
                if at[i] + 1 < n and chance[i][at[i]] > 0 and (more := less / chance[i][at[i]] * chance[i][at[i] + 1]) < 0:
                    heapq.heappush(heap, (more, at[:i] + (at[i] + 1,) + at[i + 1 :], i))
        picked = np.array(found, np.int64)
        return self.code(np.stack([cells[i, picked[:, i]] for i in range(self.n_hashes)], axis=1))


def fit(base: DataFrame, k: int, *, tables: int, width: float, recall: float, bucket_rows: int) -> Hashing | None:
    """Hashing for ``base`` (vec_id, vec): size and largest norm over all rows, neighbours' cosine on a bounded sample.

    The sample is the SAMPLE_ROWS rows whose ids hash lowest; the k-th neighbour among all rows is
    about the (k * sample / all)-th among them.
    """
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest = base.agg(F.count(F.lit(1)), F.sqrt(F.max(norm))).first()
    if not n:
        return None
    sample = _matrix(pa.array([r[0] for r in base.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").select("vec").limit(SAMPLE_ROWS).collect()]))
    unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    near = np.sort(unit[:SAMPLE_QUERIES] @ sample.T / largest, axis=1)
    rank = min(len(sample), 1 + max(1, round(k * len(sample) / n)))
    cosine = float(np.median(near[:, -rank]))
    n_hashes = int(min(24, max(2, round(math.log(max(n / bucket_rows, 2)) / math.log(3.3)))))
    return Hashing(sample.shape[1], float(largest), cosine, n_hashes=n_hashes, tables=tables, width=width, recall=recall)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of each query's best: largest score, then smallest id; a pair counts once."""
    order = np.lexsort((ids, -score, query))
    q, i = query[order], ids[order]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])]) if len(q) else np.zeros(0, bool)
    order, q = order[fresh], q[fresh]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[place < keep]


class _Best:
    """The best pairs a task has seen, pruned now and then."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.held = keep, [], 0

    def add(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(queries), step := max(1, (1 << 21) // max(1, len(rows)))):
            own = queries[at : at + step]
            s = own @ rows.T
            if len(ids) > self.keep:
                least = np.partition(s, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep]
                a, b = np.nonzero(s >= least[:, None] - _SLACK)
            else:
                a, b = (x.ravel() for x in np.indices(s.shape))
            self.parts.append((query_ids[at : at + step][a], ids[b], scores(own[a], rows[b])))
            self.held += len(a)
            if self.held > 1 << 20:
                self.prune()

    def prune(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        kept = best_of(q, i, s, self.keep)
        self.parts, self.held = [(q[kept], i[kept], s[kept])], 0

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.prune()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.parts[0]], ["query_key", "vec_id", "score"])


_PAIRS = "query_key long, vec_id long, score double"


def _hashed(frame: DataFrame, hashing: Hashing, queries: bool, hot: dict[tuple[int, int], int]) -> DataFrame:
    """Rows (id, vec) by the buckets that they are in, or visit; queries go to all chunks of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256 if queries else 4096):
                batch = whole.slice(at, 256 if queries else 4096)
                ids, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                for table in range(hashing.tables):
                    if queries:
                        lists = [hashing.probes(q, table) for q in rows]
                        who, bucket = np.repeat(np.arange(len(rows)), [len(x) for x in lists]), np.concatenate(lists)
                    else:
                        who, bucket = np.arange(len(rows)), hashing.buckets(rows, table)
                    chunks = np.array([hot.get((table, b), 1) for b in bucket.tolist()]) if hot else np.ones(len(bucket), np.int64)
                    if queries:
                        chunk = np.concatenate([np.arange(c) for c in chunks.tolist()]) if hot else np.zeros(len(who), np.int64)
                        who, bucket = np.repeat(who, chunks), np.repeat(bucket, chunks)
                    else:
                        chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks
                    n = len(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, table, np.int32)), pa.array(bucket), pa.array(chunk.astype(np.int32)), pa.array(np.full(n, 0 if queries else 1, np.int32)), pa.array(ids[who]), batch.column(1).take(pa.array(who))],
                        ["table", "bucket", "chunk", "side", "id", "vec"],
                    )

    element = frame.schema["vec"].dataType.simpleString()
    return frame.mapInArrow(run, f"table int, bucket long, chunk int, side int, id long, vec {element}")


def _candidates(index: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """Best pairs of each task: buckets stream by, queries first, then rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, ids, queries = _Best(keep), None, None, None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            change = np.zeros(batch.num_rows, bool)
            change[:1] = True
            for c in columns[:4]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                group, side, rows = tuple(int(c[a]) for c in columns[:3]), int(columns[3][a]), _matrix(batch.column(5).slice(a, b - a))
                if side == 0:
                    ids, queries = (columns[4][a:b], rows) if group != key else (np.concatenate([ids, columns[4][a:b]]), np.concatenate([queries, rows]))
                    key = group
                elif group == key:
                    best.add(ids, queries, columns[4][a:b], rows)
        yield from best.out()

    both = index.unionAll(probes)
    keys = ["table", "bucket", "chunk"]
    return both.repartition(fan_out(index.sparkSession), *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, _PAIRS)


def _exact(base: DataFrame, queries: DataFrame, keep: int) -> DataFrame | None:
    """Best pairs of these queries over all rows: blocks of queries meet every part of the rows in a task of their own."""
    queries = materialise(queries, work_dir(base.sparkSession, "exact-queries"))
    if not (n := queries.count()):
        return None
    blocks, parts = -(-n // EXACT_BLOCK), fan_out(base.sparkSession)
    number = lambda of, c: F.pmod(F.xxhash64(c), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    spread = lambda frame, table, bucket, side, c: frame.withColumn("table", table).withColumn("bucket", bucket).select(F.col("table").cast("int"), F.col("bucket").cast("long"), F.lit(0).alias("chunk"), F.lit(side).alias("side"), F.col(c).alias("id"), "vec")
    asked = spread(queries, number(blocks, "id"), every(parts), 0, "id")
    rows = spread(base, every(blocks), number(parts, "vec_id"), 1, "vec_id")
    return _candidates(rows, asked, keep)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, tables: int = 1, width: float = 2.0, recall: float = 0.95, bucket_rows: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row by inner product: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's own id; nearest first, equal scores by the
    smaller id.  Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids and vectors of another width than most have.  A repeated row counts once; rows
    with one id and different vectors are each a candidate, and each a query.  With fewer
    candidates than k all are returned; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    folder = work_dir(spark, "ann")
    vec = F.col(f"`{vector_col}`")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dim = good.agg(F.mode(F.size("vec"), True)).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return spark.createDataFrame([], schema)
    good = good.filter(F.size("vec") == dim).dropDuplicates(["vec_id", "vec"])
    copies = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    base = materialise(good.withColumn("copy", copies).filter(F.col("copy") <= k + 1).select("vec_id", "vec"), f"{folder}/base")
    asked = materialise(good.filter("asks").select("vec_id", "vec"), f"{folder}/asked")
    distinct = materialise(asked.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"), f"{folder}/queries")
    # two vectors may share the least id of their copies; the key must not
    keyed = distinct.withColumn("id", F.xxhash64("id", "vec"))
    if (hashing := fit(base, k, tables=tables, width=width, recall=recall, bucket_rows=bucket_rows)) is None:
        return spark.createDataFrame([], schema)
    n = base.count()
    index = base.select(F.col("vec_id").alias("id"), "vec")
    most = max(CHUNK_ROWS, n * tables // HOT_BUCKETS)
    counted = _hashed(index, hashing, False, {}).groupBy("table", "bucket").count().filter(F.col("count") > most).collect()
    hot = {(r["table"], r["bucket"]): -(-r["count"] // most) for r in counted}
    found = _candidates(_hashed(index, hashing, False, hot), _hashed(keyed, hashing, True, hot), k + 1)
    ranked = lambda pairs: pairs.distinct().withColumn("place", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1).drop("place")
    found = materialise(ranked(found), f"{folder}/found")
    enough = found.groupBy("query_key").count().filter(F.col("count") >= min(k + 1, n)).select(F.col("query_key").alias("id"))
    if (exact := _exact(base, keyed.join(enough, "id", "left_anti"), k + 1)) is not None:
        found = ranked(found.unionAll(exact))
    keys = asked.join(keyed.select(F.col("id").alias("query_key"), "vec"), "vec").select(F.col("vec_id").alias("query_id"), "query_key")
    pairs = keys.join(found, "query_key").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
