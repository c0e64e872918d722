"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives every document the chances p_dk that it belongs to
domain k, in steps of 1 / STEPS.  Each document gets a rate r_d between 0 and ``max_rate``, and the expected
tokens of a domain are sum over d of r_d n_d p_dk.  Rates minimise the squared distance of these totals
from the targets by accelerated projected gradient steps: y = r + b (r - r_before),
r <- clip(y - p G^-1 (A y - T)), where A holds n_d p_dk and G = A p is the K by K Gram matrix of chances
weighted by tokens (and a little of the identity), in whose metric a step of length 1 is right.
Momentum b starts anew when a step turns against the last.

A rate follows from a document's chances alone, so documents with equal chances are one cell: their
tokens are summed once, and every later step reads cells, not documents.  A step needs the K totals
only, which tasks sum over their own cells; rates follow from the (short) list of past steps, so no
state is kept between steps and a lost task recomputes its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, work_dir
from .features import TEXT_BITS, Model, one_hot, text_features, train

#: Chances are rounded to this part of one.
STEPS = 1000


def label_domain(quality: Column, toxic: Column) -> Column:
    """Domains of the labelled table: junk where the quality label is 0, else toxic where that label is 1, else clean."""
    return F.when(quality == 0, "junk").when(toxic == 1, "toxic").when(quality.isNotNull() | toxic.isNotNull(), "clean")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], *, labelled: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Text classifier of ``domains`` from ``labels`` (doc_id, domain), on at most ``labelled`` rows chosen by hash.

    Rows of other domains are left out; of several rows of a document the first domain in the list
    counts.  None without labelled documents.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text_features(t).astype(np.int32) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "domain", "slots"])

    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", place.alias("domain")).filter("domain >= 0").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    chosen = F.broadcast(known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").select("doc_id", "domain", "text")
    # of rows that share an id one is a sample, so that the bound holds
    got = rows.mapInArrow(features, "doc_id long, domain int, slots array<int>").groupBy("doc_id", "domain").agg(F.min("slots").alias("slots")).toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    slots = [v.values.to_numpy().astype(np.int64) for v in got["slots"]]
    return train([slots[i] for i in order], one_hot(got["domain"].to_numpy()[order], len(domains)), (1 << TEXT_BITS) + 1, keep=1000, ridge=1e-4)


def _chances(texts: list[str | None], model: Model | None, n_domains: int) -> tuple[list[int], np.ndarray]:
    """Words between white space, and a chance for each domain, rounded; equal chances without a model."""
    p = np.round(model.chances([text_features(t) for t in texts]) * STEPS) / STEPS if model else np.full((len(texts), n_domains), 1 / n_domains)
    return [len(t.split()) if t else 0 for t in texts], p


def posteriors(docs: DataFrame, model: Model | None, n_domains: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and p (a chance for each domain) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, p = _chances(batch.column(1).to_pylist(), model, n_domains)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def cells(table: DataFrame) -> DataFrame:
    """Documents with equal chances as one: p and the sum of n_tokens."""
    return table.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


#: A step: G^-1 (A y - T), and the momentum that led to y.
Step = tuple[np.ndarray, float]


def rates_after(p: np.ndarray, steps: list[Step], max_rate: float) -> np.ndarray:
    """Rates of documents with chances ``p`` after projected steps."""
    before = rate = np.full(len(p), min(1.0, max_rate))
    for step, momentum in steps:
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.clip(ahead - p @ step, 0.0, max_rate)
    return rate


def _totals(cell_table: DataFrame, k: int, steps: list[Step], max_rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all cells: r a, a, and a p'; each task tells its own sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * k + k * k)
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column("p"), batch.num_rows)
                a = batch.column("n_tokens").to_numpy(zero_copy_only=False)[:, None] * p
                sums += np.concatenate([rates_after(p, steps, max_rate) @ a, a.sum(axis=0), (a.T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    row = cell_table.select("p", "n_tokens").mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[i]) for i in range(2 * k + k * k)]).first()
    sums = np.array([0.0 if v is None else v for v in row])
    return sums[:k], sums[k : 2 * k], sums[2 * k :].reshape(k, k)


@dataclass
class Fit:
    """The steps to the rates, and for each domain what was wanted, reached, and there at all, in tokens.

    ``settled``: the last step hardly changed the totals, or they are the targets.  Where ``reached`` then
    differs from ``targets``, rates between 0 and ``max_rate`` come no nearer.
    """

    steps: list[Step]
    targets: np.ndarray
    reached: np.ndarray
    available: np.ndarray
    settled: bool


def target_totals(available: np.ndarray, weights: np.ndarray, anchor: int) -> np.ndarray:
    """Token targets: the anchor domain whole, the others in proportion to their weights, whatever there is of them."""
    weights = weights / weights.sum()
    total = available[anchor] / weights[anchor] if weights[anchor] > 0 else available.sum()
    return weights * total


def fit_rates(cell_table: DataFrame, weights: list[float], *, anchor: int = 0, max_rate: float = 1.0, rounds: int = 100, close: float = 1e-5) -> Fit:
    """The steps that lead to the rates; they end when totals hardly change or are close to the targets."""
    k = len(weights)
    steps: list[Step] = []
    totals, available, gram = _totals(cell_table, k, steps, max_rate)
    targets = target_totals(available, np.array(weights, float), anchor)
    if not available.sum():
        return Fit(steps, targets, totals, available, True)
    # domains with next to nothing must not weigh as much as the rest
    metric = np.linalg.inv(gram + np.eye(k) * 1e-3 * np.trace(gram) / k)
    before, t, settled = totals, 1.0, False
    near = lambda a, b: np.abs(a - b).max() <= close * available.sum()
    for _ in range(rounds):
        if settled := near(totals, targets):
            break
        t, momentum = (1 + np.sqrt(1 + 4 * t * t)) / 2, (t - 1) * 2 / (1 + np.sqrt(1 + 4 * t * t))
        step = metric @ (totals + momentum * (totals - before) - targets)
        steps.append((step, momentum))
        before, totals = totals, _totals(cell_table, k, steps, max_rate)[0]
        if settled := near(totals, before):
            break
        if step @ (totals - before) > 0:
            t = 1.0
    return Fit(steps, targets, totals, available, settled)


def copies_of(rates: np.ndarray, ids: list[int | None], tokens: list[int]) -> np.ndarray:
    """Whole numbers of copies whose mean is the rate, decided by the hash of id and tokens."""
    u = np.array([xxhash.xxh64_intdigest(f"mix {i} {n}") for i, n in zip(ids, tokens, strict=True)], np.float64) / 2.0**64
    return np.floor(rates + u).astype(np.int32)


def _fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str, max_rate: float, labelled: int, rounds: int, id_col: str, text_col: str) -> tuple[DataFrame, Model | None, Fit]:
    """The written table of chances, the classifier, and the rates."""
    domains, folder = list(weights), work_dir(docs.sparkSession, "mixing")
    known = labels.select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    model = fit_domains(docs, known, domains, labelled=labelled, id_col=id_col, text_col=text_col)
    table = materialise(posteriors(docs, model, len(domains), id_col=id_col, text_col=text_col), f"{folder}/chances")
    grouped = materialise(cells(table), f"{folder}/cells")
    return table, model, fit_rates(grouped, list(weights.values()), anchor=domains.index(anchor), max_rate=max_rate, rounds=rounds)


def mixture_report(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float], anchor: str = "clean", max_rate: float = 1.0, labelled: int = 6000, rounds: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a domain: domain, weight, available, wanted and reached (expected tokens), settled.

    This is where a domain shows that is scarcer than its weight asks: ``reached`` stays below ``wanted``,
    as no document's rate rises above ``max_rate``.
    """
    fit = _fit(docs, labels, weights, anchor, max_rate, labelled, rounds, id_col, text_col)[2]
    rows = [(d, float(w), float(fit.available[k]), float(fit.targets[k]), float(fit.reached[k]), bool(fit.settled)) for k, (d, w) in enumerate(weights.items())]
    return docs.sparkSession.createDataFrame(rows, "domain string, weight double, available double, wanted double, reached double, settled boolean")


def mix(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float], anchor: str = "clean", max_rate: float = 1.0, labelled: int = 6000, rounds: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, a chance p_<domain> for each domain, rate, and copies.

    Domains are the keys of ``weights``, told apart by the labelled table (``label_domain``; rows of
    other domains teach nothing); the values are their shares of the mixture.  The anchor domain is used
    whole, which sets the size of the mixture; ``mixture_report`` tells what the rates reach.  ``copies`` is
    the rate rounded by the hash of doc_id and tokens, so repeated rows fare alike.  Null text has
    no tokens and a rate like any other; texts of any length count whole; without labels all domains are
    equally likely; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    table, _, fit = _fit(docs, labels, weights, anchor, max_rate, labelled, rounds, id_col, text_col)
    steps = fit.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rate = rates_after(_matrix(batch.column("p"), batch.num_rows), steps, max_rate)
                copies = copies_of(rate, batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist())
                yield batch.append_column("rate", pa.array(rate)).append_column("copies", pa.array(copies))

    rated = table.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double, copies int")
    return rated.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(weights)], "rate", "copies")


def take_mixture(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float], anchor: str = "clean", max_rate: float = 1.0, labelled: int = 6000, rounds: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture itself: the documents with all their columns, each as often as ``mix`` gives it copies.

    A document's copies follow from its own text and id, so no join is needed: chances are computed
    once to fit the rates and once more where the documents are taken.  Nulls, empty and long texts,
    repeated rows, empty tables and other columns' names are as in ``mix``.
    """
    _, model, fit = _fit(docs, labels, weights, anchor, max_rate, labelled, rounds, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_col).to_pylist()
            tokens, p = _chances(texts, model, len(weights))
            rate = rates_after(p, fit.steps, max_rate)
            ids = batch.column(id_col).to_pylist()
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies_of(rate, ids, tokens))))

    return docs.mapInArrow(run, docs.schema)
