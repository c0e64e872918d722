"""Quality by co-training: a text-content view and a page-metadata view teach each other.

In each round both views judge every unlabelled document, in the tasks that hold it, and those of which one
is sure (and the other isn't as sure of the contrary) are counted, slot by slot, for the *other* view under
the label it gives.  From these counts a view gets log-ratios of how often a slot occurs in good and in
bad documents; then its softmax regression is fitted anew on the labelled rows, as a correction of what
the ratios say.  Views, and at the end both together, are calibrated on labelled rows that no regression
was fitted on.

The regression is fitted on the driver on at most ``labelled`` rows, chosen by the hash of doc_id.
What the unlabelled documents teach comes from all of them: only counts for each slot (2^18 at most) leave the
tasks, however many documents there are.  Every document is scored without a shuffle of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, work_dir
from .features import META_BITS, TEXT_BITS, meta_features, one_hot, text_features, train

#: Slots of the two views, their constant one included.
SIZES = ((1 << TEXT_BITS) + 1, (1 << META_BITS) + 1)
META_COLUMNS = ("lang", "source")
#: How many documents' worth of the whole corpus's proportion every slot is given beforehand.
SMOOTHING = 2.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's calibration of one or more columns: sigmoid(z w + b), with his softened targets, by Newton steps that never raise the loss.

    Columns are taken in units of their spread, and weights there drawn to 1 over the number of columns,
    so that few rows change little.  A column whose weight would be negative gets none.
    """
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = z.std(axis=0)
    spread[spread < 1e-9] = 1.0
    out, used = np.zeros(z.shape[1] + 1), np.ones(z.shape[1], bool)
    while used.any():
        x = np.column_stack([(z / spread)[:, used], np.ones(len(z))])
        start = np.append(np.full(used.sum(), 1 / z.shape[1]), 0.0)
        loss = lambda w, x=x, start=start: (np.logaddexp(0, x @ w) - target * (x @ w)).sum() + 0.05 * ((w - start) ** 2).sum()
        w = start.copy()
        for _ in range(100):
            p = _sigmoid(x @ w)
            slope = x.T @ (p - target) + 0.1 * (w - start)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), slope)
            size, now = 1.0, loss(w)
            while size > 1e-9 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            out[:-1][used], out[-1] = w[:-1] / spread[used], w[-1]
            return out
        used[np.flatnonzero(used)[w[:-1] < 0]] = False
    out[-1] = np.log(target.mean() / (1 - target.mean()))
    return out


@dataclass
class Rows:
    """Slots of many documents for one view: all in one array, and where each document's begin."""

    slots: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        sizes = [len(r) for r in rows]
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.cumsum([0, *sizes])[:-1].astype(np.int64))

    @classmethod
    def of_lists(cls, column: pa.Array) -> Rows:
        offsets = column.offsets.to_numpy()
        return cls(column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets[:-1] - offsets[0]).astype(np.int64))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of each document's weights; every document has the constant slot at least."""
        return np.add.reduceat(weights[self.slots], self.starts) if len(self.starts) else np.zeros(0)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.slots)))

    def counts(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """In how many of the chosen documents each slot occurs."""
        return np.bincount(self.slots[np.repeat(chosen, self.sizes())], minlength=size)


def log_ratios(seen: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Weights from counts (bad, good) of each slot and of documents; 0 for a slot that tells nothing."""
    if documents.min() == 0:
        return np.zeros(seen.shape[1])
    share = SMOOTHING * documents / documents.sum()
    chance = (seen + share[:, None]) / (documents + SMOOTHING)[:, None]
    return np.log(chance[1]) - np.log(chance[0]) - np.log(share[1] / (documents[1] + SMOOTHING)) + np.log(share[0] / (documents[0] + SMOOTHING))


@dataclass
class View:
    """One view: log-ratios taught by the other (a weight for their scaled sum, and a constant), the regression that corrects them, and its calibration."""

    ratios: np.ndarray
    mix: np.ndarray
    regression: np.ndarray
    line: np.ndarray

    def taught(self, rows: Rows) -> np.ndarray:
        return rows.sums(self.ratios) / np.sqrt(rows.sizes()) * self.mix[0] + self.mix[1]

    def raw(self, rows: Rows) -> np.ndarray:
        return self.taught(rows) + rows.sums(self.regression)

    def odds(self, rows: Rows) -> np.ndarray:
        return self.raw(rows) * self.line[0] + self.line[1]


@dataclass
class QualityModel:
    """Both views and the calibration of both together; without views every document gets the prior."""

    prior: float
    views: tuple[View, ...] = ()
    line: np.ndarray | None = None

    def of_rows(self, rows: tuple[Rows, Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of good quality: by text, by metadata, by both."""
        if not self.views:
            flat = np.full(len(rows[0].starts), self.prior)
            return flat, flat, flat
        odds = [view.odds(r) for view, r in zip(self.views, rows, strict=True)]
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(np.column_stack(odds) @ self.line[:-1] + self.line[-1])

    def score(self, texts: list[str | None], metas: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.of_rows((Rows.of([text_features(t) for t in texts]), Rows.of([meta_features(t, m) for t, m in zip(texts, metas, strict=True)])))


#: Of each view: counts (label, slot), and documents by label.
Counts = list[tuple[np.ndarray, np.ndarray]]


def sure_of(beliefs: tuple[np.ndarray, np.ndarray], sure: float) -> list[list[np.ndarray]]:
    """For each view and label, the documents that it hands to the other view: it is sure, and the other isn't of the contrary."""
    chances = [(1 - b, b) for b in beliefs]
    return [[(chances[v][label] >= sure) & (chances[1 - v][label] >= 1 - sure) for label in (0, 1)] for v in (0, 1)]


def count_sure(model: QualityModel, rows: tuple[Rows, Rows], sure: float) -> Counts:
    """What each view is taught by the other, of these documents."""
    picked = sure_of(model.of_rows(rows)[:2], sure)
    return [(np.stack([rows[v].counts(picked[1 - v][label], SIZES[v]) for label in (0, 1)]), np.array([picked[1 - v][label].sum() for label in (0, 1)])) for v in (0, 1)]


def co_train(rows: tuple[list[np.ndarray], list[np.ndarray]], labels: np.ndarray, teach, *, rounds: int = 2) -> QualityModel:
    """Fit from slots of labelled rows (text, metadata) and from ``teach(model)``, the counts over all unlabelled documents.

    Every fifth labelled row is kept for calibration.  Rounds end early when nothing new is taught.
    """
    good = int((labels == 1).sum())
    prior = (good + 1) / (len(labels) + 2)
    held = np.arange(len(labels)) % 5 == 0
    if min((labels[~held] == 1).sum(), (labels[~held] == 0).sum()) < 2:
        return QualityModel(1.0 if not len(labels) or good else 0.0)
    fitted, truth = labels[~held], labels[held].astype(float)
    mine = [[r for r, out in zip(own, held, strict=True) if not out] for own in rows]
    flat = [Rows.of(own) for own in mine]
    apart = [Rows.of([r for r, out in zip(own, held, strict=True) if out]) for own in rows]

    def refit(taught: Counts | None) -> QualityModel:
        views = []
        for k, size in enumerate(SIZES):
            view = View(np.zeros(size), np.zeros(2), np.zeros(size), np.array([1.0, 0.0]))
            if taught is not None:
                view.ratios = log_ratios(*taught[k])
                view.mix = _calibrate((apart[k].sums(view.ratios) / np.sqrt(apart[k].sizes()))[:, None], truth)
            known = view.taught(flat[k])[:, None] * np.array([-0.5, 0.5])
            model = train(mine[k], one_hot(fitted, 2), size, offset=known)
            view.regression[model.slots] = model.weights[:, 1] - model.weights[:, 0]
            view.line = _calibrate(view.raw(apart[k])[:, None], truth)
            views.append(view)
        odds = [view.odds(r) for view, r in zip(views, apart, strict=True)]
        return QualityModel(prior, tuple(views), _calibrate(np.column_stack(odds), truth))

    model, before = refit(None), None
    for _ in range(rounds):
        taught = teach(model)
        if before is not None and all(np.array_equal(a, b) for x, y in zip(taught, before, strict=True) for a, b in zip(x, y, strict=True)):
            break
        model, before = refit(taught), taught
    return model


def _metas(batch: pa.RecordBatch, columns: list[str]) -> list[dict]:
    return [dict(zip(columns, values, strict=True)) for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)] if columns else [{}] * batch.num_rows


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))


def feature_table(docs: DataFrame, labels: DataFrame, *, label: str, labelled: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, text_slots and meta_slots of every document, written once.

    ``label`` is the rounded mean of a document's labels, for at most ``labelled`` documents, chosen by
    hash over all labelled ids; others have null and count as unlabelled.  Null ids and labels teach nothing.
    """
    folder, meta = work_dir(docs.sparkSession, "quality"), [c for c in META_COLUMNS if c in docs.columns]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), _lists([text_features(t) for t in texts]), _lists([meta_features(t, m) for t, m in zip(texts, _metas(batch, meta), strict=True)])], ["doc_id", "label", "text_slots", "meta_slots"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # at most ``labelled`` pairs of numbers are broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *meta).join(F.broadcast(chosen), "doc_id", "left")
    rows = rows.select("doc_id", "label", "text", *meta).mapInArrow(features, "doc_id long, label int, text_slots array<int>, meta_slots array<int>")
    return materialise(rows, folder)


def taught_by(table: DataFrame, model: QualityModel, sure: float) -> Counts:
    """``count_sure`` over all unlabelled documents; each task tells a count for each slot it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counts = [(np.zeros((2, size), np.int64), np.zeros(2, np.int64)) for size in SIZES]
        for batch in batches:
            if batch.num_rows:
                for (seen, documents), (more, n) in zip(total, count_sure(model, tuple(map(Rows.of_lists, batch.columns)), sure), strict=True):
                    seen += more
                    documents += n
        for view, (seen, documents) in enumerate(total):
            at = np.flatnonzero(seen.any(axis=0))
            # the documents themselves stand at -1
            slots, bad, good = (np.append(x, y) for x, y in ((at, -1), (seen[0, at], documents[0]), (seen[1, at], documents[1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), view, np.int32)), pa.array(slots.astype(np.int32)), pa.array(bad), pa.array(good)], ["view", "slot", "bad", "good"])

    told = table.filter("label is null").select("text_slots", "meta_slots").mapInArrow(run, "view int, slot int, bad long, good long")
    got = told.groupBy("view", "slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    view, slot, bad, good = (got[c].to_numpy() for c in ("view", "slot", "bad", "good"))
    out: Counts = []
    for k, size in enumerate(SIZES):
        seen, own = np.zeros((2, size), np.int64), (view == k) & (slot >= 0)
        seen[0, slot[own]], seen[1, slot[own]] = bad[own], good[own]
        last = (view == k) & (slot < 0)
        out.append((seen, np.array([bad[last].sum(), good[last].sum()])))
    return out


def _fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", labelled: int = 10_000, rounds: int = 2, sure: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> tuple[QualityModel, DataFrame]:
    table = feature_table(docs, labels, label=label, labelled=labelled, id_col=id_col, text_col=text_col)
    # of rows that share an id one is a sample, so that the bound holds
    sample = table.filter("label is not null").groupBy("doc_id").agg(F.min(F.struct("label", "text_slots", "meta_slots")).alias("row")).select("doc_id", "row.*").toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable") if sample.num_rows else np.zeros(0, np.int64)
    rows = tuple(_in_order(sample[c], order) for c in ("text_slots", "meta_slots"))
    given = sample["label"].to_numpy()[order] if sample.num_rows else np.zeros(0, np.int64)
    return co_train(rows, given, lambda model: taught_by(table, model, sure), rounds=rounds), table


def _in_order(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    rows = [v.values.to_numpy().astype(np.int64) for v in column]
    return [rows[i] for i in order]


def fit_quality(docs: DataFrame, labels: DataFrame, **options) -> QualityModel:
    """Fit on at most ``labelled`` labelled rows and on all unlabelled documents.

    Options are those of ``score_documents``.  Without two rows of either class the model rejects
    nothing (or everything, if all labels are 0).
    """
    return _fit(docs, labels, **options)[0]


_SCORES = "doc_id long, p_text double, p_meta double, score double, keep boolean"


def _scores(ids: pa.Array, chances: tuple[np.ndarray, ...], threshold: float) -> pa.RecordBatch:
    by_text, by_meta, both = chances
    return pa.RecordBatch.from_arrays([ids, pa.array(by_text), pa.array(by_meta), pa.array(both), pa.array(both >= threshold)], ["doc_id", "p_text", "p_meta", "score", "keep"])


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_text, p_meta, score and keep (score at least ``threshold``) of every document.

    Null text counts as empty, null metadata as a value of its own; texts of any length count whole;
    repeated rows and null ids keep their rows; an empty table gives none; columns that a view doesn't
    use are ignored, whatever their names.
    """
    meta = [c for c in META_COLUMNS if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _scores(batch.column("doc_id"), model.score(batch.column("text").to_pylist(), _metas(batch, meta)), threshold)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *meta).mapInArrow(run, _SCORES)


def keep_good(docs: DataFrame, model: QualityModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that ``score_quality`` keeps, with all their columns, whatever their names.

    Nulls, empty and long texts are judged as there; repeated rows fare alike and stay repeated; an
    empty table stays empty.
    """
    meta = [c for c in META_COLUMNS if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = model.score(batch.column(text_col).to_pylist(), _metas(batch, meta))[2]
            yield batch.filter(pa.array(both >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``score_quality`` of all of ``docs`` by a model fitted on them and ``labels`` (doc_id, quality).

    Options: ``label`` (its column), ``labelled`` (the bound of labelled rows), ``rounds``, ``sure``,
    ``id_col``, ``text_col``.  Nulls, empty and long texts, ties, repeated rows and clashing names are as
    in ``score_quality``; null labels and labels of unknown documents teach nothing; labels of one
    document are averaged.
    """
    model, table = _fit(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield _scores(batch.column("doc_id"), model.of_rows((Rows.of_lists(batch.column("text_slots")), Rows.of_lists(batch.column("meta_slots")))), threshold)

    return table.select("doc_id", "text_slots", "meta_slots").mapInArrow(run, _SCORES)
