"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector, shared by all thresholds t_1 < t_2 < ..., so that every grade's
examples teach the same scale of severity. x says which of the selected features a text has; features are hashed words
and word beginnings, lower-cased without punctuation, chosen by their association with the grades in the training rows.
The output is the expected severity, sum of k P(grade = k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import _words
from .shared import staged, trimmed
from .textvec import U64, chunks

LOG_FEATURES = 20
#: Leading bytes of a word that are features besides the word, so that inflected and compounded forms share weight.
PREFIXES = (4, 6)
#: Labelled rows that the classifier is fitted on, those of least hash: a bounded sample, as a parameter.
TRAIN_ROWS = 8_000
#: Word features kept, the most associated ones, each in at least MIN_ROWS training rows.
KEEP = 1_000
MIN_ROWS = 6
RIDGE = 0.0003
GRADES = 3


def severity_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, quality, toxic): 0 not toxic, 1 toxic, 2 toxic and of poor quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def _features(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, row of each feature, feature, its value) without repeats, chunk by chunk.

    A value is log(1 + 200 r), r the feature's share of the text's words, texts under 50 words counted as 50.
    """
    for c in chunks(batch, "text"):
        if len(c.buf):
            keys, offs = _words(c, PREFIXES)
            doc = np.repeat(np.arange(c.n), np.diff(offs)).astype(np.uint64)
            pairs, count = np.unique(np.concatenate([doc << U64(LOG_FEATURES) | (k >> U64(64 - LOG_FEATURES)) for k in keys]), return_counts=True)
            size = np.diff(offs)
        else:
            pairs, count, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(c.n, np.int64)
        row = (pairs >> U64(LOG_FEATURES)).astype(np.int64)
        value = np.log1p(200 * count / np.maximum(size[row], 50))
        yield c.rows, row, (pairs & U64((1 << LOG_FEATURES) - 1)).astype(np.int64), value, c.n


class OrdinalModel:
    """Weights of ``features`` (sorted) and the thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self.table = np.zeros(1 << LOG_FEATURES)
        self.table[features] = weights

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade) of each row of the linear score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))
        return np.diff(np.concatenate((np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))), axis=1), axis=1)


def _loss(theta, rows, cols, values, n, k, y, ridge):
    """Penalised negative log-likelihood and gradient. theta: weights, first threshold, logs of the gaps."""
    w, t = theta[:k], np.concatenate(([theta[k]], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))))
    eta = np.bincount(rows, w[cols] * values, minlength=n)
    full = np.concatenate(([-np.inf], t, [np.inf]))
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    up, lo = s(full[y + 1] - eta), s(full[y] - eta)
    p = np.maximum(up - lo, 1e-12)
    du, dl = up * (1 - up), lo * (1 - lo)
    d_eta = -(dl - du) / p  # of -log p
    grad_t = np.zeros(len(t))
    inner = y < len(t)
    np.add.at(grad_t, y[inner], -du[inner] / p[inner])
    inner = y > 0
    np.add.at(grad_t, y[inner] - 1, dl[inner] / p[inner])
    g = np.empty_like(theta)
    g[:k] = np.bincount(cols, d_eta[rows] * values, minlength=k) + ridge * n * w
    g[k] = grad_t.sum()
    gaps = np.exp(theta[k + 1 :])
    g[k + 1 :] = gaps * np.cumsum(grad_t[::-1])[::-1][1:]
    return (-np.log(p).sum() + ridge * n * (w @ w) / 2) / n, g / n


def _minimise(f, theta: np.ndarray, rounds: int = 300) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    pairs: list[tuple] = []
    value, grad = f(theta)
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        step, slope = 1.0 if pairs else 1.0 / max(1.0, np.abs(grad).max()), grad @ q
        while step > 1e-10:
            new = theta - step * q
            v, g = f(new)
            if v <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - theta, g - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y, 1 / (s @ y))]
        done = value - v < 1e-9 * max(1.0, abs(value))
        theta, value, grad = new, v, g
        if done:
            break
    return theta


_STATS = ("n", "v", "vv", "yv")


def _choose(stats: dict[str, np.ndarray], feature: np.ndarray, rows: int, mean: float, keep: int) -> np.ndarray:
    """The features whose values correlate most with the grade, of those present often enough; sorted."""
    cover = stats["yv"] - mean * stats["v"]
    spread = stats["vv"] - stats["v"] * stats["v"] / max(1, rows)
    score = np.abs(cover) / np.sqrt(np.maximum(spread, 1e-9))
    score[(stats["n"] < MIN_ROWS) | (stats["n"] > 0.5 * rows)] = -1
    order = np.lexsort((feature, -score))[:keep]
    return np.sort(feature[order[score[order] > 0]])


def fit(labelled: DataFrame, grades: int = GRADES, keep: int = KEEP) -> OrdinalModel:
    """Fit on every row of ``labelled(text, grade)``, a bounded sample. Without rows, all is grade 0.

    The features' statistics are summed by the executors; only the chosen features' values come to the driver.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 1 << LOG_FEATURES))
        for batch in batches:
            y = batch.column("grade").to_numpy()
            for part, row, feature, value, _ in _features(batch):
                for i, x in enumerate((np.ones(len(value)), value, value * value, value * y[part][row])):
                    total[i] += np.bincount(feature, x, minlength=1 << LOG_FEATURES)
        at = np.flatnonzero(total[0])
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(t[part]) for t in total)], ["feature", *_STATS])

    counts = {r.grade: r.n for r in labelled.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    if not rows:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(grades - 1, 20.0) + np.arange(grades - 1))
    mean = sum(g * n for g, n in counts.items()) / rows
    sums = labelled.select("text", "grade").mapInArrow(trimmed(summed), "feature long, " + ", ".join(f"{x} double" for x in _STATS))
    table = sums.groupBy("feature").agg(*[F.sum(x).alias(x) for x in _STATS]).where(F.col("n") >= MIN_ROWS).toPandas()  # 2**LOG_FEATURES rows at most
    best = _choose({x: table[x].to_numpy(float) for x in _STATS}, table["feature"].to_numpy(np.int64), rows, mean, keep)
    chosen = labelled.sparkSession.sparkContext.broadcast(best)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << LOG_FEATURES, -1)
        place[chosen.value] = np.arange(len(chosen.value))
        for batch in batches:
            grade = batch.column("grade")
            for part, row, feature, value, n in _features(batch):
                at = place[feature]
                row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
                cut = np.searchsorted(row, np.arange(n + 1))
                lists = [[x[a:b] for a, b in zip(cut[:-1], cut[1:])] for x in (at, value)]
                yield pa.RecordBatch.from_arrays([grade[part.start : part.stop], pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float64()))], ["grade", "features", "values"])

    got = labelled.select("text", "grade").mapInArrow(trimmed(extract), "grade int, features array<int>, values array<double>").toArrow()  # the sample's rows, chosen features only
    y = got["grade"].to_numpy().astype(np.int64)
    sizes = got["features"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    cols, values = (pa.concat_arrays([x.flatten() for x in got[c].chunks]).to_numpy() for c in ("features", "values"))
    return fit_arrays(y, np.repeat(np.arange(len(y)), sizes), cols, values, grades, best)


def fit_arrays(y: np.ndarray, of: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: int, best: np.ndarray) -> OrdinalModel:
    """Fit on grades ``y`` and, of rows ``of``, the features ``best[cols]`` with their values."""
    k = len(best)
    shares = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / len(y), 1e-4, 1 - 1e-4)
    t0 = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(t0), 1e-3))
    theta = _minimise(lambda th: _loss(th, of, cols, values, len(y), k, y, RIDGE), np.concatenate((np.zeros(k), t0[:1], gaps)))
    thresholds = np.concatenate(([theta[k]], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))))
    return OrdinalModel(best, theta[:k], thresholds)


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity, grade, toxic, p_toxic: one row for each row of ``docs``.

    severity is the expected grade; grade the likeliest (ties: the lower); toxic where P(grade >= 1) >= 0.5. Whole texts
    are read. Null and empty texts have no features and get the thresholds' own severity, as has a text of unknown
    words. Repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        for batch in batches:
            eta = [np.bincount(row, model.table[feature] * value, minlength=n) for _, row, feature, value, n in _features(batch)]
            p = model.probabilities(np.concatenate(eta) if eta else np.zeros(0))
            severity = p @ np.arange(p.shape[1])
            bad = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(p.argmax(axis=1), pa.int32()), pa.array(bad >= 0.5), pa.array(bad)], ["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, severity double, grade int, toxic boolean, p_toxic double")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, grade) of at most ``rows`` labelled documents, those of least hash; a document's worst label counts.

    Ids meet ids first; the texts of the chosen few are then picked out by a broadcast of at most ``rows`` ids.
    """
    graded = severity_grades(labels).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    ids = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = graded.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = staged(chosen, "labelled")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(texts.join(F.broadcast(chosen), "doc_id").select("text", "grade"), "training")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on a bounded sample of the labelled rows of ``docs`` and grade all of ``docs``."""
    return grade(docs, fit(training_rows(docs, labels, rows)))
