"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of transformed statistics. For every language and source, and for every language and for all
texts together, the estimate is the mean and covariance of that three quarters of the group whose covariance has the
least determinant. It is sought by concentration steps from several deterministic starts: the texts nearest to the present
estimate give the next one, and the determinant never rises. Two steps are made from each start, the one of least
determinant goes on until the determinant falls no more. A text is rejected if its squared Mahalanobis distance
from the estimate of its language and source exceeds a chi-square quantile; groups with few texts leave their verdicts to
their language, and these to all.

The covariance has fixed variances added (FLOORS squared), as statistics that are constant in a group would make it
singular: this is the regularised form of the estimate, for which the steps descend just as well. Statistics are
fixed-point numbers and all sums are of integers, so the estimate does not depend on how the rows are dealt. Distances are
ranked in bins of 1/64 of an octave; the texts in the bin where the subset ends share the weight that is left, so its size is
exact and ties need no order.

The search asks for counts and sums only, which add up over any parts of a group. A group of at most LOCAL_ROWS texts
answers in one task; a larger one in all tasks, pass by pass, and only sums meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, trimmed
from .textvec import U64, chunks, mix, numbered, prefix, same_windows, window_hash

REPEAT_WINDOW = 5
SUBSET = 0.75
#: Steps from every start, and the most steps of the best one.
FIRST_STEPS, STEPS = 2, 60
#: Texts a group needs for an estimate of its own.
MIN_GROUP = 60
#: Chance of a regular text to be rejected, were the statistics normal.
ALPHA = 1e-7
#: Texts of a group that one task may hold; estimates of larger groups are made by all tasks, so many groups at a time.
LOCAL_ROWS, BLOCK_GROUPS = 1 << 13, 100
#: Groups up to which estimates are broadcast (about 0.5 kB each); beyond it they are joined by shuffle.
MAX_BROADCAST_GROUPS = 20_000
#: Standard deviations whose squares are added to the statistics' variances.
FLOORS = (0.8, 0.12, 0.04, 0.05, 0.08, 0.06)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
D = len(FLOORS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for c in chunks(batch, "text"):
                w, buf, n = c.words(), c.buf, len(c.buf)
                per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[c.offs])  # noqa: B023, E731
                follow = (buf & 0xC0) == 0x80
                upper = (buf >= 65) & (buf <= 90)
                if n > 1:
                    upper[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
                repeat = _repeat_words(c, w)
                raw, dup = buf.tobytes(), []
                for a, b in zip(c.offs[:-1].tolist(), c.offs[1:].tolist()):
                    lines = [x for x in raw[a:b].split(b"\n") if not x.isspace() and x] if b > a else []
                    dup.append(len(lines) - len(set(lines)))
                out.append(np.stack([np.diff(w.offs), per(w.inside & ~follow), per(_SYMBOL[buf]), np.array(dup, np.int64), repeat, per(upper)]))
            table = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(x, pa.int64()) for x in table)], ["doc_id", "lang", "source", *_STATS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in _STATS))


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


def _repeat_words(c, w) -> np.ndarray:
    """Words inside windows of five words that the same text has twice or more."""
    total = len(w.starts)
    if total < REPEAT_WINDOW:
        return np.zeros(c.n, np.int64)
    number = numbered(c, w)
    h = window_hash(prefix(mix(number.astype(U64) + U64(1))), REPEAT_WINDOW)
    doc = np.repeat(np.arange(c.n), np.diff(w.offs))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + REPEAT_WINDOW <= w.offs[1:][doc])
    own = doc[at]
    many = same_windows(number, at, mix(h[at] ^ mix(own.astype(U64) + U64(1))), np.ones(len(at), np.int64), REPEAT_WINDOW, own)
    hit = at[many > 1]
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + REPEAT_WINDOW, -1)
    return np.diff(np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))[w.offs])


def chi_square_cut(tail: float, d: int = D) -> float:
    """x with P(chi-square of even d > x) = tail."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        sf = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))
        lo, hi = (x, hi) if sf > tail else (lo, x)
    return lo


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log1p("n_words"), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_upper") / chars)]


_X = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
#: Fixed point: a statistic is a whole number of these parts, less than 2**21 of them. log2 of the parts in a bin.
ONE, _X_BIN = 1 << 16, 10
_D_BIN = 64  # bins of an octave of distance
_SPLIT = 32  # low bits of a sum of products, which are added up apart
_ESTIMATE = "grp string, mu array<double>, inv array<double>, logdet double, cut int"
_FIELDS = ["grp", "mu", "inv", "logdet", "cut"]

Answer = dict[tuple[int, int, int], int]


def _fixed(c: Column) -> Column:
    return F.round(c * F.lit(float(ONE))).cast("long")


def _distance() -> Column:
    """Squared Mahalanobis distance of the statistics from ``mu`` by ``inv``."""
    dev = [F.col(x) / F.lit(float(ONE)) - F.col("mu")[i] for i, x in enumerate(_X)]
    return sum((F.col("inv")[i * D + j] * dev[i] * dev[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _distance_bins(x: np.ndarray, mu: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """The bin of each row's squared distance; the same for a row in whatever company."""
    dev = [x[:, i] / ONE - mu[i] for i in range(D)]
    d = np.ones(len(x))
    for i, j in _PAIRS:
        d = d + inv[i, j] * (1 if i == j else 2) * dev[i] * dev[j]
    mantissa, exponent = np.frexp(np.maximum(d, 1.0))
    return (exponent.astype(np.int64) - 1) * _D_BIN + ((mantissa - 0.5) * (2 * _D_BIN)).astype(np.int64)


def _add(out: Answer, k: int, flag: int, x: np.ndarray) -> None:
    """Add the number of rows, their sums and the sums of their products, split, under (k, place, flag)."""
    if not len(x):
        return
    out[k, 0, flag] = out.get((k, 0, flag), 0) + len(x)
    for a in range(0, len(x), 1 << 20):  # sums of so many products of 42 bits fit
        part = x[a : a + (1 << 20)]
        values = [*part.sum(axis=0).tolist(), *(int((part[:, i] * part[:, j]).sum()) for i, j in _PAIRS)]
        for at, v in enumerate(values):
            out[k, 1 + at, flag] = out.get((k, 1 + at, flag), 0) + v


def answer(x: np.ndarray, request: tuple) -> Answer:
    """Counts and sums that ``request`` asks for, over the rows of ``x`` (fixed point); they add up over parts."""
    kind, *args = request
    out: Answer = {}
    if kind == "centres":
        for i in range(D):
            bins, n = np.unique(x[:, i] >> _X_BIN, return_counts=True)
            out |= {(i, b, 0): c for b, c in zip(bins.tolist(), n.tolist())}
    elif kind == "starts":
        mid, dev = args
        z = (x / ONE - mid) / dev
        norm = np.ones(len(x)) * 1e-12
        for i in range(D):
            norm = norm + z[:, i] * z[:, i]
        for k, v in enumerate((z / (1 + np.abs(z)), z / np.sqrt(norm)[:, None])):
            _add(out, k + 1, 0, np.rint((v + 1) * ONE).astype(np.int64))
        _add(out, 3, 0, x)
    else:
        for k, (mu, inv, *_) in enumerate(args[0]):
            bins = _distance_bins(x, mu, inv)
            if kind == "rank":
                own, n = np.unique(bins, return_counts=True)
                out |= {(k, b, 0): c for b, c in zip(own.tolist(), n.tolist())}
            else:
                _add(out, k, 0, x[bins < args[1][k][0]])
                _add(out, k, 1, x[bins == args[1][k][0]])
    return out


def _covariance(got: Answer, k: int, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums, those under each flag weighted by (times, over); exact up to the division."""
    over = math.prod(o for _, o in weights)
    total = [sum(got.get((k, at, flag), 0) * (t * over // o) for flag, (t, o) in enumerate(weights)) for at in range(1 + D + len(_PAIRS))]
    n, s, ss = total[0], total[1 : 1 + D], total[1 + D :]
    cov = np.zeros((D, D))
    for (i, j), v in zip(_PAIRS, ss):
        cov[i, j] = cov[j, i] = (n * v - s[i] * s[j]) / (n * n) / ONE**2
    return np.array([v / n / ONE for v in s]), cov


def _estimate(mu: np.ndarray, cov: np.ndarray) -> tuple:
    """(mean, inverse covariance, log determinant), the floors added."""
    cov = cov + np.diag(np.square(FLOORS))
    return mu, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _quantile(bins: dict[int, int], rank: float) -> int:
    """The bin in which the ``rank``-th of the counted values lies."""
    seen = 0
    for b in sorted(bins):
        seen += bins[b]
        if seen >= rank:
            break
    return b


def _step(estimates: list[tuple], subset: float):
    """A concentration step of each estimate: the new ones, and the bins in which their subsets ended."""
    counts = yield ("rank", estimates)
    cuts = []
    for k in range(len(estimates)):
        bins = {b: n for (own, b, _), n in counts.items() if own == k}
        size = math.ceil(subset * sum(bins.values()))
        at = _quantile(bins, size)
        cuts.append((at, size - sum(n for b, n in bins.items() if b < at), bins[at]))
    sums = yield ("sums", estimates, cuts)
    return [_estimate(*_covariance(sums, k, ((1, 1), (rest, ties)))) for k, (_, rest, ties) in enumerate(cuts)], [c for c, _, _ in cuts]


def search(subset: float = SUBSET, steps: int = STEPS):
    """A group's search, as a generator: yields requests, is sent answers, returns (mean, inverse, log determinant, cut).

    The starts: medians with independent statistics, or with the correlations of bounded statistics or of directions;
    and the plain moments of the whole group.
    """
    counts = yield ("centres",)
    mid, dev = np.zeros(D), np.zeros(D)
    for i in range(D):
        bins = {b: n for (own, b, _), n in counts.items() if own == i}
        half = sum(bins.values()) / 2
        m = _quantile(bins, half)
        away: dict[int, int] = {}
        for b, n in bins.items():
            away[abs(b - m)] = away.get(abs(b - m), 0) + n
        part = (1 << _X_BIN) / ONE
        mid[i], dev[i] = (m + 0.5) * part, max(1.4826 * _quantile(away, half) * part, FLOORS[i])
    sums = yield ("starts", mid, dev)
    found = [_estimate(mid, np.diag(dev * dev))]
    for k in (1, 2):
        cov = _covariance(sums, k, ((1, 1),))[1]
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        found.append(_estimate(mid, cov / np.outer(sd, sd) * np.outer(dev, dev)))
    found.append(_estimate(*_covariance(sums, 3, ((1, 1),))))
    cuts = [0] * len(found)
    for _ in range(FIRST_STEPS):
        found, cuts = yield from _step(found, subset)
    k = min(range(len(found)), key=lambda k: (round(found[k][2], 9), k))
    best, cut = found[k], cuts[k]
    for _ in range(steps):
        (new,), (at,) = yield from _step([best], subset)
        if new[2] >= best[2] - 1e-9:
            break
        best, cut = new, at
    return *best, cut


def _finished(grp: str, result: tuple) -> tuple:
    mu, inv, logdet, cut = result
    return grp, mu.tolist(), inv.ravel().tolist(), logdet, cut


def _alone(subset: float, steps: int):
    """The whole search in one task, for a group of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, going = pdf[_X].to_numpy(np.int64), search(subset, steps)
        request = next(going)
        while True:
            try:
                request = going.send(answer(x, request))
            except StopIteration as end:
                return pd.DataFrame([_finished(pdf["grp"].iloc[0], end.value)], columns=_FIELDS)

    return run


def _together(vectors: DataFrame, names: list[str], subset: float, steps: int) -> list[tuple]:
    """The searches of large groups side by side: every pass answers the requests of all, in all tasks."""
    spark = vectors.sparkSession
    going = {name: search(subset, steps) for name in names}
    requests = {name: next(g) for name, g in going.items()}
    out = []
    while requests:
        asked = spark.sparkContext.broadcast(requests)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, int] = {}

            def flush():
                keys = list(total)
                columns = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3))]
                split = [total[k] >> _SPLIT for k in keys], [total[k] & ((1 << _SPLIT) - 1) for k in keys]
                total.clear()
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in split)], ["grp", "k", "at", "flag", "high", "low"])

            for batch in batches:
                grp = batch.column("grp").dictionary_encode()
                x = np.stack([batch.column(c).to_numpy() for c in _X], axis=1)
                code = grp.indices.to_numpy()
                for i, name in enumerate(grp.dictionary.to_pylist()):
                    if (request := asked.value.get(name)) is not None:
                        for key, n in answer(x[code == i], request).items():
                            total[name, *key] = total.get((name, *key), 0) + n
                if len(total) > 200_000:
                    yield flush()
            yield flush()

        rows = vectors.where(F.col("grp").isin(list(requests))).mapInArrow(trimmed(partial), "grp string, k long, at long, flag long, high long, low long")  # noqa: B023
        got: dict[str, Answer] = {}
        for r in rows.groupBy("grp", "k", "at", "flag").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # bins and sums of BLOCK_GROUPS groups at most
            got.setdefault(r.grp, {})[r.k, r["at"], r.flag] = (r.high << _SPLIT) + r.low
        asked.unpersist()
        now, requests = list(requests), {}
        for name in now:
            try:
                requests[name] = going[name].send(got[name])
            except StopIteration as end:
                out.append(_finished(name, end.value))
    return out


def estimates(vectors: DataFrame, subset: float = SUBSET, steps: int = STEPS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(grp, mu, inv, logdet, cut): the estimate of every group of ``vectors(grp, x0...)`` with texts enough.

    The statistics are fixed-point numbers, in ONE-th parts. ``cut`` is the bin of distance in which the subset ends.
    """
    spark = vectors.sparkSession
    sizes = staged(vectors.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_GROUP), "groups")
    few = vectors.join(sizes.where(F.col("size") <= local_rows).select("grp"), "grp")
    out = few.groupBy("grp").applyInPandas(_alone(subset, steps), _ESTIMATE)
    large = [r.grp for r in sizes.where(F.col("size") > local_rows).orderBy("grp").select("grp").collect()]  # one of local_rows texts at most
    for a in range(0, len(large), BLOCK_GROUPS):
        out = out.unionByName(spark.createDataFrame(_together(vectors, large[a : a + BLOCK_GROUPS], subset, steps), _ESTIMATE))
    return out


def scale(subset: float = SUBSET) -> Column:
    """What distances are divided by, so that the subset's share of normal statistics would be within its quantile."""
    end = F.pow(F.lit(2.0), F.floor((F.col("cut") + 1) / _D_BIN)) * (1 + (F.col("cut") + 1) % _D_BIN / F.lit(float(_D_BIN))) - 1
    return F.greatest(end / F.lit(chi_square_cut(1 - subset)), F.lit(1.0))


def judge(docs: DataFrame, alpha: float = ALPHA, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """doc_id, the statistics, base_failed, distance, kept: one row for each row of ``docs``.

    A null text has no words. Null and empty lang or source are one group. Texts that fail the base rules (fewer than 10
    words, or over 20 % of the words in repeated windows) take no part in the estimates and are not kept. Where no
    group has MIN_GROUP texts, the rest are kept, with a null distance. Repeated rows count each time. An
    empty table gives an empty result; other columns are ignored.
    """
    s = statistics(docs).withColumn("base_failed", base_failed())
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    fine, mid, top = F.concat(F.lit("2"), name("lang"), F.lit("\u0001"), name("source")), F.concat(F.lit("1"), name("lang")), F.lit("0")
    s = staged(s.withColumns({x: _fixed(v) for x, v in zip(_X, _vector())}), "vectors")
    vectors = s.where(~F.col("base_failed")).select(F.explode(F.array(fine, mid, top)).alias("grp"), *_X)
    found = staged(estimates(vectors, subset, steps).withColumn("scale", scale(subset)), "estimates")
    small = found.count() <= MAX_BROADCAST_GROUPS
    cols = ["mu", "inv", "scale"]
    for level, grp in (("f", fine), ("m", mid), ("t", top)):
        part = found.select(F.col("grp").alias(f"{level}_grp"), F.struct(*cols).alias(f"{level}_est"))
        s = s.withColumn("g", grp).join(F.broadcast(part) if small else part, F.col("g") == F.col(f"{level}_grp"), "left").drop("g", f"{level}_grp")
    s = s.withColumn("e", F.coalesce("f_est", "m_est", "t_est")).withColumns({c: F.col(f"e.{c}") for c in cols})
    s = s.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(chi_square_cut(alpha)), F.lit(True))
    return s.select("doc_id", "lang", "source", *_STATS, "base_failed", "distance", kept.alias("kept"))
