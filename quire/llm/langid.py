"""Language identification as mixture inference by expectation-maximisation.

A document is a mixture: each block of a few words is drawn from one of the learned languages, in unknown proportions.
Languages are byte n-gram distributions, counted over all training rows in one distributed pass and smoothed. For each
document, EM finds the proportions that make its blocks likeliest; languages are then left out, weakest first, as
long as the likelihood lost is less than the penalty a language costs (half a log of the blocks, as in BIC, with a
floor). The largest remaining proportion names the document, and is its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import trimmed
from .textvec import CHUNK_BYTES, U64, chunks, mix, ranges

LOG_BUCKETS = 15
GRAM = 4
BLOCK_WORDS = 4
PENALTY = 2.0
ROUNDS = 12
#: log2 of the cells of a model, languages times buckets: 64 MB is the most that is broadcast. Beyond 512 languages
#: the n-grams of each share ever fewer buckets, but no language is left out.
LOG_CELLS = 24
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the part that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, and capital two-byte Latin letters too; digits and marks made spaces."""
    b = buf.copy()
    up = (b >= 65) & (b <= 90)
    b[up] += 32
    after = np.zeros(len(b), bool)
    after[1:] = b[:-1] == 0xC3
    b[after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] += 0x20
    b[(b < 97) | ((b > 122) & (b < 128))] = 32
    return b


def log_buckets(languages: int) -> int:
    """log2 of the buckets that a model of so many languages has."""
    return max(1, min(LOG_BUCKETS, LOG_CELLS - max(1, languages - 1).bit_length()))


def _grams(chunk, log: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the gram that starts at each place, place of each word's start, words of each document).

    Grams are of lower-cased letters, one to GRAM bytes after a word's edge, or GRAM bytes inside it.
    """
    b = _lower(chunk.buf)
    n = len(b)
    letter = b != 32
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    before[chunk.offs[:-1][chunk.offs[:-1] < n]] = False
    start = letter & ~before
    edge = np.zeros(n + GRAM, bool)
    edge[:n] = ~letter
    edge[chunk.offs] = True  # a document's end closes its last word
    key = np.zeros(n, U64)
    open_ = np.ones(n, bool)
    for k in range(GRAM):
        if k:
            open_[: n - k] &= ~edge[k:n]
            open_[n - k :] = False
        part = np.zeros(n, U64)
        part[: n - k] = b[k:]
        key = key * U64(257) + np.where(open_, part + U64(1), U64(0))
    key = key * U64(2) + start
    return (mix(key + U64(1)) >> U64(64 - log)).astype(np.int64), letter, start


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log of each one's gram distribution, from every row of (text, lang) with a language."""
    rows = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    log = log_buckets(rows.agg(F.count_distinct("lang")).first()[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for c in chunks(batch, "text"):
                if not len(c.buf):
                    continue
                bucket, letter, _ = _grams(c, log)
                names, of = np.unique(langs[c.rows].astype(str), return_inverse=True)
                row = np.repeat(of, np.diff(c.offs))
                got = np.bincount(row[letter] << log | bucket[letter], minlength=len(names) << log).reshape(len(names), -1)
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + got[i]
        for name, t in total.items():
            at = np.flatnonzero(t)
            for a in range(0, len(at), 1 << 14):
                part = at[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.int64()), pa.array(t[part], pa.int64())], ["lang", "bucket", "n"])

    table = rows.mapInArrow(trimmed(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**LOG_CELLS rows at most
    names = sorted(table["lang"].unique())
    counts = np.zeros((len(names), 1 << log))
    index = {x: i for i, x in enumerate(names)}
    counts[table["lang"].map(index).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    shared = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1]) if len(names) else counts
    smoothed = counts + 50.0 * shared
    return names, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32) if len(names) else counts.astype(np.float32)


def _fit(like: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents side by side: proportions and log-likelihood. ``like``: blocks by languages."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    of = np.repeat(np.arange(len(count)), count)
    for _ in range(rounds):
        r = like * pi[of]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / count[:, None]
    total = np.log(np.maximum((like * pi[of]).sum(axis=1), 1e-300))
    return pi, np.add.reduceat(total, first)


def infer(like: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of each document's selected language set."""
    allowed = np.ones((len(count), like.shape[1]))
    pi, fit = _fit(like, first, count, allowed, ROUNDS)
    cost = np.maximum(penalty, 0.5 * np.log(count))
    active = np.arange(len(count))
    while len(active) and like.shape[1] > 1:
        mine = pi[active].copy()
        mine[allowed[active] == 0] = np.inf
        weakest = mine.shape[1] - 1 - mine[:, ::-1].argmin(axis=1)  # of equals the last goes, so that the first by name stays
        able = allowed[active].sum(axis=1) > 1
        active, weakest = active[able], weakest[able]
        if not len(active):
            break
        trial = allowed[active].copy()
        trial[np.arange(len(active)), weakest] = 0
        rows, _ = ranges(first[active], first[active] + count[active])
        at = np.cumsum(count[active]) - count[active]
        p, f = _fit(like[rows], at, count[active], trial, max(3, ROUNDS // 3))
        better = fit[active] - f < cost[active]
        active = active[better]
        allowed[active], pi[active], fit[active] = trial[better], p[better], f[better]
    return pi


def identify(docs: DataFrame, languages: list[str], logs: np.ndarray, penalty: float = PENALTY, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, proportions (a map of the selected set).

    One row for each row of ``docs(doc_id, text)``. Null texts and texts without a letter are ``und`` with score 0 and no
    proportions, and so is every text if no language was learned. Whole texts are read; ties go to the language
    first by name. Columns named in ``carry`` follow unchanged, others are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(logs.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        log = int(table.shape[0]).bit_length() - 1
        size = max(1 << 12, CHUNK_BYTES * 16 // max(16, len(names)))  # blocks times languages are held at a time
        for batch in batches:
            preds, scores, mixes = [], [], []
            for c in chunks(batch, "text", size):
                n = c.n
                share = np.zeros((n, len(names)))
                if len(c.buf) and names:
                    bucket, letter, start = _grams(c, log)
                    doc = np.repeat(np.arange(n), np.diff(c.offs))
                    word = np.cumsum(start)  # 1-based, over the chunk
                    base = np.concatenate(([0], word))[c.offs[:-1]]
                    block = (word - 1 - base[doc]) // BLOCK_WORDS
                    at = np.flatnonzero(letter)
                    if len(at):
                        d, k = doc[at], block[at]
                        edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
                        like = np.add.reduceat(table[bucket[at]], edge, axis=0).astype(np.float64)
                        like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -60.0))
                        own, first, count = np.unique(d[edge], return_index=True, return_counts=True)
                        share[own] = infer(like, first, count, penalty)
                raw = c.buf.tobytes()
                for i in range(n):
                    text_has_letter = share[i].any()
                    if text_has_letter and not _ascii_letter(raw, c.offs[i], c.offs[i + 1]):
                        text_has_letter = _LETTER.search(raw[c.offs[i] : c.offs[i + 1]].decode()) is not None
                    if not text_has_letter:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        mixes.append([])
                        continue
                    best = int(share[i].argmax())
                    preds.append(names[best])
                    scores.append(min(1.0, float(share[i][best])))
                    mixes.append([(names[j], float(share[i][j])) for j in np.flatnonzero(share[i] > 0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64())), *(batch.column(x) for x in carry)], ["doc_id", "lang_pred", "score", "proportions", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(x for x in carry if x != "text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType())), *(rows.schema[x] for x in carry)])
    return rows.mapInArrow(trimmed(run), schema)


_ASCII = regex.compile(rb"[A-Za-z]")


def _ascii_letter(raw: bytes, a: int, b: int) -> bool:
    return _ASCII.search(raw, int(a), int(b)) is not None


def predict_held_out(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions: learned from the rows that are not held out, for all rows."""
    names, logs = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, names, logs, penalty)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "proportions")
