"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

An item's seeds are all its n-grams, however common: copies of an item make its own n-grams common, so a seed left out
for its count would hide the edited copies beside them. One pass finds seeds in the texts, joins each place to the
items that have the seed, and aligns the item with the passage around it: edited and paraphrased copies keep some seed
and most of the words in order. What makes common n-grams cheap is a bound that no match can miss: a score of s needs
s / MATCH matched words, so a passage with fewer words of the item is not aligned. A pair's score is the best
alignment's, over that of a perfect copy.

Items are the query set: they are broadcast in blocks of bounded size, and each block meets all texts. Texts
are never shuffled. Words are compared lower-cased, without punctuation at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .textvec import U64, Chunk, byte_values, chunks, mix, prefix, ranges, span_hash, window_hash

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Words around a seed that are aligned, beyond the item's own length, on either side.
MARGIN = 8
#: Words of the items that one block broadcasts.
BLOCK_WORDS = 2_000_000
#: Seeds, or words of passages, that are looked at together. Bounds a worker's memory, not what is processed.
SLICE = 1 << 20
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _lower(c: Chunk) -> Chunk:
    buf = c.buf.copy()
    up = (buf >= 65) & (buf <= 90)
    buf[up] += 32
    # capitals of two-byte Latin letters
    if len(buf) > 1:
        two = np.zeros(len(buf), bool)
        two[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[two] += 32
    return Chunk(buf, c.offs, c.rows)


def _words(c: Chunk, prefixes: tuple[int, ...] | None = None) -> tuple:
    """(hash of each word, documents' ranges of words): lower-cased, punctuation cut from the ends, empty ones left out.

    With ``prefixes`` the first is a list: the words' hashes, then those of their first so many bytes, told apart.
    """
    c = _lower(c)
    w = c.words()
    core = np.flatnonzero(w.inside & ~_EDGE[c.buf])  # a word goes from its first such byte to its last
    lo, hi = np.searchsorted(core, w.starts), np.searchsorted(core, w.ends)
    full = lo < hi
    starts, ends = core[lo[full]], core[hi[full] - 1] + 1
    p = prefix(byte_values(c.buf))
    h = span_hash(p, starts, ends)
    if prefixes is not None:
        h = [h, *(mix(span_hash(p, starts, np.minimum(starts + k, ends)) ^ U64(k)) for k in prefixes)]
    offs = np.concatenate(([0], np.cumsum(full)))[w.offs]
    return h, offs


class Items:
    """A block of test items: their words' hashes and n-grams."""

    def __init__(self, ids: list[int], texts: list[str], gram: int):
        raw = [t.encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.ids, self.gram = ids, gram
        self.words, self.offs = _words(Chunk(np.frombuffer(b"".join(raw), np.uint8), offs, slice(0, len(ids)))) if ids else (np.zeros(0, U64), np.zeros(1, np.int64))
        keys, owners = [], []
        for i in range(len(ids)):
            g = grams(self.words[self.offs[i] : self.offs[i + 1]], gram)
            keys.append(np.unique(g))
            owners.append(np.full(len(keys[-1]), i))
        keys_, owners_ = (np.concatenate(keys), np.concatenate(owners)) if ids else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.argsort(keys_, kind="stable")
        self.keys, self.owners = keys_[order], owners_[order]
        self.filter = _Filter(np.unique(self.keys))
        held = np.repeat(np.arange(len(ids)), np.diff(self.offs))
        self.held = _Filter(np.unique(_of_item(self.words, held)))

    def may_match(self, words: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> np.ndarray:
        """Which passages [lo, hi) of ``words`` hold so many words of their item that the threshold can be met."""
        out = np.zeros(len(own), bool)
        need = threshold * np.diff(self.offs)[own] - 1e-9
        total = np.cumsum(hi - lo)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, side="right")))
            place, of = ranges(lo[at:to], hi[at:to])
            n = np.bincount(of[self.held.maybe(_of_item(words[place], own[at:to][of]))], minlength=to - at)
            out[at:to] = n >= need[at:to]
            at = to
        return out


class _Filter:
    """A bit table that tells most absent keys at once."""

    def __init__(self, keys: np.ndarray):
        self.log = max(16, min(26, (16 * max(1, len(keys)) - 1).bit_length()))
        self.bits = np.zeros(1 << self.log, bool)
        self.bits[keys >> U64(64 - self.log)] = True
        self.keys = keys

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Whether each key may be present; never false for one that is."""
        return self.bits[h >> U64(64 - self.log)]

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places in h whose key is present."""
        at = np.flatnonzero(self.maybe(h))
        if not len(at) or not len(self.keys):
            return at[:0]
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[j] == h[at]]


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hash of a word as one of an item."""
    return mix(words ^ mix(item.astype(U64) + U64(1)))


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of n-grams; of a shorter text, its whole word sequence."""
    if not len(words):
        return np.zeros(0, U64)
    if len(words) < gram:
        return mix(span_hash(prefix(words), np.array([0]), np.array([len(words)])) ^ U64(len(words)))
    return window_hash(prefix(words), gram)


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(best score, its end in the passage, its start there) of each (item, passage) pair, many side by side.

    Anti-diagonals are computed at once for all pairs. Ties go to the alignment that ends first.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    if not pairs:
        return out
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    size = len(pairs)
    a, b = np.zeros((size, m), U64), np.zeros((size, n), U64)
    la, lb = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = x, y
    # row i of a diagonal d is cell (i, d - i); two diagonals back are needed, with the starts of their alignments
    h1, h2 = np.zeros((size, m + 1), np.int32), np.zeros((size, m + 1), np.int32)
    s1, s2 = np.zeros((size, m + 1), np.int32), np.zeros((size, m + 1), np.int32)
    rows = np.arange(1, m + 1)
    best = np.zeros(size, np.int32)
    for d in range(2, m + n + 1):
        i = rows[(rows >= d - n) & (rows <= d - 1)]
        j = d - i
        ok = (i[None, :] <= la[:, None]) & (j[None, :] <= lb[:, None])
        same = (a[:, i - 1] == b[:, j - 1]) & ok
        diag = h2[:, i - 1] + np.where(same, MATCH, MISMATCH)
        up, left = h1[:, i - 1] + GAP, h1[:, i] + GAP
        score = np.maximum(np.maximum(diag, up), np.maximum(left, 0))
        fresh = np.where(h2[:, i - 1] > 0, s2[:, i - 1], (j - 1)[None, :])
        start = np.where(score == diag, fresh, np.where(score == up, s1[:, i - 1], s1[:, i]))
        score = np.where(ok, score, 0)
        h, s = np.zeros_like(h1), np.zeros_like(s1)
        h[:, i], s[:, i] = score, start
        top = score.max(axis=1) if len(i) else best
        gain = top > best
        if gain.any():
            k = np.flatnonzero(gain)
            c = score[k].argmax(axis=1)
            best[k] = top[k]
            out[k, 0], out[k, 1], out[k, 2] = top[k], j[c], start[k, c]
        h2, s2, h1, s1 = h1, s1, h, s
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of BLOCK_WORDS words at most (one item alone may hold more), read one block at a time."""
    ids, texts, words = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        n = len(r.text.split())
        if ids and words + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        words += n
    yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each text's best alignment with each item it contains.

    A score is between ``threshold`` and 1. Words count those left after punctuation is cut. Null texts and items,
    and those without words, match nothing; items without an id are left out; repeated items or rows match
    each time; null doc_ids are kept. Items of fewer words than ``gram`` are found whole. Empty tables give an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for ids, texts in _blocks(benchmark):
        items = spark.sparkContext.broadcast(Items(ids, texts, gram))
        found_here = _block_matches(slim, items, gram, threshold)
        found = found_here if found is None else found.unionByName(found_here)
    return found


def _text_grams(words: np.ndarray, offs: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the n-gram at each word; those over a text's end get 0, and a short text its whole sequence."""
    n = len(words)
    out = np.zeros(n, U64)
    h = window_hash(prefix(words), gram)
    out[: len(h)] = h
    size = np.diff(offs)
    for k in range(1, gram):
        last = offs[1:] - k
        out[last[size >= k]] = 0
    for d in np.flatnonzero((size > 0) & (size < gram)):
        out[offs[d]] = grams(words[offs[d] : offs[d + 1]], gram)[0]
    return out


def _block_matches(docs: DataFrame, items, gram: int, threshold: float) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        lens = np.diff(it.offs)
        for batch in batches:
            all_ids = batch.column("doc_id").to_pylist()
            hits: list[tuple] = []
            waiting: list[tuple] = []

            def settle():
                got = smith_waterman([(a, b) for *_, a, b in waiting])
                for (row, item, lo, a, _), (score, end, start) in zip(waiting, got.tolist()):
                    share = score / (MATCH * len(a))
                    if share >= threshold:
                        hits.append((row, item, share, lo + start, lo + end))  # noqa: B023
                waiting.clear()  # noqa: B023

            for c in chunks(batch, "text"):
                if not len(c.buf):
                    continue
                words, offs = _words(c)
                h = _text_grams(words, offs, gram)
                places = it.filter.places(h)
                first, last = np.searchsorted(it.keys, h[places]), np.searchsorted(it.keys, h[places], side="right")
                total = np.cumsum(last - first)
                done = 0
                while done < len(places):
                    to = max(done + 1, int(np.searchsorted(total, total[done] + SLICE, side="right")))
                    seed, which = ranges(first[done:to], last[done:to])
                    own, pos = it.owners[seed], places[done:to][which]
                    done = to
                    doc = np.searchsorted(offs, pos, side="right") - 1
                    # passages: the seeds of one item that are near each other share one
                    order = np.lexsort((pos, own, doc))
                    doc, own, pos = doc[order], own[order], pos[order]
                    reach = lens[own] + MARGIN
                    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (pos[1:] - pos[:-1] > reach[1:])))
                    edge = np.flatnonzero(new)
                    stop = np.append(edge[1:], len(pos)) - 1
                    doc, own, reach = doc[edge], own[edge], reach[edge]
                    lo, hi = np.maximum(offs[doc], pos[edge] - reach), np.minimum(offs[doc + 1], pos[stop] + gram + reach)
                    # a long chain of seeds is aligned in overlapping pieces, each longer than the item could span
                    step = 4 * reach
                    pieces, of = ranges(np.zeros(len(edge), np.int64), np.maximum(1, -(-(hi - lo - 2 * reach) // step)))
                    doc, own, lo = doc[of], own[of], lo[of] + pieces * step[of]
                    hi = np.minimum(hi[of], lo + step[of] + 2 * reach[of])
                    for k in np.flatnonzero(it.may_match(words, own, lo, hi, threshold)).tolist():
                        i, d = int(own[k]), int(doc[k])
                        waiting.append((c.rows.start + d, i, int(lo[k] - offs[d]), it.words[it.offs[i] : it.offs[i + 1]], words[lo[k] : hi[k]]))
                        if len(waiting) >= 256:
                            settle()
            if waiting:
                settle()
            best: dict[tuple, tuple] = {}
            for row, item, share, start, end in hits:
                have = best.get((row, item))
                if have is None or share > have[0]:
                    best[row, item] = (share, start, end)
            keys = list(best)
            yield pa.RecordBatch.from_arrays([pa.array([all_ids[r] for r, _ in keys], pa.int64()), pa.array([it.ids[i] for _, i in keys], pa.int64()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64())], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.mapInArrow(trimmed(align), "doc_id long, item_id long, score double, start_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The distinct doc_ids that hold a test item."""
    return matches(docs, benchmark, gram, threshold).select("doc_id").where("doc_id is not null").distinct()
