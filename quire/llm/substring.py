"""Removal of repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

Pass one hashes every window of every text at its anchoring gram (the least-hashed 12 words inside it) and adds
the anchors to partial sketches, which are merged. A window occurs no more often than its anchor, and a sketch never
underestimates, so a window estimated to occur once does occur once. Pass two groups the windows estimated repeated by
their words, and reports the places of those that are; no repeated window is lost and no other is taken for one.

What travels are *runs*: the words spanned by neighbouring windows with one anchor, so a run of k windows costs
window + k - 1 words and not k * window. Runs are dealt out by their anchor, which equal windows share. Equal runs
met together are settled there and send one on, so a passage that a third of all documents hold reaches a reducer once
a task's buffer, not once a document. In a bucket, words are numbered exactly (by their bytes), windows are
grouped by a hash of the numbers, and each group is compared number by number; a group that a hash alone has put
together is taken apart.

Cost: the texts are read twice and shuffled once (to meet their spans). Buckets are sized by the input's bytes; a task
holds the runs of one bucket, those that are alike once, and their windows a share at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import countmin, places
from .shared import partitions, trimmed, with_row_key
from .textvec import U64, Chunk, Words, anchored_runs, binary, mix, numbered, pieces, planes, prefix, ranges, same_windows, unplanes, window_hash

WINDOW = 35
GRAM = 12
_FOUND = 4_000_000  # places held before they are sent on
_HELD_BYTES = 1 << 24  # bytes of runs held before equal ones are settled
#: Windows of a bucket that are grouped at a time; a bucket with more is grouped share by share of their hashes.
_SHARE = 1 << 21


class Runs:
    """Runs side by side: ``text`` their words joined by a space, ``m`` their windows, ``known`` whether repeated elsewhere."""

    FIELDS = ("m", "known", "ids", "hashes", "lo")

    def __init__(self, text: pa.Array, m, known, ids, hashes, lo):
        self.text, self.m, self.known, self.ids, self.hashes, self.lo = text, m, known, ids, hashes, lo

    def __len__(self) -> int:
        return len(self.m)

    def take(self, i: np.ndarray) -> "Runs":
        return Runs(self.text.take(pa.array(i)), *(getattr(self, f)[i] for f in self.FIELDS))

    @staticmethod
    def join(parts: list["Runs"]) -> "Runs":
        return Runs(pa.concat_arrays([p.text for p in parts]), *(np.concatenate([getattr(p, f) for p in parts]) for f in Runs.FIELDS))

    def settle(self) -> tuple["Runs", np.ndarray, "places.Places"]:
        """(one run of each text, marked known if there were more; which these are; the places of the others' windows)."""
        code = self.text.dictionary_encode().indices.to_numpy()
        _, first = np.unique(code, return_index=True)
        many = (np.bincount(code, minlength=len(first)) > 1)[code]
        one = self.take(first)
        one.known = one.known | many[first]
        news = np.flatnonzero(many & ~self.known)
        return one, first, (self.ids[news], self.hashes[news], self.lo[news], self.m[news].astype(np.int64))


def _encode(r: Runs) -> bytes:
    docs, doc = np.unique(np.stack([r.ids, r.hashes]), axis=1, return_inverse=True)
    lens = pa.compute.binary_length(r.text).to_numpy().astype(np.uint32)
    body = (planes(lens), planes(doc.ravel().astype(np.uint32)), planes(r.lo.astype(np.uint32)), r.m.astype(np.uint16).tobytes(), r.known.astype(np.uint8).tobytes(), np.ascontiguousarray(docs).tobytes(), b"".join(r.text.to_pylist()))
    return np.array([len(r), docs.shape[1]], np.int64).tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def _decode(raw: bytes) -> Runs:
    n, d = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    b = zstandard.ZstdDecompressor().decompress(raw[16:])
    lens, doc, lo = (unplanes(b[4 * n * i : 4 * n * (i + 1)], np.uint32, n) for i in range(3))
    m, known = np.frombuffer(b, np.uint16, n, 12 * n), np.frombuffer(b, np.uint8, n, 14 * n).astype(bool)
    docs = np.frombuffer(b, np.int64, 2 * d, 15 * n).reshape(2, d)
    return Runs(binary(lens, b[15 * n + 16 * d :]), m, known, docs[0][doc], docs[1][doc], lo.astype(np.int64))


def _spaced(chunk: Chunk, words: Words) -> tuple[bytes, np.ndarray]:
    """The chunk's words, each followed by one space, and the place of each; the places end with the length."""
    sizes = words.ends - words.starts
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    out[np.arange(len(out) - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)] = chunk.buf[words.inside]
    return out.tobytes(), np.concatenate(([0], np.cumsum(sizes + 1)))


def repeated_in(runs: Runs, window: int) -> "places.Places":
    """Places of the windows of ``runs`` that occur more than once in them, or in runs known to be repeated."""
    code = runs.text.dictionary_encode()
    distinct = pa.array(code.dictionary)
    code = code.indices.to_numpy()
    weight = np.bincount(code, 1 + runs.known.astype(np.int64), minlength=len(distinct)).astype(np.int64)
    m = np.zeros(len(distinct), np.int64)
    m[code] = runs.m
    # words of the distinct runs, numbered by their bytes
    offs = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    buf = np.frombuffer(distinct.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    chunk = Chunk(buf, offs - offs[0], slice(0, len(distinct)))
    words = chunk.words()
    number = numbered(chunk, words)
    hashes = window_hash(prefix(mix(number.astype(U64) + U64(1))), window)
    starts, owner = ranges(words.offs[:-1], words.offs[:-1] + m)
    repeated = np.zeros(len(starts), bool)
    shares = -(-len(starts) // _SHARE)
    for share in range(shares):
        mine = np.flatnonzero(hashes[starts] % U64(shares) == share) if shares > 1 else np.arange(len(starts))
        repeated[mine] = same_windows(number, starts[mine], hashes[starts[mine]], weight[owner[mine]], window) > 1
    hit = np.flatnonzero(repeated)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    offset = starts - words.offs[:-1][owner]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]]))))
    count = np.diff(np.append(first, len(hit)))
    run, start = owner[hit[first]], offset[hit[first]]
    order = np.argsort(code, kind="stable")
    which, span = ranges(np.searchsorted(code[order], run), np.searchsorted(code[order], run, side="right"))
    rec = order[which]
    return runs.ids[rec], runs.hashes[rec], runs.lo[rec] + start[span], count[span]


def repeated_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rk_id, rk_hash, places): the starts, in words, of the windows whose word sequence starts elsewhere too.

    ``keyed`` comes from :func:`shared.with_row_key`. Each document with places has one row.
    """
    spark = keyed.sparkSession
    if not 0 < gram <= window or window - gram > 1 << 15:
        raise ValueError("the anchoring gram is 1 to window words long")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reducers = partitions(spark)
    log_buckets = places.log_buckets(size, reducers)
    texts = keyed.select("rk_id", "rk_hash", "text")

    def find(batch: pa.RecordBatch):
        ids, hashes = batch.column("rk_id").to_numpy(), batch.column("rk_hash").to_numpy()
        for chunk in pieces(batch, "text", window - 1, words=True):
            words = chunk.words()
            grams = window_hash(prefix(words.hashes(chunk)), gram)
            anchor, lo, hi = anchored_runs(grams, words.offs, window, gram)
            yield grams[anchor], (grams[anchor], chunk, words, lo, hi, ids, hashes)

    sketch = countmin.build(texts, find, int(size / 6 * 2 / (window - gram + 2)))

    def runs_of(keep: np.ndarray, chunk: Chunk, words: Words, lo, hi, ids, hashes) -> Runs:
        lo, hi = lo[keep], hi[keep]
        raw, at = _spaced(chunk, words)
        text = pa.array([raw[a:b] for a, b in zip(at[lo].tolist(), (at[hi + window - 1] - 1).tolist())], pa.large_binary())
        doc = np.searchsorted(words.offs, lo, side="right") - 1
        return Runs(text, (hi - lo).astype(np.uint16), np.zeros(len(lo), bool), ids[chunk.rows][doc], hashes[chunk.rows][doc], lo - words.offs[doc] + chunk.base)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Runs, np.ndarray]] = []
        n = 0

        def flush():
            r, first, settled = Runs.join([x for x, _ in held]).settle()
            bucket = np.concatenate([b for _, b in held])[first]
            held.clear()
            rows = [(b, True, raw) for b, raw in places.spread(settled, log_buckets)]
            order = np.argsort(bucket, kind="stable")
            r, bucket = r.take(order), bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows += [(int(bucket[a]), False, _encode(r.take(np.arange(a, b)))) for a, b in zip(edge, np.append(edge[1:], len(bucket)))]
            for i in range(0, len(rows), 4096):
                yield _out(rows[i : i + 4096])

        for part in sketch.filtered(batches, find):
            for keep, (keys, *rest) in part:
                if not keep.any():
                    continue
                r = runs_of(keep, *rest)
                held.append((r, (mix(keys[keep]) >> U64(64 - log_buckets)).astype(np.int64)))
                n += r.text.nbytes + 40 * len(r)
                if n >= _HELD_BYTES:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        at, found, size = None, [], 0

        def close():
            nonlocal size
            if held:
                found.append(repeated_in(Runs.join(held), window))
            held.clear()
            size = 0

        for batch in batches:
            for bucket, settled, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    close()
                    at = bucket
                if sum(len(x[0]) for x in found) > _FOUND:
                    yield from places.rows(places.spread(places.joined(found), log_buckets))
                    found.clear()
                if settled:
                    found.append(places.decode(payload))
                    continue
                held.append(_decode(payload))
                size += held[-1].text.nbytes
                if size > 2 * _HELD_BYTES:  # more than a bucket should be: alike runs are settled as they come
                    one, _, settled_here = Runs.join(held).settle()
                    found.append(settled_here)
                    held[:] = [one]
                    size = one.text.nbytes // 2
        close()
        if found:
            yield from places.rows(places.spread(places.joined(found), log_buckets))

    dealt = texts.mapInArrow(trimmed(deal), "bucket long, settled boolean, payload binary")
    found = dealt.repartition(reducers, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(group), "bucket long, payload binary")
    return places.by_document(found)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "settled", "payload"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text.

    One row for each row of ``docs``. Every word covered by a window of ``window`` words whose sequence also
    starts anywhere else, in the same document too, is removed; windows are judged on the input. Null and
    empty texts have no words and keep an empty text; a document shorter than a window keeps its words; rows that
    repeat one another lose every window, as each starts elsewhere. Texts of any length go through in pieces. Columns named
    in ``carry`` follow unchanged, others are ignored. An empty table gives an empty result. Rows with a null doc_id are
    documents of their own.
    """
    keyed = with_row_key(docs, *(x for x in carry if x != "text"), least=2 * window - 1)
    joined = keyed.join(repeated_windows(keyed, window, gram), ["rk_id", "rk_hash"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("places").to_pylist()
            n_words, n_removed, kept = [0] * len(packed), [0] * len(packed), [b""] * len(packed)
            for chunk in pieces(batch, "text", 0, words=True):
                words = chunk.words()
                raw, at = _spaced(chunk, words)
                for row, a, b in zip(range(chunk.rows.start, chunk.rows.stop), words.offs[:-1].tolist(), words.offs[1:].tolist()):
                    n_words[row] += b - a
                    if not packed[row]:
                        kept[row] += raw[at[a] : at[b]]
                        continue
                    left = places.uncovered(packed[row], window, chunk.base, chunk.base + b - a)
                    kept[row] += b"".join(raw[at[a + i - chunk.base] : at[a + j - chunk.base]] for i, j in left)
                    n_removed[row] += b - a - sum(j - i for i, j in left)
            texts = pa.array([x[:-1] for x in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), texts, *(batch.column(x) for x in carry)], ["doc_id", "n_words", "n_removed", "kept_text", *carry])

    rows = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "places", *(x for x in carry if x != "text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), *(rows.schema[x] for x in carry)])
    return rows.mapInArrow(trimmed(cut), schema)
