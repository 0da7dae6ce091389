"""Removal of byte strings that start in an earlier document too, by depth-limited radix sorting of suffixes.

Only the first ``depth`` bytes of a suffix matter, so suffixes are ordered no further:

* Before the sort, a counting pass and a deal. They go by a suffix's *anchor*, the least-hashed ``gram`` bytes within its
  first ``depth`` (not its leading bytes: equal suffixes have equal anchors all the same, and neighbouring suffixes share
  one). Anchors counted once (by a merged count-min sketch, never an underestimate) end there: their suffixes
  are singletons. The rest go to buckets by anchor. Suffixes that share an anchor and stand next to each other travel
  as one *run*, the bytes they span, so a run of k suffixes costs depth + k - 1 bytes and not k * depth.
* In a bucket, most-significant-digit passes of eight bytes, from the leading bytes on, split groups of suffixes and put
  singletons aside, until ``depth`` bytes are used up: the groups left are exactly the repeated strings. Bytes are
  compared, not hashes. A bucket of very many suffixes is sorted a share of the first digits at a time.

Equal runs of one piece of input are settled before the deal against the smallest doc_id among them, so a passage in
a third of all documents sends one run a piece to its bucket. Equal runs in a bucket are kept and sorted once. Buckets are
sized by the input's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import countmin, places
from .shared import partitions, trimmed, with_row_key
from .textvec import U64, anchored_runs, byte_values, chunks, mix, pieces, planes, prefix, ranges, unplanes, window_hash

DEPTH = 50
GRAM = 16
_PENDING = 120_000  # runs held before they are dealt
_FOUND = 4_000_000  # places held before they are sent on
#: Suffixes of a bucket that are sorted at a time.
_SHARE = 1 << 22


def _first(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def sort_to_depth(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes of ``flat`` at ``starts``.

    Returns (members, group): indices into ``starts`` of suffixes that share their first ``depth`` bytes with
    another, ordered by group.
    """
    members, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    at = 0
    while at < depth and len(members):
        size = next(s for s in (8, 4, 2, 1) if s <= depth - at)
        digits = np.ndarray((len(flat) - size + 1,), f">u{size}", flat.data, strides=(1,))
        digit = digits[starts[members] + at].astype(np.uint64)
        order = np.lexsort((digit, group)) if at else np.argsort(digit)
        members, group, digit = members[order], group[order], digit[order]
        edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))))
        count = np.diff(np.append(edge, len(members)))
        keep = np.repeat(count > 1, count)
        members, group = members[keep], np.repeat(np.arange(len(edge)), count)[keep]
        at += size
    return members, group


class _Runs:
    """Runs side by side: ``ctx`` rows of bytes padded with zeros and closed by their count of suffixes."""

    FIELDS = ("ctx", "m", "ids", "hashes", "lo")

    def __init__(self, ctx, m, ids, hashes, lo):
        self.ctx, self.m, self.ids, self.hashes, self.lo = ctx, m, ids, hashes, lo

    def take(self, i) -> "_Runs":
        return _Runs(*(getattr(self, f)[i] for f in self.FIELDS))

    @staticmethod
    def join(parts: list) -> "_Runs":
        return _Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in _Runs.FIELDS))

    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one row of each distinct run, every row's distinct run, the least id that holds it)."""
        rows = np.ascontiguousarray(self.ctx).view(np.dtype((np.void, self.ctx.shape[1]))).ravel()
        _, at, of = np.unique(rows, return_index=True, return_inverse=True)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.ids)
        return at, of, least


def _encode(r: _Runs, depth: int) -> bytes:
    docs, doc = np.unique(np.stack([r.ids, r.hashes]), axis=1, return_inverse=True)
    used = np.arange(r.ctx.shape[1] - 1) < (r.m.astype(np.int64) + depth - 1)[:, None]
    body = (planes(doc.ravel().astype(np.uint32)), planes(r.lo.astype(np.uint32)), r.m.astype(np.uint8).tobytes(), np.ascontiguousarray(docs).tobytes(), r.ctx[:, :-1][used].tobytes())
    return np.array([len(r.m), docs.shape[1]], np.int64).tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def _decode(raw: bytes, depth: int, wide: int) -> _Runs:
    n, d = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    b = zstandard.ZstdDecompressor().decompress(raw[16:])
    doc, lo, m = unplanes(b[: 4 * n], np.uint32, n), unplanes(b[4 * n : 8 * n], np.uint32, n), np.frombuffer(b, np.uint8, n, 8 * n)
    docs = np.frombuffer(b, np.int64, 2 * d, 9 * n).reshape(2, d)
    ctx = np.zeros((n, wide), np.uint8)
    used = np.arange(wide - 1) < (m.astype(np.int64) + depth - 1)[:, None]
    ctx[:, :-1][used] = np.frombuffer(b, np.uint8, -1, 9 * n + 16 * d)
    ctx[:, -1] = m
    return _Runs(ctx, m, docs[0][doc], docs[1][doc], lo.astype(np.int64))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "settled", "payload"])


def earlier_strings(keyed: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(rk_id, rk_hash, places): runs of starts whose ``depth`` bytes also start in a document of smaller rk_id."""
    spark = keyed.sparkSession
    if not 0 < gram <= depth or depth - gram > 254:
        raise ValueError("the leading digit is 1 to depth bytes long, and at most 254 shorter than the depth")
    wide = depth + (depth - gram) + 1  # a run has depth - gram + 1 suffixes at most
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reducers = partitions(spark)
    log_buckets = places.log_buckets(size, reducers)
    texts = keyed.select("rk_id", "rk_hash", "text")

    def find(batch: pa.RecordBatch):
        ids, hashes = batch.column("rk_id").to_numpy(), batch.column("rk_hash").to_numpy()
        for chunk in pieces(batch, "text", depth - 1, words=False):
            grams = window_hash(prefix(byte_values(chunk.buf)), gram)
            anchor, lo, hi = anchored_runs(grams, chunk.offs, depth, gram)
            yield grams[anchor], (grams[anchor], chunk, lo, hi, ids, hashes)

    sketch = countmin.build(texts, find, int(size * 2 / (depth - gram + 2)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, n = [], 0

        def flush():
            r = _Runs.join([p for p, _ in pending])
            bucket = np.concatenate([b for _, b in pending])
            pending.clear()
            _, of, least = r.alike()
            later = r.ids > least[of]
            s = r.take(later)
            rows = [(b, True, raw) for b, raw in places.spread((s.ids, s.hashes, s.lo, s.m.astype(np.int64)), log_buckets)]
            r, bucket = r.take(~later), bucket[~later]
            order = np.argsort(bucket, kind="stable")
            r, bucket = r.take(order), bucket[order]
            edge = _first(bucket)
            rows += [(int(bucket[i]), False, _encode(r.take(slice(i, j)), depth)) for i, j in zip(edge, np.append(edge[1:], len(bucket)))]
            for i in range(0, len(rows), 4096):
                yield _out(rows[i : i + 4096])

        for part in sketch.filtered(batches, find):
            for keep, (keys, chunk, lo, hi, ids, hashes) in part:
                lo, hi = lo[keep], hi[keep]
                if not len(lo):
                    continue
                doc = np.searchsorted(chunk.offs, lo, side="right") - 1
                m = hi - lo
                at = lo[:, None] + np.arange(wide - 1)
                ctx = np.zeros((len(lo), wide), np.uint8)
                ctx[:, :-1] = np.where(np.arange(wide - 1) < (m + depth - 1)[:, None], chunk.buf[np.minimum(at, len(chunk.buf) - 1)], 0)
                ctx[:, -1] = m
                own = _Runs(ctx, m.astype(np.uint8), ids[chunk.rows][doc], hashes[chunk.rows][doc], lo - chunk.offs[doc] + chunk.base)
                pending.append((own, (mix(keys[keep]) >> U64(64 - log_buckets)).astype(np.int64)))
                n += len(lo)
                if n >= _PENDING:
                    yield from flush()
                    n = 0
        if pending:
            yield from flush()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at, found, n = None, [], 0

        def compact() -> tuple[_Runs, np.ndarray, np.ndarray, np.ndarray]:
            """What is held, without the runs that an earlier document has: their suffixes are found."""
            r = _Runs.join(held)
            one, of, least = r.alike()
            later = r.ids > least[of]
            found.append((r.ids[later], r.hashes[later], r.lo[later], r.m[later].astype(np.int64)))
            return r.take(~later), r.ctx[one], of[~later], least

        def close():
            nonlocal n
            if not held:
                return
            r, ctx, of, least = compact()
            held.clear()
            n = 0
            m = ctx[:, -1].astype(np.int64)
            offset, owner = ranges(np.zeros(len(m), np.int64), m)  # every suffix of every distinct run
            flat = np.append(ctx.ravel(), np.zeros(8, np.uint8))
            hits = []
            shares = -(-len(owner) // _SHARE)
            for share in range(shares):
                mine = np.arange(len(owner))
                if shares > 1:
                    digits = np.ndarray((len(flat) - 7,), ">u8", flat.data, strides=(1,))
                    mine = np.flatnonzero(mix(digits[owner * wide + offset].astype(np.uint64)) % U64(shares) == share) if depth >= 8 else mine if not share else mine[:0]
                members, group = sort_to_depth(flat, owner[mine] * wide + offset[mine], depth)
                if len(members):
                    members = mine[members]
                    ids = least[owner[members]]
                    edge = _first(group)
                    low = np.repeat(np.minimum.reduceat(ids, edge), np.diff(np.append(edge, len(group))))
                    hits.append(members[ids > low])
            hit = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            if len(hit):
                first = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]]))))
                count = np.diff(np.append(first, len(hit)))
                run, start = owner[hit[first]], offset[hit[first]]
                # every occurrence, in its earliest document, of a run with hits
                here = np.argsort(of, kind="stable")
                a, b = np.searchsorted(of[here], run), np.searchsorted(of[here], run, side="right")
                which, span = ranges(a, b)
                rec = here[which]
                found.append((r.ids[rec], r.hashes[rec], r.lo[rec] + start[span], count[span]))

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
                held.append(_decode(payload, depth, wide))
                n += len(held[-1].m)
                if n > 4 * _PENDING:  # more than a bucket should be: runs of earlier documents are settled as they come
                    held[:] = [compact()[0]]
                    n = len(held[0].m) // 2
        close()
        if found:
            yield from places.rows(places.spread(places.joined(found), log_buckets))

    dealt = texts.mapInArrow(trimmed(deal), "bucket long, settled boolean, payload binary")
    found = dealt.repartition(reducers, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(finish), "bucket long, payload binary")
    return places.by_document(found)


def remove_earlier_strings(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row for each row of ``docs``.

    Every byte covered by a ``depth``-byte string that also starts in a document with a smaller doc_id is removed,
    judged on the input; matches never cross documents and overlaps count. Null and empty texts have no bytes. Texts
    shorter than ``depth`` keep theirs. A row with a null doc_id counts as having the largest; rows that share a
    doc_id never remove from each other. Texts of any length go through in pieces. An empty table gives an empty result; other columns are ignored.
    ``n_spans`` counts maximal removed runs. ``kept`` may split a character, so it is bytes.
    """
    keyed = with_row_key(docs, least=depth)
    joined = keyed.join(earlier_strings(keyed, depth, gram), ["rk_id", "rk_hash"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = batch.column("doc_id"), batch.column("places").to_pylist()
            for chunk in chunks(batch, "text"):
                removed, spans, kept, raw = [], [], [], chunk.buf.tobytes()
                for found, a, b in zip(packed[chunk.rows], chunk.offs[:-1].tolist(), chunk.offs[1:].tolist()):
                    left = places.uncovered(found, depth, 0, b - a) if found else [(0, b - a)]
                    kept.append(b"".join(raw[a + i : a + j] for i, j in left))
                    removed.append(b - a - len(kept[-1]))
                    inner = len(left) - 1 if left else 0  # removed spans lie between those left, and at the ends
                    spans.append(0 if not found else inner + (left[0][0] > 0) + (left[-1][1] < b - a) if left else 1)
                yield pa.RecordBatch.from_arrays([ids[chunk.rows.start : chunk.rows.stop], pa.array(np.diff(chunk.offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "places").mapInArrow(trimmed(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
