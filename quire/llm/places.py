"""Answers on their way back to their documents: runs of starts, packed by buckets of documents.

A task that has found places in many documents sends one row a bucket, not one a document, so the rows sent
do not multiply with the number of tasks; a bucket's rows are then merged to one row a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import partitions, trimmed
from .textvec import U64, mix, planes, unplanes

Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # rk_id, rk_hash, start, count of starts


#: Text bytes for which there is a bucket of their own, so that a bucket's size does not grow with the input.
BUCKET_BYTES = 1 << 23


def log_buckets(size: int, reducers: int) -> int:
    """log2 of the number of buckets: by the input's ``size`` in bytes, and four a reducer at least."""
    return max(6, (4 * reducers - 1).bit_length(), (size // BUCKET_BYTES).bit_length())


def bucket_of(hashes: np.ndarray, log: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(hashes).view(np.uint64)) >> U64(64 - log)).astype(np.int64)


def _edges(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))))


def _sorted(p: Places) -> Places:
    ids, hashes, starts, counts = p
    order = np.lexsort((starts, hashes, ids))
    return ids[order], hashes[order], starts[order], counts[order]


def encode(p: Places) -> bytes:
    ids, hashes, starts, counts = _sorted(p)
    edge = _edges(ids, hashes)
    head = np.array([len(ids), len(edge)], np.int64)
    delta = np.diff(starts, prepend=0).astype(np.int64)
    delta[edge] = starts[edge]
    body = (ids[edge].tobytes(), hashes[edge].tobytes(), planes(np.diff(np.append(edge, len(ids))).astype(np.uint32)), planes(delta.astype(np.uint32)), planes(counts.astype(np.uint32)))
    return head.tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def decode(raw: bytes) -> Places:
    n, d = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    b = zstandard.ZstdDecompressor().decompress(raw[16:])
    ids, hashes = np.frombuffer(b, np.int64, d), np.frombuffer(b, np.int64, d, 8 * d)
    size = unplanes(b[16 * d : 20 * d], np.uint32, d).astype(np.int64)
    delta = unplanes(b[20 * d : 20 * d + 4 * n], np.uint32, n).astype(np.int64)
    total = np.cumsum(delta)
    first = np.cumsum(size) - size
    starts = total - np.repeat(total[first] - delta[first], size) if n else total
    return np.repeat(ids, size), np.repeat(hashes, size), starts, unplanes(b[20 * d + 4 * n :], np.uint32, n).astype(np.int64)


def joined(parts: list[Places]) -> Places:
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def spread(p: Places, log: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) for each bucket of documents."""
    if not len(p[0]):
        return
    bucket = bucket_of(p[1], log)
    order = np.argsort(bucket, kind="stable")
    bucket, p = bucket[order], tuple(x[order] for x in p)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        yield int(bucket[a]), encode(tuple(x[a:b] for x in p))  # type: ignore[arg-type]


def rows(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches (bucket, payload)."""
    part: list[tuple[int, bytes]] = []
    for r in found:
        part.append(r)
        if len(part) == 1024:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _batch(part: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], ["bucket", "payload"])


def pack_runs(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted runs, those that touch or overlap made one."""
    ends = np.maximum.accumulate(starts + counts)
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(first)
    ends = ends[np.append(at[1:], len(starts)) - 1]
    starts = starts[at]
    return zstandard.ZstdCompressor(level=1).compress(planes(np.diff(starts, prepend=0).astype(np.uint32)) + planes((ends - starts).astype(np.uint32)))


def unpack_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = len(raw) // 8
    return np.cumsum(unplanes(raw[: 4 * n], np.uint32, n), dtype=np.int64), unplanes(raw[4 * n :], np.uint32, n).astype(np.int64)


def uncovered(raw: bytes, size: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """The spans of [lo, hi) that no ``size`` units from a start in the packed runs cover, in order."""
    starts, counts = unpack_runs(raw)
    stops = np.maximum.accumulate(starts + counts - 1 + size)
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1])))
    begin, end = starts[first], stops[np.append(first[1:], len(starts)) - 1]
    free = np.clip(np.stack([np.concatenate(([lo], end)), np.concatenate((begin, [hi]))]), lo, hi)
    free = free[:, free[0] < free[1]]
    return list(zip(free[0].tolist(), free[1].tolist()))


def by_document(found: DataFrame) -> DataFrame:
    """(bucket, payload) to (rk_id, rk_hash, places): one row for each document with places."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Places] = []
        at = None

        def close():
            if not held:
                return
            ids, hashes, starts, counts = _sorted(joined(held))
            held.clear()
            edge = _edges(ids, hashes)
            stop = np.append(edge[1:], len(ids))
            for a in range(0, len(edge), 4096):
                e, s = edge[a : a + 4096], stop[a : a + 4096]
                packed = [pack_runs(starts[i:j], counts[i:j]) for i, j in zip(e, s)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[e]), pa.array(hashes[e]), pa.array(packed, pa.binary())], ["rk_id", "rk_hash", "places"])

        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at:
                    yield from close()
                    at = bucket
                held.append(decode(payload))
        yield from close()

    n = partitions(found.sparkSession)
    return found.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(merge), "rk_id long, rk_hash long, places binary")
