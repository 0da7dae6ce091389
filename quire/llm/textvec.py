"""Vectorised views of text batches: bytes, words, rolling hashes, anchors.

Everything here works on one *chunk*: the UTF-8 bytes of some whole documents laid end to end, with
document offsets. Nothing crosses a document edge. :func:`chunks` never splits a document; :func:`pieces` deals one longer
than ``CHUNK_BYTES`` out in pieces that overlap by all but one unit of a window, so each window is in just one piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes gathered into one chunk. Bounds a worker's memory, not what is processed.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
#: Words are runs of anything but these ASCII bytes: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, (1 << 20) + (1 << 14))
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each span [start, end), equal for equal contents wherever they stand."""
    inverse = _power(pow(base, -1, 1 << 64), len(p))
    return mix((p[ends] - p[starts]) * inverse[starts])


def window_hash(p: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """span_hash of [i, i + size) for every i."""
    n = len(p) - size
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return mix((p[size:] - p[:n]) * _power(pow(base, -1, 1 << 64), n))


class Chunk:
    """Documents: ``buf`` their bytes, ``offs`` their edges, ``rows`` their place in the batch.

    ``base``: the unit at which each begins, if it is a piece of a longer document, or 0.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, rows: slice, base: int = 0):
        self.buf, self.offs, self.rows, self.base = buf, offs, rows, base
        self.n = len(offs) - 1

    def words(self) -> "Words":
        return Words(self)


class Words:
    """``starts``/``ends`` of each word in the chunk's bytes; ``offs``: each document's range of words."""

    def __init__(self, chunk: Chunk):
        buf, offs, n = chunk.buf, chunk.offs, len(chunk.buf)
        inside = ~_SPACE[buf]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offs = np.searchsorted(self.starts, offs)

    def hashes(self, chunk: Chunk, base: int = _BASE) -> np.ndarray:
        return span_hash(prefix(_BYTE[chunk.buf], base), self.starts, self.ends, base)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The batch's documents, whole, in chunks of about ``size`` bytes."""
    buf, offs = text_buffer(batch.column(column))
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        to = min(to, n)
        yield Chunk(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at], slice(at, to))
        at = to


def pieces(batch: pa.RecordBatch, column: str, overlap: int, words: bool, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """As :func:`chunks`, but a document of more than ``size`` bytes comes in pieces of about that many.

    Units are words or bytes. A piece reaches ``overlap`` units into the next, so windows of ``overlap + 1`` units
    that start before a cut are whole; ``base`` counts the units before the piece. A word is never cut.
    """
    for c in chunks(batch, column, size):
        n = len(c.buf)
        if c.n > 1 or n <= size:
            yield c
            continue
        a = base = 0
        while a < n:
            b = min(n, a + size)
            if words:
                b = _next_space(c.buf, b)
                stop = _words_on(c.buf, b, overlap)
            else:
                stop = min(n, b + overlap)
            yield Chunk(c.buf[a:stop], np.array([0, stop - a]), c.rows, base)
            base += len(Words(Chunk(c.buf[a:b], np.array([0, b - a]), c.rows)).starts) if words else b - a
            if stop == n and (not words or b == n):
                break
            a = b


def _next_space(buf: np.ndarray, at: int) -> int:
    step = 1 << 12
    while at < len(buf):
        found = _SPACE[buf[at : at + step]]
        if found.any():
            return at + int(found.argmax())
        at, step = at + step, 2 * step
    return len(buf)


def _words_on(buf: np.ndarray, at: int, count: int) -> int:
    """The end of the ``count``-th word after ``at``, or of the text."""
    step = 1 << 12
    while True:
        part = buf[at : at + step]
        ends = Words(Chunk(part, np.array([0, len(part)]), slice(0, 1))).ends
        if len(ends) > count:  # the last one may be cut
            return at + int(ends[count - 1]) if count else at
        if at + step >= len(buf):
            return len(buf)
        step *= 2


_INDEX = 28  # bits of a sliding-minimum key that hold the place in a piece, whose units are far fewer


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x if step == width else np.minimum(x[: len(x) - (width - step)], x[width - step :])


def anchored_runs(grams: np.ndarray, unit_offs: np.ndarray, window: int, gram: int):
    """Group the windows of each document by the gram that anchors them.

    ``grams[j]`` is the hash of units j to j + gram - 1. A window of ``window`` units is anchored at the
    leftmost of its grams with the least hash, so equal windows are anchored at equal grams at equal
    distances. Returns (anchor, lo, hi): windows lo to hi - 1 are those anchored at ``anchor``; runs come in
    order and no window is missed.
    """
    none = np.zeros(0, np.int64)
    units = int(unit_offs[-1]) if len(unit_offs) else 0
    if units < window:
        return none, none, none
    lens = np.diff(unit_offs)
    starts = np.arange(units - window + 1)
    ends = np.repeat(unit_offs[1:], lens)[: len(starts)]
    valid = starts + window <= ends
    low = (1 << _INDEX) - 1
    key = (grams & U64(_MASK ^ low)) | np.arange(len(grams), dtype=U64)
    anchor = (sliding_min(key, window - gram + 1)[: len(starts)] & U64(low)).astype(np.int64)
    starts, anchor = starts[valid], anchor[valid]
    if not len(starts):
        return none, none, none
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return anchor[edge], starts[edge], starts[np.append(edge[1:], len(starts)) - 1] + 1


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and the range each is from."""
    lens = hi - lo
    of = np.repeat(np.arange(len(lo)), lens)
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return lo[of] + at, of


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n units are inside some [start, start + size)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:n]) > 0


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, transposed so that like bytes stand together and compress."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def binary(lens: np.ndarray, data: bytes) -> pa.Array:
    """Byte strings of these lengths, laid end to end in ``data``."""
    offs = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])


def numbered(chunk: Chunk, words: Words) -> np.ndarray:
    """A number for each word of the chunk, equal for words of equal bytes only."""
    return binary(words.ends - words.starts, chunk.buf[words.inside].tobytes()).dictionary_encode().indices.to_numpy()


def same_windows(number: np.ndarray, starts: np.ndarray, hashes: np.ndarray, weight: np.ndarray, window: int, owner: np.ndarray | None = None) -> np.ndarray:
    """For each window, the weight of all that have its numbers (and its owner): grouped by hash, compared one by one."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    order = np.argsort(hashes, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    count = np.diff(np.append(edge, len(order)))
    out[order] = np.repeat(np.add.reduceat(weight[order], edge), count)
    more = np.repeat(count > 1, count)
    members, heads = order[more], np.repeat(order[edge], count)[more]
    same = owner[members] == owner[heads] if owner is not None else np.ones(len(members), bool)
    for k in range(window):
        same &= number[starts[members] + k] == number[starts[heads] + k]
    for head in np.unique(heads[~same]).tolist():  # unlike windows under one hash
        exact: dict[tuple, list[int]] = defaultdict(list)
        for i in members[heads == head].tolist():
            exact[int(owner[i]) if owner is not None else 0, number[starts[i] : starts[i] + window].tobytes()].append(i)
        for group in exact.values():
            out[group] = weight[group].sum()
    return out
