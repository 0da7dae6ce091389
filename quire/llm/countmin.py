"""A count-min sketch of 64-bit keys, merged from sparse partial sketches of the input's partitions.

Only one thing is asked of a counter here: is it two or more? So a partial sketch is, for each row of counters, the
sorted touched counters and those touched twice; a reducer merges one range of counters, of bounded size. An estimate
is never below the count, so a key that occurs twice is always seen as repeated.

The merged sketch is never gathered in one place. Each reducer answers every partial sketch with those of its
counters that reached two; the answers to one partition of the input go to one file of the shared folder, which the second
pass over that partition reads as it goes. So the sketch has four counters a key at any size of the input, and
neither the driver nor a broadcast grows with it. An answer names the keys it is for by their number and sum; where
the second pass meets other keys (a partition dealt differently), or finds no answer, it takes all of them as repeated.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_path, partitions, trimmed
from .textvec import U64, mix, planes, unplanes

ROWS = 2
_SALT = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)]
#: Counters a key; two rows of them then take one key in twenty for a repeated one by chance.
COUNTERS = 4
#: log2 of the counters that one reducer merges at a time, and of the least number of such ranges.
MAX_BLOCK, LOG_BLOCKS = 22, 5
#: Keys that are counted, and later looked up, together.
FLUSH = 1 << 17
_HEAD = -1  # the block under which a partial sketch's key count and sum travel

Finder = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, Any]]]


def log_width(keys: int) -> int:
    """log2 of the counters of a row."""
    return min(50, max(18, (COUNTERS * max(1, keys) - 1).bit_length()))


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(keys ^ _SALT[row]) >> U64(64 - width)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted 64-bit numbers."""
    return zstandard.ZstdCompressor(level=1).compress(planes(np.diff(cells, prepend=U64(0)).astype(np.uint64)))


def _unpack(raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.cumsum(unplanes(raw, np.uint64, len(raw) // 8), dtype=np.uint64)


def _digest(keys: np.ndarray) -> bytes:
    return struct.pack("<QQ", len(keys), int(mix(keys).sum(dtype=np.uint64)) if len(keys) else 0)


def flushes(batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[tuple[int, list[tuple[np.ndarray, Any]]]]:
    """(number, [(keys, whatever they belong to)]): what ``find`` gives, about FLUSH keys at a time, in order."""
    held, n, number = [], 0, 0
    for batch in batches:
        for keys, rest in find(batch):
            held.append((keys, rest))
            n += len(keys)
            if n >= FLUSH:
                yield number, held
                held, n, number = [], 0, number + 1
    if held:
        yield number, held


def _partial(keys: np.ndarray, width: int, log: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, counters touched, those of them touched twice) for each row and range of counters."""
    for row in range(ROWS):
        cells = np.sort(_cells(keys, row, width))
        at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        twice = np.diff(np.append(at, len(cells))) > 1
        cells = cells[at]
        block = (cells >> U64(log)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
        for a, b in zip(edges, np.append(edges[1:], len(block)) if len(block) else []):
            yield (row << 40) | int(block[a]), _pack(cells[a:b] & U64((1 << log) - 1)), _pack(cells[a:b][twice[a:b]] & U64((1 << log) - 1))


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = ["block", "part", "flush", "once", "twice"]


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _merge(log: int):
    """Answers (part, flush, block, cells) to sorted rows of partial sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen, rep = None, [], None, None

        def close():
            out = []
            for part, flush, cells in held:
                hit = cells[rep[cells]]
                if len(hit):
                    out.append((part, flush, at, _pack(hit)))
                if len(out) >= 1024:
                    yield _record(out, ["part", "flush", "block", "cells"], [pa.int64()] * 3 + [pa.binary()])
                    out = []
            if out:
                yield _record(out, ["part", "flush", "block", "cells"], [pa.int64()] * 3 + [pa.binary()])

        for batch in batches:
            heads = []
            for block, part, flush, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if block == _HEAD:
                    heads.append((part, flush, _HEAD, once))
                    continue
                if block != at:
                    if held:
                        yield from close()
                    at, held, seen, rep = block, [], np.zeros(1 << log, bool), np.zeros(1 << log, bool)
                cells = _unpack(once)
                rep[cells] |= seen[cells]
                seen[cells] = True
                rep[_unpack(twice)] = True
                held.append((part, flush, cells))
            if heads:
                yield _record(heads, ["part", "flush", "block", "cells"], [pa.int64()] * 3 + [pa.binary()])
        if held:
            yield from close()

    return run


def _write(folder: str, log: int):
    """Answers sorted by (part, flush, block) to one file a part. A repeated attempt writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part = flush = out = temp = None
        head, cells, done = b"", [[], []], []

        def frame():
            if flush is not None:
                body = [_pack(np.concatenate(c)) if c else _pack(np.zeros(0, np.uint64)) for c in cells]
                out.write(struct.pack("<qqq", flush, len(body[0]), len(body[1])) + head + body[0] + body[1])

        def close():
            if out is not None:
                out.close()
                try:
                    fs.move(temp, f"{root}/{part}.bin")
                except OSError:
                    fs.delete_file(temp)  # another attempt has written it
                done.append(part)

        for batch in batches:
            for p, f, block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part or f != flush:
                    frame()
                    if p != part:
                        close()
                        part, temp = p, f"{root}/{p}-{uuid.uuid4().hex}.tmp"
                        out = fs.open_output_stream(temp)
                    flush, head, cells = f, b"", [[], []]
                if block == _HEAD:
                    head = raw
                else:
                    cells[block >> 40].append(_unpack(raw) + (U64(block & ((1 << 40) - 1)) << U64(log)))
        frame()
        close()
        yield _record([(p,) for p in done], ["part"], [pa.int64()])

    return run


class Sketch:
    """The answers of the merged sketch, in files by partition."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width

    def filtered(self, batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[list[tuple[np.ndarray, Any]]]:
        """What :func:`flushes` gives, each with flags of the keys estimated repeated in place of the keys."""
        frames = self._frames()
        frame = next(frames, None)
        for number, held in flushes(batches, find):
            while frame is not None and frame[0] < number:
                frame = next(frames, None)
            keys = np.concatenate([k for k, _ in held])
            if frame is not None and frame[0] == number and frame[1] == _digest(keys):
                flags = _contains(frame[2], _cells(keys, 0, self.width)) & _contains(frame[3], _cells(keys, 1, self.width))
            else:
                flags = np.ones(len(keys), bool)
            stops = np.cumsum([len(k) for k, _ in held])
            yield [(flags[b - len(k) : b], rest) for b, (k, rest) in zip(stops, held)]

    def _frames(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        fs, root = filesystem(self.folder)
        try:
            stream = fs.open_input_stream(f"{root}/{TaskContext.get().partitionId()}.bin")
        except OSError:
            return
        with stream:
            while len(head := stream.read(24)) == 24:
                number, a, b = struct.unpack("<qqq", head)
                digest, raw = stream.read(16), stream.read(a + b)
                yield number, digest, _unpack(raw[:a]), _unpack(raw[a:])


def _contains(members: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(members):
        return np.zeros(len(x), bool)
    return members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x


def build(docs: DataFrame, find: Finder, keys: int) -> Sketch:
    """Sketch of the keys that ``find`` gives for the batches of ``docs``; ``keys``: about how many there are.

    The same ``docs`` and ``find`` must then go through :meth:`Sketch.filtered`.
    """
    spark = docs.sparkSession
    width = log_width(keys)
    log = min(MAX_BLOCK, width - LOG_BLOCKS)
    folder = new_path(spark, "sketch")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, held in flushes(batches, find):
            found = np.concatenate([k for k, _ in held])
            rows = [(_HEAD, part, number, _digest(found), b"")] + [(block, part, number, once, twice) for block, once, twice in _partial(found, width, log)]
            for a in range(0, len(rows), 4096):
                yield _record(rows[a : a + 4096], _NAMES, _TYPES)

    # the heads, one a flush, are dealt by their part; the counters by their range
    parts = docs.mapInArrow(trimmed(partial), "block long, part long, flush long, once binary, twice binary")
    n = partitions(spark)
    merged = parts.repartition(n, "block", F.when(F.col("block") == _HEAD, F.col("part"))).sortWithinPartitions("block")
    answers = merged.mapInArrow(trimmed(_merge(log)), "part long, flush long, block long, cells binary")
    answers.repartition(n, "part").sortWithinPartitions("part", "flush", "block").mapInArrow(trimmed(_write(folder, log)), "part long").count()
    return Sketch(folder, width)
