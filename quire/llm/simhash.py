"""SimHash near-duplicates: a byte-position inverted index with count filtering, then components.

Two 64-bit fingerprints that differ in at most three bits differ in at most three bytes, so they share at least
five of eight positional bytes, and at least three of one half's four. The index therefore posts each *distinct*
fingerprint (copies are one entry, whatever their number) under the eight combinations of three positional bytes of a
half. For each pair that meets, the shared positional bytes are tallied; pairs with five or more are verified.

Postings stay bounded: one with more than ``REFINE`` entries is dealt anew under its ten combinations with two more
bytes, as five must be shared; there 24 bits are left, so it has at most 2**24 entries, and neighbours are looked up
among the 2324 ways to change three bits instead of by pairs. A posting gives a spanning forest, never all pairs.

Components: rounds of contraction, each vertex joining its neighbour of least random priority, until no edge is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import staged, trimmed
from .textvec import pieces

SHINGLE = 3
DISTANCE = 3
SEED = 42
REFINE = 1024
#: Texts of one fingerprint beyond which it is dealt out under SALTS keys. At most a HOT-th as many as there are texts are.
HOT, SALTS = 1 << 20, 64


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint, as a signed long, of every row's whole text; no words: zero."""

    def bits(raw: bytes, whole: bool) -> tuple[np.ndarray, int]:
        """(how many shingles have each bit, shingles) of a text, or of a piece of a longer one."""
        ones = np.zeros(64, np.int64)
        words = raw.lower().split()
        n = len(words)
        if not n or n < shingle and not whole:
            return ones, 0
        text = b" ".join(words)
        if n < shingle:
            h = np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1)
        for at in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[at : at + (1 << 16)])
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        return ones, len(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, total = np.zeros((batch.num_rows, 64), np.int64), np.zeros(batch.num_rows, np.int64)
            for c in pieces(batch, "text", shingle - 1, words=True):
                raw = c.buf.tobytes()
                for row, a, b in zip(range(c.rows.start, c.rows.stop), c.offs[:-1].tolist(), c.offs[1:].tolist()):
                    own, n = bits(raw[a:b], c.base == 0)
                    ones[row] += own
                    total[row] += n
            fps = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64).ravel() if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


_TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _masks(bits: list[int], most: int) -> np.ndarray:
    """All ways to change one to ``most`` of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(bits, k)], np.uint64)


class _Forest:
    """Labels of rows that links have joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Which differences pass: by the tally of shared positional bytes, then by bits."""
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = tally >= 8 - distance
    out[out] = np.bitwise_count(x[out]) <= distance
    return out


def _links(distance: int, wide: int):
    """Spanning forests of the postings in sorted batches of (posting, key, fp)."""

    def forest(posting: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        n = len(fp)
        edge = np.flatnonzero(np.concatenate(([True], (posting[1:] != posting[:-1]) | (key[1:] != key[:-1]))))
        count = np.diff(np.append(edge, n))
        end = np.repeat(edge + count, count)
        f = _Forest(n)
        large = np.repeat(count > wide, count)
        at, step = np.flatnonzero(~large & (end - np.arange(n) > 1)), 1
        while len(at):
            f.join(at[hit := _linked(fp[at] ^ fp[at + step], distance)], at[hit] + step)
            step += 1
            at = at[at + step < end[at]]
        for a, c in zip(edge[count > wide].tolist(), count[count > wide].tolist()):
            own = np.sort(fp[a : a + c])
            back = a + np.argsort(fp[a : a + c], kind="stable")
            varying = np.bitwise_or.reduce(own ^ own[0])
            bits = [b for b in range(64) if int(varying) >> b & 1]
            for m in _masks(bits, distance):
                other = own ^ m
                j = np.minimum(np.searchsorted(own, other), c - 1)
                hit = own[j] == other
                f.join(back[hit], back[j[hit]])
        moved = np.flatnonzero(f.label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[f.label[moved]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last posting, which may go on in the next batch

        def close():
            if held:
                posting, key, fp = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield forest(posting, key, fp.view(np.uint64))

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield from close()
            cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
            if cut:
                held.append([x[:cut] for x in cols])
                yield from close()
            held.append([x[cut:] for x in cols])
        yield from close()

    return run


def _post(fps: DataFrame, keys: list[Column]) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("posting"), k.alias("key")) for i, k in enumerate(keys)])).alias("p")
    return fps.select("fp", both).select("p.posting", "p.key", "fp")


def links(fps: DataFrame, distance: int = DISTANCE, refine: int = REFINE) -> DataFrame:
    """(u, v): edges whose components are those of the distinct fingerprints within ``distance`` bits."""
    if distance != 3:
        raise ValueError("the combinations of positional bytes are those for a distance of three")
    posted = _post(fps, [F.col("fp").bitwiseAND(F.lit(_mask(t))) for t in _TRIPLES])
    sized = posted.withColumn("n", F.count("*").over(W.partitionBy("posting", "key"))).where("n > 1")
    light = sized.where(F.col("n") <= refine).select("posting", "key", "fp").sortWithinPartitions("posting", "key")
    finer = [(t, F.col("fp").bitwiseAND(F.lit(_mask((*t, *two))))) for t in _TRIPLES for two in combinations([p for p in range(8) if p not in t], 2)]
    heavy = sized.where(F.col("n") > refine)
    choice = F.array(*[F.when(F.col("posting") == _TRIPLES.index(t), F.struct(F.lit(100 + i).alias("posting"), k.alias("key"))) for i, (t, k) in enumerate(finer)])
    heavy = heavy.select("fp", F.explode(F.filter(choice, lambda x: x.isNotNull())).alias("p")).select("p.posting", "p.key", "fp")
    heavy = heavy.repartition("posting", "key").sortWithinPartitions("posting", "key")
    light = light.mapInArrow(trimmed(_links(distance, refine)), "u long, v long")
    heavy = heavy.mapInArrow(trimmed(_links(distance, refine)), "u long, v long")
    return light.unionByName(heavy)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges(u, v)``; root is one vertex of the component."""
    edges = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    members, round_ = None, 0
    while not edges.isEmpty():
        round_ += 1
        rank = lambda c: F.xxhash64(F.lit(round_), c)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(rank(F.col("v")).alias("r"), F.col("v").alias("v"))).alias("b"))
        parent = staged(best.select("u", F.when(F.col("b.r") < rank(F.col("u")), F.col("b.v")).otherwise(F.col("u")).alias("p")), "parents")
        if members is None:
            members = parent.select(F.col("u").alias("vertex"), F.col("p").alias("root"))
        else:
            members = staged(members.join(parent, members.root == parent.u, "left").select("vertex", F.coalesce("p", "root").alias("root")), "members")
        up, vp = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(up, "u").join(vp, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct()
        edges = staged(edges, "edges")
    return members if members is not None else edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``.

    component_id is the smallest doc_id reachable by links of at most ``distance`` differing bits, the row's own
    included. Null, empty and wordless texts have fingerprint zero and link like any other; texts of fewer words than
    ``shingle`` hash their whole word sequence; repeated rows share a component; a null doc_id never names a component
    (it is null only if no member has an id). Texts of any length go through in pieces. An empty table gives an empty result; other columns are ignored.
    """
    marked = staged(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    joined = distinct.join(roots, distinct.fp == roots.vertex, "left").select("fp", "least", "root")
    linked = joined.where("root is not null")
    low = linked.groupBy("root").agg(F.min("least").alias("low"))
    named = linked.join(low, "root").select("fp", F.col("low").alias("component_id"))
    named = named.unionByName(joined.where("root is null").select("fp", F.col("least").alias("component_id")))
    # a fingerprint that a third of the texts have is dealt out under so many salts; its name goes to each
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > hot, F.lit(SALTS - 1)).otherwise(0))).alias("salt")
    named = named.join(distinct.select("fp", "copies"), "fp").select("fp", "component_id", "copies", salts)
    many = distinct.where(F.col("copies") > hot).select("fp", F.lit(True).alias("hot"))
    salted = marked.join(F.broadcast(many), "fp", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.rand(5)), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(named, ["fp", "salt"]).select("doc_id", "fp", "component_id")
