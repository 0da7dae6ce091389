"""Each operator against brute force on small tables with nulls, empties, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import bpe, countmin, decontam, langid, quality, simhash, substring, suffix, textvec, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_rng = random.Random(7)
_VOCAB = ["".join(_rng.choice("abcdefghé") for _ in range(_rng.randint(1, 9))) for _ in range(300)]


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(_VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared, short = prose(60, rng), prose(20, rng)
    texts = [None, "", " \n\t ", "one", prose(34, rng), shared, shared, "x " + shared + " y", prose(40, rng) + "\n" + shared, "aa " * 120, short, short + " z", prose(3000, rng)]
    out = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*out, (3, "one", "en", "s", 0), (None, shared, None, None, None), (None, prose(50, rng), "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for name in ("places", "kept", "fp", "score", "bucket"):  # columns that clash with inner ones
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(docs, rows, empty):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = []
    for doc_id, w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = [tuple(r) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.remove_repeats(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    items = sorted(((r[0] if r[0] is not None else 1 << 62), r[0], (r[1] or "").encode()) for r in rows)
    first, want = {}, []
    for key, _, raw in items:
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], key)
    for key, doc_id, raw in items:
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((doc_id, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_earlier_strings(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix.remove_earlier_strings(empty).count() == 0


def test_radix_passes():
    rng = np.random.default_rng(1)
    flat = np.append(rng.integers(97, 99, 4000).astype(np.uint8), np.zeros(8, np.uint8))
    starts = np.arange(4000 - 13)
    members, group = suffix.sort_to_depth(flat, starts, 13)
    keys = [flat[s : s + 13].tobytes() for s in starts]
    count = Counter(keys)
    assert sorted(members) == [i for i, k in enumerate(keys) if count[k] > 1]
    assert all(len({keys[m] for m in members[group == g]}) == 1 for g in np.unique(group))


@pytest.mark.parametrize("same", [True, False])
def test_sketch_never_underestimates(spark, same):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 40, 6000).astype(np.uint64)
    keys = np.concatenate([keys, keys[:2000]])
    df = spark.createDataFrame([(int(k),) for k in rng.permutation(keys)], "k long").repartition(4)
    find = lambda b: iter([(b.column("k").to_numpy().astype(np.uint64), b.column("k"))])
    sketch = countmin.build(df, find, 8000)

    def ask(batches):
        for part in sketch.filtered(batches, find):
            for flags, k in part:
                yield pa.RecordBatch.from_arrays([k, pa.array(flags)], ["k", "said"])

    # a table dealt otherwise than the one that was counted gets no answers, and all its keys pass
    got = (df if same else df.repartition(3)).mapInArrow(ask, "k long, said boolean").collect()
    twice = set(keys[:2000].tolist())
    assert len(got) == 8000 and all(r.said for r in got if r.k in twice)
    if same:
        assert np.mean([r.said for r in got if r.k not in twice]) < 0.2
    else:
        assert all(r.said for r in got)


def _thue_morse(n: int) -> tuple[str, str]:
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_alike_by_hash_only(spark):
    """Words on which every polynomial hash modulo 2**64 agrees, whatever its base."""
    rng = random.Random(21)
    one, two = _thue_morse(10)
    w = prose(40, rng).split()
    rows = [(0, " ".join([*w[:20], one, *w[20:]]), "en", "s", 0), (1, " ".join([*w[:20], two, *w[20:]]), "en", "s", 0), (2, f"p q {one} r s and p q {two} r s", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {0: 0, 1: 0, 2: 0}
    assert {r.doc_id: r.n_repeat_words for r in quality.judge(df).collect()}[2] == 0


def test_groups_compare_words_not_hashes():
    number = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.int64)
    starts, alike = np.array([0, 3, 6]), np.zeros(3, np.uint64)
    assert textvec.same_windows(number, starts, alike, np.ones(3, np.int64), 3).tolist() == [2, 2, 1]
    assert textvec.same_windows(number, starts, alike, np.ones(3, np.int64), 3, np.array([0, 1, 1])).tolist() == [1, 1, 1]


@pytest.mark.parametrize("size", [40, 700])
def test_pieces_hold_each_window_once(size):
    rng = random.Random(23)
    texts = [prose(300, rng), "", "x" * 900, " \n" + prose(5, rng), prose(200, rng) + "  ", "é" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for words, cut in ((True, lambda t: t.encode().split()), (False, lambda t: list(t.encode()))):
        want = Counter((i, j, tuple(u[j : j + 7])) for i, u in enumerate(map(cut, texts)) for j in range(len(u) - 6))
        got = Counter()
        for c in textvec.pieces(batch, "text", 6, words, size):
            for d in range(c.n):
                u = cut(c.buf[c.offs[d] : c.offs[d + 1]].tobytes().decode("utf-8", "surrogateescape")) if words else c.buf[c.offs[d] : c.offs[d + 1]].tolist()
                got.update((c.rows.start + d, c.base + j, tuple(u[j : j + 7])) for j in range(len(u) - 6))
        assert got == want


def _fp(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, simhash.near_duplicates(docs, hot=2).collect()), key=repr)  # salted
    prints = [(r[0], _fp(r[1])) for r in rows]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((p[0] for p, h in zip(prints, group) if h == g and p[0] is not None), default=None) for g in set(group)}
    want = [(p[0], p[1], low[g]) for p, g in zip(prints, group)]
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("refine", [4, 1024])
def test_simhash_links_in_dense_postings(spark, refine):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.vertex: r.root for r in simhash.components(simhash.links(fps, refine=refine)).collect()}
    group = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    mine = {v: roots.get(v, v) for v in values}
    same = lambda m: {frozenset(k for k in values if m[k] == g) for g in set(m.values())}
    assert same(mine) == same(group)


def test_very_long_texts(spark):
    """Texts of several pieces give what brute force gives on the whole."""
    rng = random.Random(41)
    shared = prose(80, rng)
    long = " ".join(prose(1000, rng) for _ in range(230)) + " " + shared + " " + prose(1000, rng)  # over 1 MB
    rows = [(0, shared, "en"), (1, long, "en"), (2, "z" * 1_300_000, "en"), (3, long[:1_100_000] + "!", None), (4, shared, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    words = {i: t.encode().split() for i, t, _ in rows}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {i: len({j for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}) for i, w in words.items()}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()} == {i: (len(w), want[i]) for i, w in words.items()}
    got = {r.doc_id: r for r in suffix.remove_earlier_strings(df).collect()}
    assert got[2].n_removed == 0 and got[0].n_removed == 0 and got[4].n_removed == len(shared.encode())
    assert got[1].n_removed >= len(shared.encode()) and got[3].n_removed == len(rows[3][1].encode()) - 1
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.near_duplicates(df).collect()} == {i: _fp(t) for i, t, _ in rows}
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {i: len(w) for i, w in words.items()}
    bench = spark.createDataFrame([(7, shared)], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in decontam.matches(df, bench).collect()} == {(0, 1.0), (1, 1.0), (4, 1.0)}
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, *langid.learn(df)).collect()} == dict.fromkeys(range(5), "en")
    assert toxicity.toxicity(df, spark.createDataFrame([(1, 1, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")).count() == 5


def test_smith_waterman():
    rng = random.Random(9)

    def plain(a, b):
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    pairs = [(np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 12))], np.uint64), np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 25))], np.uint64)) for _ in range(60)]
    assert decontam.smith_waterman(pairs)[:, 0].tolist() == [plain(a.tolist(), b.tolist()) for a, b in pairs]


def test_decontamination(spark, empty):
    rng = random.Random(11)
    items = [(i, prose(30, rng)) for i in range(5)] + [(90, None), (91, ""), (92, "two words")]
    words = items[0][1].split()
    words[7], words[19] = "CHANGED", "Edited"
    texts = [(0, prose(80, rng) + " " + items[1][1] + ", " + prose(20, rng)), (1, prose(50, rng) + " " + " ".join(words)), (2, prose(400, rng)), (3, None), (None, items[2][1].upper()), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert {k for k in got if k[1] < 90} == {(0, 1), (1, 0), (None, 2)}
    assert got[0, 1].score == 1.0 and got[0, 1].start_word == 80 and got[0, 1].end_word == 110 and 0.8 < got[1, 0].score < 1
    assert decontam.matches(empty, bench).count() == 0


def test_decontamination_is_all_pairs_alignment(spark):
    """Every pair with a shared run of three words and a score over the threshold, and no other."""
    rng = random.Random(37)
    items = [prose(rng.randint(8, 30), rng) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = []
        for part in rng.sample(items, 2):
            part = part.split()
            a = rng.randrange(len(part))
            words += prose(rng.randint(0, 30), rng).split() + [w if rng.random() > 0.15 else rng.choice(_VOCAB) for w in part[a // 2 : len(part) - a // 3]]
        texts.append(" ".join(words))
    bench = spark.createDataFrame([*enumerate(items), (3, items[3])], "item_id long, text string")  # an item twice
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "")], "doc_id long, text string")
    for name in ("item_id", "score", "start_word"):
        df = df.withColumn(name, F.lit("clash"))
    got = Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in decontam.matches(df, bench).collect())
    code = {w: i + 1 for i, w in enumerate(sorted(set(_VOCAB)))}
    want: Counter = Counter()
    for d, t in [*enumerate(texts), (0, texts[0])]:
        tw = t.split()
        runs = {tuple(tw[i : i + 3]) for i in range(len(tw) - 2)}
        for i, item in [*enumerate(items), (3, items[3])]:
            iw = item.split()
            if runs & {tuple(iw[k : k + 3]) for k in range(len(iw) - 2)}:
                (score, _, _), = decontam.smith_waterman([(np.array([code[w] for w in iw], np.uint64), np.array([code[w] for w in tw], np.uint64))]).tolist()
                if score / (2 * len(iw)) >= decontam.THRESHOLD:
                    want[d, i, round(score / (2 * len(iw)), 6)] += 1
    assert got == want and len(want) > 40
    assert decontam.matches(df, bench.limit(0)).count() == 0


def _edited(item: str) -> str:
    """A copy with every fifth word replaced: under half of its three-word runs are left, and 0.7 of a perfect score."""
    return " ".join("edit%d" % k if k % 5 == 3 else w for k, w in enumerate(item.split()))


def test_decontamination_of_edits_beside_many_copies(spark):
    rng = random.Random(12)
    copied, edited, other = prose(30, rng), prose(30, rng), prose(30, rng)
    around = lambda passage: prose(40, rng) + " " + passage + " " + prose(40, rng)
    texts = [around(copied) for _ in range(50)] + [around(_edited(copied)) for _ in range(3)] + [around(_edited(edited)) for _ in range(20)] + [prose(110, rng) for _ in range(20)]
    # one common three-word run of an item is not a match
    texts += [around(" ".join(other.split()[4:7])) for _ in range(20)]
    bench = spark.createDataFrame([(0, copied), (1, edited), (2, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert set(got) == {(i, 0) for i in range(53)} | {(i, 1) for i in range(53, 73)}
    assert all(got[i, 0] == 1 for i in range(50)) and all(0.7 <= s < 1 for k, s in got.items() if k[0] >= 50)


def test_quality_statistics_and_verdicts(spark, empty):
    rng = random.Random(13)
    texts = [None, "", "a b", "x # y $\nx # y $\n\nÉa", "w1 w2 w3 w4 w5 z w1 w2 w3 w4 w5"]
    texts += [prose(rng.randint(60, 200), rng) for _ in range(200)] + [" ".join(w + "###$$$" for w in prose(120, rng).split()) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert (got[0].n_words, got[0].word_chars, got[0].base_failed) == (0, 0, True)
    assert (got[3].n_words, got[3].word_chars, got[3].n_symbols, got[3].n_dup_lines) == (9, 10, 4, 1)
    assert got[4].n_repeat_words == 10 and got[4].base_failed
    assert all(not got[i].kept for i in range(205, 210)) and sum(got[i].kept for i in range(5, 205)) >= 198
    assert quality.judge(empty).count() == 0


def _plain_mcd(x: np.ndarray, h: int, rng) -> float:
    """Least log determinant of the regularised covariance over subsets of h rows, from many random starts."""
    ridge, best = np.diag(np.square(quality.FLOORS)), np.inf
    for _ in range(150):
        rows, last = rng.choice(len(x), 7, replace=False), np.inf
        while True:
            mu, cov = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True) + ridge
            if (now := np.linalg.slogdet(cov)[1]) >= last - 1e-12 and len(rows) == h:
                break
            last = now if len(rows) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            rows = np.argsort(d, kind="stable")[:h]
        best = min(best, last)
    return best


def test_estimate_is_the_least_determinant(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(320, 6)) @ np.diag([1.0, 0.2, 0.1, 0.1, 0.2, 0.1]) + 3
    bad = rng.normal(size=(60, 6)) * 0.05 + np.array([5, 3, 4, 3, 5, 3])
    x = np.abs(np.concatenate([good, bad]))
    fixed = np.round(x * quality.ONE).astype(int)
    schema = "grp string, " + ", ".join(f"{c} long" for c in quality._X)
    found = []
    for parts in (1, 5):
        df = spark.createDataFrame([("g", *map(int, r)) for r in rng.permutation(fixed)], schema).repartition(parts)
        for local_rows in (1000, 100):  # in one task, and by all
            (r,) = quality.estimates(df, local_rows=local_rows).collect()
            found.append((r.mu, r.inv, r.logdet, r.cut))
    assert all(f == found[0] for f in found)  # whatever the rows' order and partitions
    assert found[0][2] <= _plain_mcd(fixed / quality.ONE, math.ceil(quality.SUBSET * len(x)), rng) + 0.02
    mu, inv = np.array(found[0][0]), np.array(found[0][1]).reshape(6, 6)
    d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
    assert d[320:].min() > np.quantile(d[:320], 0.99)


def test_quality_defined_cases(spark):
    rng = random.Random(29)
    rows = [(i, prose(rng.randint(60, 200), rng), "en", "a" if i % 3 else None) for i in range(150)]
    rows += [(1000 + i, prose(80, rng), None, "b") for i in range(5)]  # a group too small for an estimate of its own
    rows += [(None, None, None, None), (None, prose(70, rng), "", ""), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("grp", "n", "cut", "mu", "kept", "distance", "x0", "start", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted((tuple(r) for r in quality.judge(df.repartition(3)).collect()), key=repr)
    assert got == sorted((tuple(r) for r in quality.judge(df.repartition(1)).collect()), key=repr)
    assert len(got) == len(rows) and sum(r[0] == 3 for r in got) == 3 and len({r for r in got if r[0] == 3}) == 1
    few = quality.judge(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept and r.distance is None for r in few)  # no group is large enough


def test_language_mixture(spark, empty):
    en, fr = "the house and the garden with this water ", "la maison et le jardin avec cette eau "
    rows = [(i, (en if i % 2 else fr) * 6, "en" if i % 2 else "fr") for i in range(40)]
    names, logs = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["en", "fr"]
    texts = [(0, en), (1, fr), (2, None), (3, "123 !!"), (4, en * 3 + fr * 3), (5, "")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), names, logs).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 5)] == ["en", "fr", "und", "und", "und"]
    assert set(got[4].proportions) == {"en", "fr"} and abs(got[4].score - 0.5) < 0.1 and got[0].score == 1.0
    assert langid.identify(empty, names, logs).count() == 0 and langid.learn(empty)[0] == []


def test_language_em_is_plain_em():
    """Side by side or document by document, the proportions are those of textbook EM over the selected set."""
    rng = np.random.default_rng(3)
    count = np.array([12, 1, 40, 7])
    like = np.exp(rng.normal(size=(count.sum(), 4)) * 2)
    first = np.cumsum(count) - count
    got = langid.infer(like, first, count)

    def em(x, allowed, rounds):
        pi = allowed / allowed.sum()
        for _ in range(rounds):
            r = x * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi, np.log((x * pi).sum(axis=1)).sum()

    for d, (a, n) in enumerate(zip(first, count)):
        x, allowed = like[a : a + n], np.ones(4)
        pi, fit = em(x, allowed, langid.ROUNDS)
        while allowed.sum() > 1:
            trial = allowed.copy()
            trial[np.where(allowed > 0, pi, np.inf).argmin()] = 0
            p, f = em(x, trial, max(3, langid.ROUNDS // 3))
            if fit - f >= max(langid.PENALTY, 0.5 * math.log(n)):
                break
            allowed, pi, fit = trial, p, f
        assert np.allclose(got[d], pi, atol=1e-9)


def test_language_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(31)
    vocab = {x: ["".join(rng.choice(a) for _ in range(rng.randint(3, 8))) for _ in range(80)] for x, a in (("xx", "abcdef"), ("yy", "defghi"), ("zz", "ghijab"))}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(40)), x) for i, x in enumerate(["xx", "yy", "zz"] * 60)]
    df = spark.createDataFrame([*rows, rows[1], (None, rows[0][1], None), (None, None, "xx")], "doc_id long, text string, lang string")
    for name in ("bucket", "n", "score", "proportions", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    got = langid.predict_held_out(df).collect()
    lang = {i: x for i, _, x in rows}
    out = [r for r in got if r.held_out]
    assert len(got) == len(rows) + 3 and len(out) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.95
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1 and sum(r.lang_pred == "und" for r in got) == 1
    # a tie of two languages with one distribution goes to the first by name
    twins = spark.createDataFrame([(0, "abc abd", "b"), (1, "abc abd", "a")], "doc_id long, text string, lang string")
    names, logs = langid.learn(twins)
    assert langid.identify(twins, names, logs).first().lang_pred == "a"
    # nothing learned: all is unknown
    assert {r.lang_pred for r in langid.predict_held_out(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages(spark):
    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(700)]
    df = spark.createDataFrame([(i, " ".join([w] * 12), f"l{i:03d}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    names, logs = langid.learn(df)
    assert len(names) == 700 and logs.shape == (700, 1 << 14)
    assert np.mean([r.lang_pred == f"l{r.doc_id:03d}" for r in langid.identify(df, names, logs).collect()]) > 0.98


def test_bpe_remembers_within_bounds(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "_MEMO", 50)
    merges = bpe.Merges(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    memo = bpe._Memo(merges)
    plain = {w: memo.made(w) for w in [f"w{i}" for i in range(300)] + ["x" * 500]}
    for _ in range(3):
        assert all(memo[w] == ids for w, ids in plain.items())
        assert len(memo) <= 50 and len(memo.older) <= 50 and "x" * 500 not in memo


def test_bpe_pieces_across_slices(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    edge = bpe.SLICE
    texts = ["a" * (edge - 3) + "bcd é x", " " * (edge - 1) + "the", "x " * (edge // 2) + "'s" * 20, "日" * (edge + 5), ("ab12" * edge)[: edge + 1] + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_against_the_library(spark, rows, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    merges = bpe.Merges(open(path, encoding="utf-8").read())
    rng = random.Random(17)
    bits = ["a", " ", "the", "'s", "'r", "e", "é", "日本", "\n", "\t", "  ", "12", "!!", "<|endoftext|>", "<|end", "😀", "\x85", "\xa0", "ing", "----"]
    for _ in range(300):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))
        want = library.encode(s, add_special_tokens=False).ids
        for cut in (10**6, 3):
            enc, out = bpe.Encoder(merges), b""
            for i in range(0, len(s), cut):
                out += enc.feed(s[i : i + cut])
            assert [int(x) for x in (out + enc.finish()).split(b",")[:-1]] == want
    for s in ("ab" * 20000, " " * 9000 + "x", "=" * 20000):
        enc = bpe.Encoder(merges)
        assert [int(x) for x in (b"".join(enc.feed(p) for p in bpe._slices(s)) + enc.finish()).split(b",")[:-1]] == library.encode(s, add_special_tokens=False).ids
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.round_trip(docs, path).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(r[0], r[1] or "", library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == {(d, sha(",".join(map(str, i))), sha(t), len(i)) for d, t, i in ids}
    back = bpe.decode(bpe.encode(docs.where("doc_id is not null"), path), path).collect()
    assert {(r.doc_id, r.text) for r in back} == {(r[0], r[1] or "") for r in rows if r[0] is not None}


def test_warc(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/\r\nx", ""), (5, "http://c", "é" * 50000), (5, "http://c", "é" * 50000), (None, "u", "<p>x</p>"), (-7, "u", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("original", F.lit(1))
    got = warc.archive_and_read(pages).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(1, 8, digest("<p>x</p>"), "response", None), (2, 8, digest("<p>x</p>"), "revisit", 1), (3, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 3),
            *[(5, 100000, digest("é" * 50000), "response", None)] * 2, (None, 8, digest("<p>x</p>"), "revisit", 1), (-7, 4, digest("solo"), "response", None)]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.html for r in got if r.record_type == "response"} == {"<p>x</p>", "", "é" * 50000, "solo"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(19)
    bad = ["vile", "nasty", "awful"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(60, rng).split()
        if toxic:
            for k in rng.sample(range(60), 3):
                w[k] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 != 0), int(toxic)))
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in range(400)]) > 0.97
    assert not got[1000].toxic and got[1000].severity == got[1001].severity
    assert toxicity.toxicity(empty, lab).count() == 0


def test_ordinal_loss_has_its_gradient():
    rng = np.random.default_rng(7)
    n, k = 40, 5
    rows, cols = np.repeat(np.arange(n), 2), rng.integers(0, k, 2 * n)
    values, y = rng.random(2 * n), rng.integers(0, 3, n)
    theta = rng.normal(size=k + 2) * 0.3
    value, grad = toxicity._loss(theta, rows, cols, values, n, k, y, 0.01)
    x = np.zeros((n, k))
    np.add.at(x, (rows, cols), values)
    t = [theta[k], theta[k] + math.exp(theta[k + 1])]
    cdf = [np.zeros(n), *(1 / (1 + np.exp(-(c - x @ theta[:k]))) for c in t), np.ones(n)]
    p = np.array([cdf[g + 1][i] - cdf[g][i] for i, g in enumerate(y)])
    assert np.isclose(value, (-np.log(p).sum() + 0.01 * n * (theta[:k] @ theta[:k]) / 2) / n)
    for i in range(k + 2):
        step = np.zeros(k + 2)
        step[i] = 1e-5
        up, down = (toxicity._loss(theta + s * step, rows, cols, values, n, k, y, 0.01)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_toxicity_held_out_recall_and_defined_cases(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the tables are not here")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 5 <> 0")
    got = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), learn).join(labels.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    bad = [r for r in got if r.truth == 1]
    assert len(bad) > 20 and np.mean([r.toxic for r in bad]) >= 0.9
    assert np.mean([r.toxic for r in got if r.truth == 0]) <= 0.01


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    for name in ("grade", "feature", "n", "v", "severity", "toxic"):
        df = df.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == 4 and not any(r.toxic for r in got) and len({r.severity for r in got}) == 1
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")  # the worst label counts
    assert len(toxicity.toxicity(df, one).collect()) == 4


def test_url_parts_rules_and_reputation(spark):
    cases = [(1, "http://A.Example.ORG/es/x?q#f"), (2, "https://example.org/en/17"), (3, "http://x.com/fr/1"), (4, "http://x.com/de/1"), (5, "http://x.com"), (6, "no scheme"), (7, None), (8, "http://com/de/?x"), (9, "http://notexample.org/es/"), (10, "http://h.net?a/b"), (11, "http://É.net/É#x")]
    cases += [(100 + i, f"http://bad.net/{i}") for i in range(40)] + [(200 + i, f"http://good.net/{i}") for i in range(40)]
    labels = [(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(40)] + [(10, True), (None, True), (3, None)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(cases, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert [(got[i].host, got[i].path) for i in (1, 5, 6, 7, 10, 11)] == [("a.example.org", "/es/x"), ("x.com", ""), ("", ""), ("", ""), ("h.net", ""), ("É.net", "/É")]
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 8, 9)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "block"), ("org/", "allow")]
    assert got[101].verdict == "block" and got[201].verdict == "allow" and got[5].rule is None
    assert got[10].chance_clean > got[101].chance_clean  # one bad page alone weighs less


def test_url_levels_and_defined_cases(spark):
    names = ["a.co.uk:8080", "u:p@b.com", "192.168.0.1:80", "[::1]:80", "x.y.z.com.", "co.uk", "localhost", "", "k.gov.fr", "com.museum"]
    df = spark.createDataFrame([(n,) for n in names], "host string").withColumn("b", urls.bare_host(F.col("host")))
    got = [(r.d, r.s) for r in df.select(urls.domain_of(F.col("b")).alias("d"), urls.suffix_of(F.col("b")).alias("s")).collect()]
    assert got == [("a.co.uk", "co.uk"), ("b.com", "com"), ("192.168.0.1", "(address)"), ("[::1]", "(address)"), ("z.com", "com"), ("co.uk", "co.uk"), ("localhost", "localhost"), ("", ""), ("k.gov.fr", "gov.fr"), ("com.museum", "museum")]
    pages = spark.createDataFrame([(1, "http://x.com/a")] * 3 + [(None, "http://x.com/a"), (2, None)], "page_id long, url string")
    for name in ("host", "bare", "path", "a", "b", "domain", "suffix", "bad", "fit"):
        pages = pages.withColumn(name, F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rows = urls.filter_urls(pages, none).collect()
    assert len(rows) == 5 and {r.verdict for r in rows} == {"allow"}  # nothing is known: P(rate <= 0.25) is 0.25
    assert all(abs(r.chance_clean - 0.25) < 1e-9 for r in rows)
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_beta_chance(spark):
    def integral(a, b, x=0.25, n=400_000):
        t = (np.arange(n) + 0.5) / n
        beta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        if a < 1:  # over u = t ** a, as the density has no bound at 0
            return x**a / a * ((1 - x * t ** (1 / a)) ** (b - 1)).mean() * math.exp(beta)
        return x * np.exp(beta + (a - 1) * np.log(x * t) + (b - 1) * np.log1p(-x * t)).mean()

    cases = [(0.3, 0.7), (1.0, 1.0), (2.5, 30.0), (40.0, 90.0), (0.02, 8.0), (300.0, 800.0), (30.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    got = df.select(urls.chance_up_to(0.25, F.col("a"), F.col("b")).alias("c")).collect()
    assert all(abs(r.c - integral(a, b)) < 1e-5 for r, (a, b) in zip(got, cases))
    big = spark.createDataFrame([(2600.0, 7400.0), (2580.0, 7420.0), (2500.0, 7500.0), (5200.0, 1.0)], "a double, b double")
    # 0.25 is 2.3, 1.8 and 0 standard deviations below the means
    assert [r.c <= 0.05 for r in big.select(urls.chance_up_to(0.25, F.col("a"), F.col("b")).alias("c")).collect()] == [True, True, False, True]
