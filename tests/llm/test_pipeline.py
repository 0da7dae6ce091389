"""The pipeline's stages against brute force, on rows with nulls, empties, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_rng = random.Random(7)
_VOCAB = ["".join(_rng.choice("abcdefgh") for _ in range(_rng.randint(2, 9))) for _ in range(300)]


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(_VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def frame(spark, rows):
    """The rows as documents, with columns that the stages must ignore."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("_key", "key", "new", "score", "component_id", "n_removed", "item_id", "ids", "first"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def same(got, want) -> bool:
    return sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_language(spark, empty):
    en, fr = "the house and the garden with this water ", "la maison et le jardin avec cette eau "
    rows = [(i, (en if i % 2 else fr) * 4, "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    odd = [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "123 !!", "en", "s", 0), (None, en * 4, None, "s", 1), (103, fr * 4, None, "s", 1), rows[1]]
    got = pipeline.language(spark, frame(spark, rows + odd), "")
    assert got.columns == pipeline.COLUMNS
    # rows without a letter go; a missing language is named; all else stays as it is, repeated rows too
    assert same(got.collect(), [*rows, rows[1], (None, en * 4, "en", "s", 1), (103, fr * 4, "fr", "s", 1)])
    assert pipeline.language(spark, empty, "").count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark, empty):
    rng = random.Random(6)
    t = [prose(80, rng) for _ in range(6)]
    rows = [(1, t[0], "en", "s", 1), (7, t[0], "en", "s", 1), (None, t[0], None, "s", 1)]  # a null id beside ids
    rows += [(2, t[1], "en", "b", 1), (2, t[1], "en", "a", 1)]  # alike in doc_id and text
    rows += [(7, t[2], "en", "s", 1)]  # a distinct text whose namesake goes
    rows += [(None, t[3], "en", "s", 1), (None, t[3], "en", "s", 1), (None, t[4], None, None, None), (9, t[5], "en", "s", 1)]
    assert same(pipeline.near_dedup(spark, frame(spark, rows), "").collect(), [rows[0], rows[4], rows[5], rows[6], rows[8], rows[9]])
    assert pipeline.near_dedup(spark, empty, "").count() == 0


def test_substring_dedup(spark, empty):
    rng = random.Random(8)
    shared, own = prose(50, rng), [prose(30, rng) for _ in range(4)]
    rows = [(1, own[0] + " " + shared, "en", "s", 9), (2, shared + "\n" + own[1], None, "s", 9), (None, own[2], "en", None, 7), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, shared, "en", "s", 9), (6, own[3], "en", "s", 3)]
    # a text without a repeated passage stays as it is, to the byte; one that is nothing but repeated passages goes
    want = [(1, own[0], "en", "s", len(own[0])), (2, own[1], None, "s", len(own[1])), rows[2], rows[3], rows[4], rows[6]]
    assert same(pipeline.substring_dedup(spark, frame(spark, rows), "").collect(), want)
    assert pipeline.substring_dedup(spark, empty, "").count() == 0


def test_texts_alike_survive_once(spark):
    """Copies under one id, under none and under another: near_dedup leaves one, so the next stage takes nothing from it."""
    rng = random.Random(9)
    t = [prose(80, rng) for _ in range(2)]
    rows = [(1, t[0], "en", "s", 1), (1, t[0], "en", "s", 1), (None, t[1], "en", "s", 1), (3, t[1], "en", "s", 1)]
    out = pipeline.substring_dedup(spark, pipeline.near_dedup(spark, frame(spark, rows), ""), "")
    assert texts(out) == [(1, t[0]), (3, t[1])]


def test_decontaminate(spark, empty, tmp_path):
    rng = random.Random(10)
    item = prose(30, rng)
    spark.createDataFrame([(1, item), (2, None), (None, prose(20, rng))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [prose(60, rng) for _ in range(3)]
    rows = [(1, clean[0] + " " + item, "en", "s", 1), (1, clean[0], "en", "s", 1), (None, item, "en", "s", 1), (None, clean[1], None, "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, clean[2], "en", "s", 1), (5, clean[2], "en", "s", 1)]
    # a clean row stays, though it has the id of one that goes, and however often it is there
    assert same(pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path)).collect(), [rows[1], *rows[3:]])
    assert pipeline.decontaminate(spark, empty, str(tmp_path)).count() == 0


def test_tokenize(spark, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(1, "the water's edge", "en", "s", 1), (1, "the water's edge", "en", "s", 1), (None, "é  x", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    got = sorted(((r.doc_id, list(r.ids), r.n_tokens, r.decoded_sha256) for r in pipeline.tokenize(spark, frame(spark, rows), "").collect()), key=repr)
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    assert got == sorted(((d, i, len(i), h) for d, i, h in ids), key=repr)
    assert pipeline.tokenize(spark, empty, "").count() == 0


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "bpe"]
    rng = random.Random(11)
    words = {"xx": _VOCAB[:150], "yy": _VOCAB[150:]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(60)), x, "s", 1) for i, x in enumerate(["xx", "yy"] * 20)]
    rows += [(50, rows[0][1], "xx", "s", 1), (51, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(40) if i != 3] and all(r.n_tokens == len(r.ids) > 0 for r in got)
