import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import order_minhash as om
from gaugeworks.llm.queries import QUERIES


def near(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = om.add_fingerprint(om.add_fingerprint(df, "a", "x"), "b", "y")
    return df.select(om.likeness(F.col("x"), F.col("y")).alias("n")).first().n


def text(seed, n=400):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def test_likeness_falls_with_edits(spark):
    base = text(1).split(" ")
    got = []
    for changed in (0, 10, 40, 120, 400):
        other = list(base)
        for i in range(changed):
            other[i * 400 // changed] = f"edit{i}"
        got.append(near(spark, " ".join(base), " ".join(other)))
    assert got[0] == 1 and got == sorted(got, reverse=True) and got[-1] < 0.05


def test_order_matters(spark):
    a, b = text(1, 200), text(2, 200)
    assert near(spark, a + " " + b, b + " " + a) < 0.75  # the same k-mers, but for a few


def test_repetition_counts(spark):
    assert near(spark, "abcdefgh " * 3, "abcdefgh " * 300) < 0.5


def test_numbers_by_occurrence_against_a_plain_count(spark):
    """A text with one k-mer only still fills all bins, by the numbers."""
    got = om.add_fingerprint(spark.createDataFrame([("a" * 5000,)], "t string"), "t", "f").first().f
    assert len(got) == 64 and len(set(got)) == 64


def test_a_kmer_that_occurs_once_is_hashed_once(spark):
    df = om.add_fingerprint(spark.createDataFrame([("abc",)], "t string"), "t", "f")
    row = df.select("f", F.xxhash64("t").alias("h"), F.xxhash64(F.shiftright(F.xxhash64("t"), 28)).alias("pair")).first()
    assert row.f == [((row.h >> 58) & 63) << 26 | row.pair & ((1 << 26) - 1)]


def test_odd_texts(spark):
    assert near(spark, None, "") == 1 and near(spark, "", "abc") == 0 and near(spark, "abc", "abc") == 1
    assert near(spark, "é" * 30, "é" * 30) == 1 and near(spark, "a" * 100000, "a" * 100000) == 1


def test_following_in_a_ring(spark):
    ids = [5, 3, None, 11, 7, -2, 10**15]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, key long")
    got = {r.key: r.next for r in om.following(df, "doc_id", "key").collect()}
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0), reverse=True)
    assert got == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    assert om.following(df.limit(0), "doc_id", "key").collect() == []


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    path = tmp_path_factory.mktemp("omh")
    rows = [(9, "one two three"), (4, None), (7, "é日x" * 40), (1, "z" * 30), (12, text(3, 50)), (13, text(3, 50))]
    docs_of(rows).withColumn("n_chars", F.lit(-1).cast("long")).write.parquet(f"{path}/documents.parquet")
    return str(path), {i: t or "" for i, t in rows}


def test_query(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op5_order_minhash"](spark, folder[0]).collect()}
    docs = sorted(folder[1].items(), reverse=True)
    for i, (doc_id, t) in enumerate(docs):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + docs[(i + 1) % len(docs)][1][:cut]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[doc_id].n_chars == len(t)
    assert got[12].fingerprint == got[13].fingerprint and got[13].near_next == 1.0 and got[4].fingerprint == ""


def test_no_python_in_the_plan(spark, folder, capsys):
    QUERIES["op5_order_minhash"](spark, folder[0]).explain("formatted")
    plan = capsys.readouterr().out
    assert plan and not any(w in plan for w in ("Python", "Pandas", "Arrow"))
