import collections

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_language import SYLLABLES

import corpus_pipeline
from gaugeworks.llm import language
from gaugeworks.llm.merge_replay import load_ranks


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    rng, rows = np.random.default_rng(7), []
    for i in range(150):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(60)]
        rows.append((i, " ".join(words), lang, "hot" if i % 3 else f"s{i % 5}"))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(words), lang, "copies"))
            rows.append((2000 + i, " ".join(words[:-1] + ["other"]), lang, "copies"))
    rows += [(5000, None, "aa", None), (5001, "", None, "hot"), (5002, "1234 5678", "bb", "hot")]
    path = tmp_path_factory.mktemp("pipeline")
    docs_of(rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_copies", "mixing", "encoding"]
    spoken = steps["language"](spark, docs, path)
    assert spoken.columns == docs.columns
    assert {r.doc_id for r in spoken.collect()} == {r[0] for r in rows if r[0] < 5000}
    single = steps["near_copies"](spark, spoken, path)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == list(range(150))
    mixed = steps["mixing"](spark, single, path)
    assert mixed.columns == docs.columns
    tokens = collections.Counter()
    for r in mixed.collect():
        tokens[r.source] += len(r.text.split())
    assert sum(tokens.values()) <= 150 * 60 and len(tokens) == len({r[3] for r in rows if r[0] < 1000})
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    text = {r[0]: r[1] for r in rows}
    ids = steps["encoding"](spark, mixed, path).collect()
    assert len(ids) == mixed.count() and all(r.ids == library.encode_ordinary(text[r.doc_id]) for r in ids)


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, path)
    def key(r):
        return r.doc_id, tuple(r.ids)
    assert sorted(map(key, corpus_pipeline.run(spark, path).collect())) == sorted(map(key, docs.collect()))


def test_empty_table_and_odd_rows(spark, odd, empty, tmp_path):
    for name, df in (("odd", odd), ("empty", empty)):
        path = f"{tmp_path}/{name}"
        df.withColumn("n_chars", F.lit(0).cast("long")).write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, path)
        assert docs.count() >= 0
    assert language.learn(empty) == {}
