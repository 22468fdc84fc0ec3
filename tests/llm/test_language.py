import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import language as lg

SYLLABLES = {"aa": "ka lo mi ren tu sha".split(), "bb": "ver ung isch ein dor alt".split(), "cc": "eau oi ment que tion ais".split()}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(8, 90)))]
        yield lang, " ".join(words)


def test_held_out_accuracy(docs_of):
    train = docs_of([(i, t, lang) for i, (lang, t) in enumerate(texts(1, 240))])
    test = docs_of([(i, t, lang) for i, (lang, t) in enumerate(texts(2, 150))])
    got = lg.detect(test, lg.learn(train, docs=40, slice_chars=300)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, empty, docs_of):
    know = lg.learn(docs_of([(i, t, lang) for i, (lang, t) in enumerate(texts(1, 60))]))
    got = {(r.doc_id, r.text): r for r in lg.detect(odd.withColumn("score", F.lit("clash")), know).collect()}
    assert len(got) == 10
    for (_, text), r in got.items():
        letter = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == lg.UNKNOWN) == (not letter) and (letter or (r.score == 0 and not r.accepted))
    assert lg.detect(empty, know).collect() == []
    assert lg.learn(odd) == {} and {r.lang_pred for r in lg.detect(odd, {}).collect()} == {lg.UNKNOWN}


def test_whole_text_counts():
    know = {"aa": "ka lo mi ren tu sha ".encode() * 50, "bb": "ver ung isch ein dor alt ".encode() * 50}
    tools = lg.Compressors(know, 64)
    assert tools.judge("ka lo mi " * 5 + "ver ung isch " * 200)[0] == "bb"


def test_sample_is_bounded_and_takes_labels_only(docs_of):
    rows = [(i, t, lang if i % 2 else None) for i, (lang, t) in enumerate(texts(3, 300))] + [(900 + i, "same ka text", "aa") for i in range(100)]
    know = lg.learn(docs_of(rows), docs=5, slice_chars=50)
    assert set(know) == set(SYLLABLES) and all(len(v) <= 5 * 51 for v in know.values())
