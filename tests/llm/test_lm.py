import math
import zlib
from collections import Counter

import numpy as np
import pytest

from greenlight.llm import lm, queries

TEXTS = [
    (1, "The cat sat on the mat"), (2, "the dog sat on THE mat\x0bagain"), (3, None), (4, ""), (5, "Été été x\tx x"), (6, "the the the"),
    (7, "cat cat dog"), (7, "cat cat dog"), (None, "unseen words only here"), (8, "long " * 5000), (9, "the cat sat"), (11, "a b c d e f g"),
]


def words_of(text):
    return (text or "").encode().lower().split() + [None]


def base(texts, train):
    counts = Counter(w for t in train for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words_of(t))) for t in texts]


@pytest.mark.parametrize("head_words", [0, 3, 1000])
def test_base_score_is_exact(spark, head_words):
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in TEXTS], "doc_id long, text string, score double")
    train = docs.where("doc_id <> 11 or doc_id is null").where("doc_id is not null")
    model, words = lm.learn(train, head_words=head_words)
    rows = lm.score(docs, model, words).collect()
    n, want = base([t for _, t in TEXTS], [t for d, t in TEXTS if d not in (None, 11)])
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert got == sorted((str(d), a, b, round(c, 6)) for (d, _), (a, b, c) in zip(TEXTS, want))
    assert {r.train_tokens for r in rows} == {n}
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    by = {r.doc_id: r.score / r.n_tokens for r in rows}
    assert by[9] > by[11]


def test_query_folds(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_lm_score(spark, str(tmp_path)).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    n, want = base([t for _, t in TEXTS], [t for d, t in TEXTS if not out(d)])
    assert sorted((str(r.doc_id), r.held_out, r.n_known, round(r.base_score, 6)) for r in rows) == sorted((str(d), out(d), b, round(c, 6)) for (d, _), (_, b, c) in zip(TEXTS, want))


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    counts = rng.integers(1, 3000, 5000)
    f = lm.Filter(np.zeros(8 << 12, np.uint64), 12)
    f.add(keys, counts, keys)
    about = f.count(keys)
    assert (about >= counts / 2).all()  # never a false negative
    assert np.mean(about <= counts * 2) > 0.97
    assert np.mean(f.count(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)) == 0) > 0.9


def test_large_filter_gives_the_same_scores(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    train = docs.where("doc_id is not null")

    def scores(**sizes):
        model, words = lm.learn(train, **sizes)
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, model, words).collect())

    want = scores()
    assert scores(max_bytes=64) == want
    assert scores(max_bytes=64, share_bytes=4096) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, words = lm.learn(docs)
    assert lm.score(docs, model, words).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(one, model, words).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
