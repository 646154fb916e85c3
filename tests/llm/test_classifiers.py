import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from greenlight.llm import language_id, quality

SYLLABLES = {"en": "the and ing tion ou er wh".split(), "de": "der die ung ch sch ein ß".split(), "fr": "le que ment eau é oi ç".split(), "es": "el los ción ñ ar do í".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 80))), lang))
    return rows


def test_language_accuracy_and_odd_texts(spark):
    rows = corpus(300) + [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "the " * 900_000, "en"), (None, corpus(1, 9)[0][1], None), (1004, "日本語", None)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, lang string, score int").repartition(2)
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    model = language_id.learn(docs, ~held, per_label=60)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    tested = [x for x in rows[:300] if x[0] % 3 == 1]
    assert sum(out[d].lang_pred == lang for d, _, lang in tested) >= 0.97 * len(tested)
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (1000, 1001, 1002))
    assert out[1003].lang_pred == "en" and out[1004].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_pieces_equal_the_whole(spark):
    text = corpus(1)[0][1] * 40
    docs = spark.createDataFrame(corpus(80), "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True), per_label=20)
    whole = model.margins(pa.array([text]))
    small, language_id.PIECE = language_id.PIECE, 500
    try:
        assert abs(model.margins(pa.array([text])) - whole).max() < 1e-5
    finally:
        language_id.PIECE = small


def naive_margins(model, text):
    """Mean weight over all grams of one text, gram by gram."""
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text).encode())
    found = [int(language_id.grams(np.frombuffer(data[k : k + n], np.uint8))[language_id.ORDERS.index(n)][0])
             for n in language_id.ORDERS for k in range(len(data) - n + 1)]
    return sum(model.weights[g].astype(float) for g in found) / max(1, len(found)) + model.bias


def test_language_equals_a_naive_scorer(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True), per_label=20)
    texts = [r[1] for r in rows[:12]] + ["", "a", "ab", "ÄÖ Über, x9y", "die"]
    margins = model.margins(pa.array(texts))
    for k, text in enumerate(texts):
        want = naive_margins(model, text)
        assert abs(margins[k] - want).max() < 1e-5
        n = len(model.families)
        codes = model.languages[model.families[int(want[:n].argmax())]]
        votes = {c: 0.0 for c in codes}
        for p, (a, b) in enumerate(model.pairs):
            if a in codes:
                votes[a if want[n + p] > 0 else b] += 1
        assert model.predict(pa.array([text]))[0][0] == max(votes, key=votes.get)


def test_language_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame(corpus(40), "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True), per_label=20)
    assert language_id.predict(docs.limit(0), model).count() == 0
    twice = language_id.predict(docs.union(docs), model).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("lang_pred", "score").alias("kinds")).collect()
    assert len(twice) == 40 and all(r.n == 2 and r.kinds == 1 for r in twice)


@pytest.mark.parametrize("langs,want", [([], "und"), (["en"], "en")])
def test_language_with_few_labels(spark, langs, want):
    docs = spark.createDataFrame([(k, "some text here", lang) for k, lang in enumerate(langs + [None])], "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {want}


def quality_rows(n):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + r.choice(["", "", ",", "."]) for _ in range(60))
    bad = lambda: r.choice([good().upper().replace(" ", "!! "), "word " * 60, good().replace(" ", " $$$ ")])
    return [(k, good() if k % 3 else bad(), int(bool(k % 3))) for k in range(n)]


def test_quality_separates_and_compiles(spark):
    rows = quality_rows(300)
    docs = spark.createDataFrame([(d, t, 5.0) for d, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "x" * 6_000_000, 0.0), (None, rows[0][1], 0.0)], "doc_id long, text string, score double").repartition(2)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(5000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    ensemble = quality.learn(docs, labels, F.col("doc_id") % 4 != 2, most_rows=150)
    assert 0 < len(ensemble.rules) < 200 and all(r.bounds for r in ensemble.rules)
    out = {r.doc_id: r.score for r in quality.score(docs, ensemble).collect()}
    held = [(d, q) for d, _, q in rows if d % 4 == 2]
    assert sum((out[d] >= 0.7) == bool(q) for d, q in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in out.values()) and out[900] == out[901]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.learn(docs, labels, F.lit(True))).first().score == pytest.approx(0.5)
    assert quality.score(docs.limit(0), quality.Ensemble([], [], 0.0)).count() == 0


def test_lists_of_an_arrow_column_are_slices_of_its_memory():
    import pyarrow as pa
    from greenlight.llm.language_id import lists_of

    whole = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32()))
    column = pa.chunked_array([whole.slice(1), pa.array([[4, 5]], pa.list_(pa.int32()))])
    assert [x.tolist() for x in lists_of(column)] == [[1, 2], [], [3], [4, 5]]
    assert all(x.base is not None for x in lists_of(column))


def test_features_of_the_language_model_are_scaled_without_copies():
    import tracemalloc

    r = np.random.default_rng(1)
    samples = []
    for k in range(1200):
        at = np.unique(r.integers(0, 3000, 400)).astype(np.int32)
        value = r.random(len(at)) * (1 + (at % 4 == k % 4))
        samples.append((("en", "de", "fr", "ru")[k % 4], at, value / value.sum()))
    tracemalloc.start()
    model = language_id.fit(samples, language_id.FAMILY_OF)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 1200 * 3000 * 4
    assert model.families == ["germanic", "romance", "slavic"] and np.isfinite(model.weights).all()
