import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from greenlight.functions import similarity
from greenlight.functions.text import normalize_title
from greenlight.operators import titles
from greenlight.operators.resolve import best_title_match


def norm(t):
    return re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()


def score(a, b):
    a, b = norm(a), norm(b)
    return round(SequenceMatcher(None, a, b).ratio() * 100, 2) if a and b else None


def test_title_similarity_is_the_sequence_ratio(spark):
    rng = random.Random(7)
    words = "deep learning for graph data tide diet café 2024".split()
    rows = [("tide", "diet"), ("diet", "tide"), ("", "x"), ("Same, Title!", "same title")]
    rows += [(" ".join(rng.choices(words, k=n)), " ".join(rng.choices(words, k=n))) for n in (1, 3, 8, 60) for _ in range(10)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", similarity.title_similarity("a", "b").alias("s")).collect():
        assert r["s"] == score(r["a"], r["b"])


def test_unicode_title(spark):
    rows = ["ﬁne Straße", "ＡＢＣ—x", "plain ASCII, ok", "İstanbul é", "", "١٢ ok"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in df.select("t", similarity.normalize_title_unicode("t").alias("f")).collect():
        folded = unicodedata.normalize("NFKC", r["t"]).casefold()
        assert r["f"] == " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def test_diffs_rebuild_both_texts(spark):
    df = spark.createDataFrame([("The old, cat sat", "The new cat  sat down"), ("", "x"), (None, "y")], "a string, b string")
    for f in (similarity.word_diff, similarity.char_diff):
        for r in df.select("a", "b", f("a", "b").alias("d")).collect():
            assert "".join(x["old"] for x in r["d"]) == (r["a"] or "")
            assert "".join(x["new"] for x in r["d"]) == (r["b"] or "")
            assert all((x["old"] == x["new"]) == (x["op"] == "equal") for x in r["d"])


def mutate(rng, title):
    chars = list(title)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(chars)) if chars else 0
        chars[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "qq", " "])
    return "".join(chars)


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95])
def test_best_title_match_equals_brute_force(spark, threshold):
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    masters = [(f"M{i:02d}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(40)] + [("M90", ""), ("M91", "a")]
    queries = [(f"V{i:02d}", mutate(rng, rng.choice(masters)[1])) for i in range(60)] + [("V90", "unrelated words 123"), ("V91", "a"), ("V92", "")]
    got = {
        r["version_id"]: (r["suggested_id"], r["score"])
        for r in best_title_match(
            spark.createDataFrame(queries, "version_id string, title string"),
            spark.createDataFrame(masters, "record_id string, title string"),
            threshold,
        ).collect()
    }
    expected = {}
    for vid, title in queries:
        best = None
        for rid, official in sorted(masters):
            s = score(title, official)
            if s is not None and s >= threshold * 100 and (best is None or s > best[1]):
                best = (rid, s)
        if best:
            expected[vid] = best
    assert got == expected
    assert len(expected) > 20


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_score(left, right):
    a, b = (" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) for t in (left, right))
    return round(100 * (1 - edits(a, b) / max(len(a), len(b))), 2) if a and b else None


@pytest.mark.parametrize("scorer, threshold", [("sequence", 0.6), ("sequence", 0.8), ("levenshtein", 0.8), ("levenshtein", 0.5)])
def test_title_search_equals_brute_force(spark, scorer, threshold, monkeypatch):
    monkeypatch.setattr(titles, "BLOCK", 3)
    rng = random.Random(5)
    stem = "Shipment {} for customer {} dated 19{}".format
    masters = [(f"M{i:02d}", stem(rng.randint(1, 99), rng.randint(100, 130), rng.randint(90, 99))) for i in range(30)]
    masters += [("M80", "a"), ("M81", "0000000000 0000000000"), ("M82", ""), ("M83", "zz zz"), ("M84", masters[3][1]), (None, "zz zz")]
    asked = [(f"V{i:02d}", mutate(rng, rng.choice(masters)[1] + rng.choice(["", " volume 3", "!"]))) for i in range(40)]
    asked += [("V90", "0000000000 00000000"), ("V91", "nothing like it at all"), ("V92", None), ("V93", "ab"), ("V93", "ab"), ("V94", "é" * 9), ("V95", "x" * 5000)]
    judge = score if scorer == "sequence" else edit_score
    official = spark.createDataFrame([(*m, 1) for m in masters], "record_id string, title string, a int")
    found = titles.search(spark.createDataFrame([(*q, 1) for q in asked], "version_id string, title string, lb int"), official, threshold, scorer)
    want = []
    for vid, title in asked:
        scores = [(judge(title or "", text), rid) for rid, text in masters if rid]
        top = max((s for s, _ in scores if s is not None and s >= 100 * threshold), default=None)
        if top is not None:
            want.append((vid, min(r for s, r in scores if s == top), top))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert len(want) > 20


def test_title_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "version_id string, record_id string, title string")
    one = spark.createDataFrame([("V", "P", "a title")], "version_id string, record_id string, title string")
    assert titles.search(none, one).count() == titles.search(one, none).count() == 0
    with pytest.raises(ValueError):
        titles.search(one, one, 0.3)


def test_levenshtein_sibling(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x")], "a string, b string")
    rows = df.select(similarity.levenshtein_similarity("a", "b").alias("s")).collect()
    assert [r["s"] for r in rows] == [57.14, None]


def test_registered_functions(spark):
    similarity.register_functions(spark)
    assert spark.sql("SELECT fold_unicode('ＡＢ') AS f").first()["f"] == "ab"
    assert spark.range(1).select(F.expr("title_ratio('tide', 'diet')")).first()[0] == 25.0


def test_titles_with_words_added_are_searched_once_above_their_beginning(spark, monkeypatch):
    made = [(f"P{k}", f"Shipment {k} for customer {k * 7 % 100} dated 1995-01-{k % 28 + 1:02d}") for k in range(100, 160)]
    official = spark.createDataFrame([*made, ("P900", "Shipment 101 for customer 7 dated 1995-01-18 revise")], "record_id string, title string")
    asked = spark.createDataFrame([(f"F{i}", f"{t} revised") for i, t in made] + [("F0", "Shipment")], "version_id string, title string")
    passes, real = [], titles.like_pairs
    monkeypatch.setattr(titles, "like_pairs", lambda *args: passes.append(1) or real(*args))
    for scorer, score in (("sequence", titles._score("sequence")), ("levenshtein", titles._score("levenshtein"))):
        passes.clear()
        got = {r["version_id"]: (r["suggested_id"], r["score"]) for r in titles.search(asked.where("version_id <> 'F0'"), official, 0.8, scorer).collect()}
        assert len(passes) == 1  # no title is left for the search in steps
        pairs = asked.select("version_id", normalize_title("title").alias("a")).crossJoin(official.select("record_id", normalize_title("title").alias("b")))
        scored = pairs.withColumns({"la": F.length("a"), "lb": F.length("b")}).withColumn("score", score).where("score >= 80")
        best = scored.groupBy("version_id").agg(F.max("score").alias("s"), F.min_by("record_id", F.struct(-F.col("score"), "record_id")).alias("r"))
        assert got == {r["version_id"]: (r["r"], r["s"]) for r in best.collect()} and got["FP101"][0] == "P900"
    assert titles.search(asked, official, 0.8).count() == 60
