import re

import pytest

from greenlight.llm import line_dedup

BASE = "the quick brown fox jumps over the lazy dog while seventeen other animals look on from the other side of the river bank"


def run(spark, rows, **parameters):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    out = line_dedup.dedup(docs, **parameters)
    return sorted(((str(r.doc_id), r.text, r.n_dropped) for r in out.collect()), key=str)


def test_exact_and_fuzzy_lines(spark):
    long = " ".join(f"word{k}" for k in range(400))
    rows = [
        (1, f"{BASE}\nunique line number one of this text\nAnd so on"),
        (2, f"{BASE.upper()}!!\n\nand, so: ON."),
        (3, f"something else entirely stands here\n{BASE}"),
        (4, None),
        (5, ""),
        (6, "too short\ntoo short\ntoo short"),
        (7, long),
        (8, long.replace("word399", "word999")),
        (9, "same text twice in this row\nsame text twice in this row"),
        (10, "a row that is repeated as a whole"),
        (10, "a row that is repeated as a whole"),
        (None, "a row that is repeated as a whole"),
    ]
    got = {(d, t) for d, t, _ in run(spark, rows)}
    assert ("1", f"{BASE}\nunique line number one of this text\nAnd so on") in got
    assert ("2", "") in got  # an empty line stays, so that two newlines remain none
    assert ("3", "something else entirely stands here") in got
    assert ("4", None) in got and ("5", "") in got and ("6", "too short\ntoo short\ntoo short") in got
    assert ("7", long) in got and ("8", "") in got
    assert ("9", "same text twice in this row") in got
    assert ("None", "a row that is repeated as a whole") in got and ("10", "") in got  # null sorts first




def test_simhash_is_the_majority(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 91}" for j in range(n))) for k, n in enumerate((1, 2, 3, 10, 64, 126, 127, 128, 1000, 70000))]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "split(t, ' ') as words")
    got = df.selectExpr("k", "transform(words, w -> xxhash64(w)) as hs").select("k", line_dedup.simhash(line_dedup.F.col("hs")).alias("sim")).collect()
    hashed = {r.k: r.hs for r in df.selectExpr("k", "transform(words, w -> xxhash64(w)) as hs").collect()}
    for r in got:
        hs = hashed[r.k]
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))
        assert r.sim == (want - (1 << 64) if want >> 63 else want)


@pytest.mark.parametrize("count", [10, 10**6])
def test_all_pairs_within_three_bits_meet(spark, count):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    sims = {b for b in base}
    for b in base:
        for _ in range(40 if b == base[0] else 3):
            x = b
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            sims.add(x)
    sims = sorted(sims)
    signed = [x - (1 << 64) if x >> 63 else x for x in sims]
    df = spark.createDataFrame(list(enumerate(signed)), "h long, sim long").repartition(3)
    pairs, crowded = line_dedup.candidates(df, count)
    found = {(p.a, p.b) for p in pairs.collect()}
    members = {}
    for row in crowded.collect():
        members.setdefault(row.key, set()).add(row.h)
    want = {(i, j) for i in range(len(sims)) for j in range(i + 1, len(sims)) if (sims[i] ^ sims[j]).bit_count() <= 3}
    assert found <= want
    assert all((i, j) in found or any({i, j} <= m for m in members.values()) for i, j in want)


def test_crowded_key_of_several_groups(spark):
    rows = [(k, f"{BASE} {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(80)]
    out = run(spark, rows)
    kept = [t for _, t, _ in out if t]
    edits = [re.sub(r"\W+", " ", t) for t in kept]
    assert len(kept) == len(edits) < 80


def test_unspaced_lines_take_part(spark):
    han, thai = "山路を登りながらこう考えた智に働けば角が立つ情に棹させば流される意地を通せば窮屈だ", "สวัสดีชาวโลกทั้งหลายวันนี้อากาศดีมาก"
    rows = [(1, f"{han}\n{thai}\n目次"), (2, f"{thai}\n{han}。\n目次"), (3, "x y")]
    got = {d: (t, n) for d, t, n in run(spark, rows)}
    assert got == {"1": (rows[0][1], 0), "2": ("目次", 2), "3": ("x y", 0)}


def test_empty(spark):
    assert run(spark, []) == []


def test_lines_of_crowded_keys_are_kept_and_not_dealt_out_again(spark):
    """A key with more lines than are held against each other gives them all, out of the table that holds the pairs."""
    rows = spark.createDataFrame([(h, (h % 40) << 1 if h < 40 else h << 40) for h in range(60)], "h long, sim long")
    pairs, crowded = line_dedup.candidates(rows, 60)
    by_key = {}
    for r in crowded.collect():
        by_key.setdefault(r["key"], set()).add(r["h"])
    assert by_key and all(len(x) > line_dedup.NEIGHBOURS + 1 for x in by_key.values())
    assert any(set(range(40)) <= x for x in by_key.values())
    assert "Exchange" not in crowded._jdf.queryExecution().executedPlan().toString()
    assert pairs.where("a = b").count() == 0
