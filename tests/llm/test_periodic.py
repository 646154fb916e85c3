import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from greenlight.llm import periodic, queries
from greenlight.llm.words import hash_spans, slices, word_bounds


def brute(words, least=24):
    """All runs by definition: (start, length, period)."""
    found = {}
    for period in range(1, len(words) // 3 + 1):
        start = 0
        for i in range(len(words) - period + 1):
            if i == len(words) - period or words[i] != words[i + period]:
                length = i - start + period
                if length >= max(least, 3 * period):
                    found.setdefault((start, length), period)
                start = i + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def fast(texts, least=24):
    out = []
    for _, data, offsets in slices(pa.array(texts, pa.string()), 1 << 20):
        starts, ends, rows = word_bounds(data, offsets)
        found = periodic.runs(hash_spans(data, starts, ends), rows, least)
        out += [[tuple(x[1:]) for x in found.tolist() if x[0] == k] for k in range(len(rows) - 1)]
    return out


pieces = st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 9)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(pieces, st.integers(1, 5)), max_size=5), max_size=4))
def test_nested_repeats_equal_brute_force(docs):
    docs = [[w for inner, times in doc for w in [c for text, k in inner for c in text * k] * times] for doc in docs]
    assert fast([" ".join(d) for d in docs]) == [brute(d) for d in docs]


def test_every_period_is_found_at_its_bound():
    rng = np.random.default_rng(5)
    texts, want = [], []
    for period in [*range(1, 40), 63, 64, 65, 127, 128, 129, 256]:
        for extra in (-1, 0, 1, period // 2):
            n = max(24, 3 * period) + extra
            unit = [f"w{x}" for x in rng.integers(0, 3 if period % 2 else 10**6, period)]
            words = ["x", "y", "z"] + (unit * (n // period + 1))[:n] + ["u", "v"]
            texts.append(" \n".join(words))
            want.append(brute(words))
    assert fast(texts) == want
    assert fast(texts[::-1]) == want[::-1]


def test_thue_morse_and_fibonacci_words():
    morse = ["ab"[bin(i).count("1") % 2] for i in range(5000)]
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert fast([" ".join(morse), " ".join(b)]) == [[], brute(list(b))]
    assert len(brute(list(b))) > 20


def test_long_runs_take_linear_time():
    start = time.time()
    assert fast(["a " * 300_000, " ".join(f"w{i % 50_000}" for i in range(300_000))]) == [[(0, 300_000, 1)], [(0, 300_000, 50_000)]]
    assert time.time() - start < 30


def by_contract(doc_id, text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_equals_the_contract(spark, tmp_path):
    texts = [None, "", " \t\n", "word", "ça va " * 20, "a\x1fb c\x0bd\x0ce\rf " * 9] + [f"the {i % 7} cat {i} sat " * (i % 40) for i in range(120)]
    rows = [(None, "a a " * 20, "x")] + [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")] * 2
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(folder + "/documents.parquet")
    got = queries.op12_periodic_runs(spark, folder)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in got.select(names).fillna(-1).collect())
    assert got == sorted(tuple(-1 if v is None else v for v in by_contract(d, t)) for d, t, _ in rows)
    assert periodic.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_must_cover_the_short_periods():
    with pytest.raises(ValueError):
        fast(["a"], 20)
