import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from greenlight.llm import jaccard_join


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_force(rows, n, percent):
    """Size and component of every row, by comparing all pairs that share a token."""
    sets = [shingles(t, n) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("rstlnm") + str(r.randint(0, 9))
    text = lambda k: [word() for _ in range(k)]
    shared = [text(25) for _ in range(4)]
    out = []
    for size, copies, edits in ((60, 40, 2), (200, 30, 5), (40, 25, 3), (150, 6, 4), (90, 12, 1)):
        base = text(size)
        for _ in range(copies):
            mine = list(base)
            for _ in range(r.randint(0, edits)):
                mine[r.randrange(len(mine))] = word()
            out.append(mine)
    for _ in range(60):  # shared passages, alone or side by side
        out.append(text(r.randint(0, 20)) + r.choice(shared) + r.choice(shared + [[]]) + text(r.randint(0, 4)))
    chain = text(80)
    for _ in range(15):  # each close to the one before
        out.append(chain)
        chain = list(chain)
        chain[r.randrange(80)] = word()
    rows = [" ".join(w) for w in out] + [text.upper() for text in (" ".join(out[0]), " ".join(out[50]))] * 3
    rows += [None, "", " \t ", "one", "one", "one two", "one two three four", "x " * 3000]
    r.shuffle(rows)
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows)) + [(None, rows[5]), (None, "alone and without an id here"), (ids[3], rows[3])]


@pytest.mark.parametrize("seed,sizes", [(1, {}), (3, {"least_frequent": 3, "small_key": 2})])
def test_equals_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, sid string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.classes(docs, 4, 85, **sizes).collect())
    assert got == brute_force(rows, 4, 85)


def test_five_words_at_eighty(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = jaccard_join.keep_one(docs, 5, 80, least_frequent=10**6, small_key=3).collect()
    part = {d: (n, c) for d, n, c in brute_force(rows, 5, 80)}
    with_words = {str(r.doc_id) for r in kept if (r.text or "").split()} - {"None"}
    assert with_words == {c for d, (n, c) in part.items() if n and d != "None"}
    assert sum(not (r.text or "").split() for r in kept) == sum(not (t or "").split() for _, t in rows)


def test_links_between_two_classes_under_one_key(spark):
    """Chains of three sets of frequent tokens only: a key's first pivot may reach one, and leave the link of the other two."""
    r = random.Random(5)
    rows = []
    for k in range(60):
        body = [f"b{k}x{j}" for j in range(13)]
        rows += [" ".join(t) for t in ([f"s{k}", *body], body, [*body, f"e{k}"])]
    rows = [(i, t) for i, t in enumerate(rows * 20)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.classes(docs, 4, 85).collect())
    want = {i: i // 3 * 3 for i in range(180)}
    assert got == sorted((str(i), 10 if i % 3 == 1 else 11, str(want[i % 180])) for i, _ in rows)


def test_empty(spark):
    assert jaccard_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_class_table_is_made_without_a_byte_for_each_bit():
    import tracemalloc

    places = np.array([0, 1, 9, 9, (1 << jaccard_join.CLASS_BITS) - 1])
    tracemalloc.start()
    table = jaccard_join._bits(places)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < (1 << jaccard_join.CLASS_BITS - 3) * 1.1
    found = np.flatnonzero(jaccard_join.is_frequent(table, np.arange(16, dtype=np.uint64) << np.uint64(jaccard_join.TOKEN_BITS - jaccard_join.CLASS_BITS)))
    assert found.tolist() == [0, 1, 9] and table[-1] == 1


@pytest.mark.parametrize("size", [1, 500])
def test_pairs_by_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BLOCK_PAIRS", size)
    r = random.Random(4)
    sets = {h: sorted(r.sample(range(14), r.randint(9, 14))) for h in range(-20, 20)}
    frame = spark.createDataFrame([(h, bytes([h + 20]), t) for h, t in sets.items()], "handle long, sid binary, tokens array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b and r.random() < 0.5]
    got = jaccard_join._compare_blocks(spark.createDataFrame([*pairs, *((b, a) for a, b in pairs[:9])], "a long, b long"), frame, 70).collect()
    same = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 70 * len({*sets[a]} | {*sets[b]})
    assert sorted((x.a, x.b, x.a_sid[0] - 20, x.b_sid[0] - 20) for x in got) == sorted((a, b, a, b) for a, b in pairs if same(a, b))
