import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from greenlight.llm import personal, personal_labels, queries
from greenlight.llm.personal import KINDS, N_TAGS


def naive(text):
    """The patterns as they are stated, by plain regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m.group())]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


signs = st.text(st.sampled_from("ab019.@-+ ()%_é٣"), max_size=40)
made = st.builds(
    lambda a, b, c: a + b + c, signs, st.sampled_from(["x.y@mail.co.uk", "a@b@c.de.", "255.1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "+1 (743) 555-3824", "+33 1 23 45 67 89 0 1 2 3", "00.01.002.0003"]), signs
)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(signs, made))
def test_patterns_equal_the_regular_expressions(text):
    assert personal.patterns(text) == naive(text)


def test_patterns_are_linear():
    n = 400_000
    for text in ("1" * n, "1." * n, "a" * n + "@", "@" * n, "a@" * n, "a@b" * n, "+1" * n, "+1 " + "(" * n, "1 " * n, "1-" * n + "+"):
        personal.patterns(text)


@pytest.fixture(scope="module")
def field():
    return personal.train(personal_labels.labelled())


def found_in(field, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    tagged = {}
    for k, kind, a, b in field.tagged(np.frombuffer(b"".join(raw), np.uint8), offsets):
        tagged.setdefault(k, []).append((kind, len(raw[k][:a].decode()), len(raw[k][:b].decode())))
    return [personal.spans_of(t, tagged.get(k, [])) for k, t in enumerate(texts)]


def test_held_out_sentences(field):
    rows = personal_labels.labelled(1500, seed=99)
    got = [{s[:3] for s in spans} for spans in found_in(field, [t for t, _ in rows])]
    want = [set(s) for _, s in rows]
    hits = sum(len(g & w) for g, w in zip(got, want))
    assert hits / sum(map(len, want)) >= 0.9
    assert hits / sum(map(len, got)) >= 0.95
    base = sum(len(set(naive(t)) & w) for (t, _), w in zip(rows, want))
    assert hits > 1.3 * base  # the field finds much that the patterns don't


def test_plain_text_stays_clean(field):
    texts = [
        "On 2024-05-17 at 10:30 version 1.2.3 cost $1,234.56 or 12%.", "ISBN 978-3-16-148410-0, page 12-14, ratio 3:2.", "look at the dot on the point", "Compute 12 * 7 + 3 * 5 - 8 * 2 + 9",
        "the 4th of July 1776", "card 4111111111111112 is wrong", "999.999.999.999", "x" * 5000, "at at dot dot", "Meet at noon. Point taken.",
    ]
    assert found_in(field, texts) == [[] for _ in texts]


def test_leaving_lines_out_loses_nothing(field):
    texts = [t for t, _ in personal_labels.labelled(400, seed=7)] + ["no sign here\nbut at web dot org here\n12"]
    quick = found_in(field, texts)
    whole = personal.Reader.read
    try:
        personal.Reader.read = lambda self, data, offsets, all_lines=True: whole(self, data, offsets, True)
        assert found_in(field, texts) == quick
    finally:
        personal.Reader.read = whole


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 1, 3, 4, 2])
    emission = rng.normal(size=(int(lengths.sum()), N_TAGS)).astype(np.float32)
    trans = (rng.normal(size=(N_TAGS, N_TAGS)) + personal.allowed()).astype(np.float32)
    first = np.cumsum(lengths) - lengths
    got = personal.viterbi(emission, first, lengths, trans)
    for a, n in zip(first.tolist(), lengths.tolist()):
        best = max(
            itertools.product(range(N_TAGS), repeat=n),
            key=lambda p: personal.starts_allowed()[p[0]] + sum(emission[a + k, t] for k, t in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:])),
        )
        assert tuple(got[a : a + n].tolist()) == best


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    length = np.array([3, 1, 5])
    first = np.cumsum(length) - length
    emission, trans = rng.normal(size=(9, N_TAGS)), rng.normal(size=(N_TAGS, N_TAGS)) + personal.allowed()
    gold = np.array([0, 1, 2, 0, 3, 4, 4, 0, 5])
    value, d_em, d_trans = personal.gradient(emission, gold, first, length, trans)
    for place in [(0, 0), (2, 2), (3, 1), (6, 4), (8, 5)]:
        moved = emission.copy()
        moved[place] += 1e-5
        assert d_em[place] == pytest.approx((personal.gradient(moved, gold, first, length, trans)[0] - value) / 1e-5, abs=1e-3)
    for place in [(0, 1), (1, 2), (0, 0), (0, 5)]:
        moved = trans.copy()
        moved[place] += 1e-5
        assert d_trans[place] == pytest.approx((personal.gradient(emission, gold, first, length, moved)[0] - value) / 1e-5, abs=1e-3)


def test_query_equals_the_contract(spark, tmp_path):
    texts = [None, "", "write a.b@c.de, or +1 (743) 555-3824!", "é 10.0.0.1 é 4111 1111 1111 1111", "anna [at] example [dot] com", "call (743) 555-3824\n", "plain text", "1 2 3 " * 3000 + "x@y.zz"]
    rows = [(None, "a@b.cd", "x")] + [(k, t, "x") for k, t in enumerate(texts)] + [(2, texts[2], "x")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {d: t or "" for d, t, _ in rows}
    for r in got:
        base = naive(by_id[r["doc_id"]])
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) | {""}
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[4] == "email:0:27" and spans[5] == "phone:5:19" and spans[6] == "" and spans[0] == ""


def test_empty_tables(spark, field):
    assert personal.find(spark.createDataFrame([], "doc_id long, text string"), field).count() == 0
    with pytest.raises(ValueError):
        personal.learn(spark.createDataFrame([], personal_labels.SCHEMA))
