import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from greenlight.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
PLAIN = tokenizers.Tokenizer.from_file(PATH)


def ids_by_words(texts):
    out = []
    for _, data, offsets in packing.slices(pa.array(texts, pa.string()), 64):
        flat, counts = packing.tokenizer(PATH).ids_of(data, offsets)
        stops = np.cumsum(counts)
        out += [flat[b - n : b].tolist() for b, n in zip(stops.tolist(), counts.tolist())]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcXYZé'stß 019.,<|endoftext|>\n\t́ İΣ")), max_size=30), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    texts = texts + ["it's WE'LL the <|endoftext|> don't!!", "", "Élan VITAL çà 12.5%"]
    assert ids_by_words(texts) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=40))
def test_assign_fills_sequences(lengths):
    pieces, cost = packing.assign(np.array(lengths), 16, 1.0, 0.5)
    fill = defaultdict(int)
    spent = defaultdict(float)
    for doc, _, n, k, offset in pieces:
        assert fill[k] == offset
        fill[k] += n
        spent[k] += n + 0.5 * n * n
    assert all(f == 16 or f & (f - 1) == 0 for f in fill.values())
    assert [pytest.approx(spent[k]) for k in range(len(cost))] == cost
    by_doc = defaultdict(list)
    for doc, start, n, _, _ in pieces:
        by_doc[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at
            at += n
        assert at == length


def test_pack_keeps_every_id(spark):
    texts = [(1, "one two three " * 400), (2, None), (3, ""), (3, ""), (4, "Çà et là, it's"), (None, "word"), (5, "x" * 9000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, length string").repartition(2)
    rows = packing.pack(df, PATH, capacity=64, round_tokens=200).collect()
    want = sorted((d is None, d or 0, tuple(PLAIN.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
    whole = {(d if not n else None): ids for n, d, ids in want}
    fill = defaultdict(list)
    tokens = defaultdict(int)
    for r in rows:
        ids = np.array(whole[r.doc_id], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        fill[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert tokens[3] == 2 and tokens[2] == 1 and all(tokens[d] == len(i) for d, i in whole.items() if d != 3)
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
