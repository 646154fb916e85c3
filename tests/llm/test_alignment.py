import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from greenlight.llm import alignment, queries

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
A = tokenizers.Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
BYTES = {c: b for c, b in alignment.byte_level().items()}


def naive(text):
    """Groups of ids by definition, None where the text has no tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    ids_a = A.encode(" " + text, add_special_tokens=False).ids
    ids_b = B.encode(text)
    bytes_a = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    out, low = [], 0
    for cut in cuts:
        out.append(([i for i, e in zip(ids_a, ends_a) if low < e <= cut], [i for i, e in zip(ids_b, ends_b) if low < e <= cut]))
        low = cut
    return out


def rows_of(texts):
    """The rows of the batch function for these texts."""
    import pyspark

    context = pyspark.TaskContext
    old, context.get = context.get, staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())
    try:
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([" " + (t or "") for t in texts], pa.string())})
        return [r for out in alignment._aligner(PATHS)([batch]) for r in out.to_pylist()]
    finally:
        context.get = old


def check(texts):
    for row, text in zip(rows_of(texts), texts, strict=True):
        want = naive(text) or []
        links = Counter()
        for a, b in want:
            links.update({(x, y): i * j for x, i in Counter(a).items() for y, j in Counter(b).items()})
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert row["groups_sha256"] == (hashlib.sha256(told.encode()).hexdigest() if want else "")
        assert (row["n_a"], row["n_b"], row["n_groups"]) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
        assert row["n_links"] == sum(links.values())
        assert {(x["a"], x["b"]): x["m"] for x in row["links"]} == dict(links)


chars = st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t\xa0　 \x85\x1cab'stéß▁漢字かな안녕0129.,-<|endoftext|></s>\x00"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(chars, max_size=40), max_size=8))
def test_groups_and_links_equal_the_definition(texts):
    check(texts)


def test_given_texts_and_parts(monkeypatch):
    texts = ["", None, " ", "  lead", "trail  ", "<|endoftext|> x<s> y", "a▁b", "it's   we'll\n\n def f(x):\n    return x", "ﬁ ½ ４", "word " * 300, "=" * 500, "漢字" * 200, "aB3$" * 300]
    check(texts)
    monkeypatch.setattr(alignment, "PART", 64)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    monkeypatch.setattr(alignment, "CELLS", 16)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 5)
    check(texts)


def test_overlaps_equal_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = int(rng.integers(1, 30))
        lengths = [np.diff(np.unique(np.concatenate([[0, total], rng.integers(0, total + 1, 8)]))) for _ in (0, 1)]
        ids = [np.arange(len(x)) for x in lengths]
        found = alignment.Aligned(tuple(ids), tuple(np.zeros(len(x), np.int64) for x in lengths), tuple(lengths))
        ends = [np.cumsum(x) for x in lengths]
        want = {(i, j) for i in ids[0] for j in ids[1] if ends[0][i] - lengths[0][i] < ends[1][j] and ends[1][j] - lengths[1][j] < ends[0][i]}
        got = list(map(tuple, found.overlaps().tolist()))
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("head", [0, 20, 1 << 18])
def test_query_equals_counts_over_all_documents(spark, tmp_path, monkeypatch, head):
    texts = [None, "", "the theory of thermodynamics", "the theory of thermodynamics", "the a▁b", "Schrödinger's cat & the theory", "unbelievable the 12345 the the", "漢字 the"] * 2
    rows = [(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)]
    folder = f"{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, row string").write.parquet(folder + "/documents.parquet")
    monkeypatch.setattr(alignment.align, "__defaults__", (head,))
    got = sorted((tuple(-1 if v is None else v for v in r) for r in queries.op11_token_alignment(spark, folder).collect()))
    links = []
    for _, text, _ in rows:
        mine = Counter()
        for a, b in naive(text) or []:
            mine.update({(x, y): i * j for x, i in Counter(a).items() for y, j in Counter(b).items()})
        links.append(mine)
    counts = Counter(p for mine in links for p in mine)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for (doc, text, _), mine in zip(rows, links):
        found = naive(text) or []
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        want.append((
            -1 if doc is None else doc, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), sum(mine.values()),
            sum(m for p, m in mine.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in mine.items()),
            hashlib.sha256(told.encode()).hexdigest() if found else "",
        ))
    assert got == sorted(want)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
