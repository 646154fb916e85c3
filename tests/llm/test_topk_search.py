import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenlight.llm import topk_search


def brute_force(rows, k, scale):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in whole if i % 5 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for own, q in whole if own == i for j, v in whole if j != i and len(v) == len(q))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 8192), (3, 7)])
def test_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(80)]
    rows += [(100 + k, [0.5] * 6) for k in range(30)] + [(200 + k, [0.0] * 6) for k in range(6)] + [(215, [-1.0] * 6), (220, [1e9, -1e9, 3e9, 1.0, 0.0, 2.0])]
    rows += [(300, [0.1, math.nan] + [0.0] * 4), (301, [math.inf] * 6), (302, [None] * 6), (303, None), (None, [0.9] * 6), (305, [0.2] * 4), (306, [0.3] * 4), (5, [9.0] * 6), (310, [])]
    rows += [(77, [4.0] * 6)] * 3 + [(77, [-4.0] * 6), (78, [4.0] * 6)] + [(315, [-0.5] * 6)] * 2
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk_search.top_k(df, F.col("vec_id") % 5 == 0, k=4, query_block=blocks[0], vector_block=blocks[1])
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_force(rows, 4, 1024)


def test_stops_early():
    """On lists that fall off steeply the walk ends long before the end."""
    n = 4000
    values = np.stack([np.sort((1e6 / np.arange(1, n + 1)).astype(np.int64))[::-1]] * 3, axis=1)
    block = topk_search.Lists(np.arange(n), values)
    seen = []
    plain = block.scores
    block.scores = lambda rows, q: (seen.extend(rows.tolist()), plain(rows, q))[1]
    ids, scores = block.search(-1, np.array([3, 2, 1]), 10)
    assert ids.tolist() == list(range(10)) and len(seen) < n / 10


def test_empty(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
