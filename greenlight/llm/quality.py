"""Quality by a sparse rule ensemble over statistics of whole texts.

Shallow trees are grown on labelled texts, on the driver; every path from a root to a node becomes a rule, a conjunction of
bounds on statistics. A lasso logistic regression keeps few of the rules and gives them weights, and the kept
rules are compiled into one Spark column expression over the statistics.

Learning takes at most ``most_rows`` labelled rows, spread by a hash; statistics are taken of whole texts.

Defined results
- Null text is empty; an empty text has all statistics 0 and gets a score like any other.
- Labels that are null, or whose document is missing, are not learned. Of repeated labels of a document the
  largest counts, of repeated documents the smallest statistics. With one label value or none in the training
  rows the score is that value's share for every text, 0.5 with none.
- Rows are scored one by one, repeated or not; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import hashed_words, row_of, slices

MOST_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "punctuation_share", "symbol_share", "exclaim_share",
    "accent_share", "line_words", "distinct_share", "repeat_share", "top_share", "one_byte_share",
)
SYMBOLS = b"#$%&*|<>{}[]~^_=+@\\/"


def _classes() -> np.ndarray:
    """A class for each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 mark, 5 symbol, 6 '!', 7 above ASCII, 8 newline."""
    of = np.zeros(256, np.uint8)
    for k, chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b".,;:?'\"()-"), (5, SYMBOLS), (6, b"!"), (7, range(128, 256)), (8, b"\n")):
        of[list(chars)] = k
    return of


CLASS = _classes()


def statistics(column) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(column), len(STATISTICS)))
    for first, data, offsets in slices(column):
        n = len(offsets) - 1
        size = np.diff(offsets)
        totals = np.zeros((n, 9))
        classes = CLASS[data]
        for k in range(1, 9):
            sums = np.concatenate([[0], np.cumsum(classes == k, dtype=np.int64)])
            totals[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
        hashes, rows = hashed_words(data, offsets)
        words = np.diff(rows)
        row = row_of(rows)
        repeat = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > 1:
            repeat[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
        repeats = repeat[rows[1:]] - repeat[np.minimum(rows[:-1] + 1, rows[1:])]
        keyed = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.ones(len(keyed), bool)
        new[1:] = keyed[1:] != keyed[:-1]
        at = np.flatnonzero(new)
        owner = (keyed[at] >> np.uint64(40)).astype(np.int64)
        runs = np.diff(np.append(at, len(keyed)))
        distinct = np.bincount(owner, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, owner, runs)
        letters = np.maximum(1, totals[:, 1] + totals[:, 2])
        b, w = np.maximum(1, size), np.maximum(1, words)
        spaces = size - totals[:, 1:8].sum(axis=1)
        out[first : first + n] = np.stack([
            np.log1p(size), np.log1p(words), np.maximum(0, size - spaces) / w, totals[:, 2] / letters, totals[:, 3] / b, totals[:, 4] / b,
            totals[:, 5] / b, totals[:, 6] / b, totals[:, 7] / b, words / (totals[:, 8] + 1), distinct / w, repeats / w, top / w, spaces / b,
        ], axis=1)
    return out


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of docs with one double column for each statistic; the texts stay behind."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = [*keep, *STATISTICS]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{s} double" for s in STATISTICS)])

    def measured(batches):
        for batch in batches:
            values = statistics(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names)

    return rows.mapInArrow(measured, schema)


@dataclass(frozen=True)
class Rule:
    """Bounds that must all hold: (statistic, is at most, threshold)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, at_most, threshold in self.bounds:
            out &= (x[:, k] <= threshold) == at_most
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, at_most, threshold in self.bounds:
            bound = F.col(STATISTICS[k]) <= threshold
            out = out & (bound if at_most else ~bound)
        return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, bins: int = 48, least: int = 12) -> list[Rule]:
    """A rule for each node below the roots of shallow trees, each grown by Gini gain on half of the rows and half of
    the statistics. Of bounds on one statistic in one direction the last, which is the tightest, is kept."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    found: dict[Rule, None] = {}

    def impurity(n, ones):
        return np.where(n > 0, ones * (n - ones) / np.maximum(n, 1), 0.0)

    def walk(rows, columns, bounds, level):
        if bounds:
            found[Rule(tuple(sorted((k, side, t) for (k, side), t in bounds.items())))] = None
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best = (1e-9, 0, 0)
        for k in columns:
            n = np.cumsum(np.bincount(binned[rows, k], minlength=len(edges[k]) + 1))
            ones = np.cumsum(np.bincount(binned[rows, k], weights=y[rows], minlength=len(edges[k]) + 1))
            gain = impurity(n[-1], ones[-1]) - impurity(n[:-1], ones[:-1]) - impurity(n[-1] - n[:-1], ones[-1] - ones[:-1])
            gain[(n[:-1] < least) | (n[-1] - n[:-1] < least)] = 0.0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        if best[0] > 1e-9:
            _, k, at = best
            low = binned[rows, k] <= at
            walk(rows[low], columns, bounds | {(k, True): float(edges[k][at])}, level + 1)
            walk(rows[~low], columns, bounds | {(k, False): float(edges[k][at])}, level + 1)

    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), (len(y) + 1) // 2, replace=False))
        walk(rows, np.sort(rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False)).tolist(), {}, 0)
    return list(found)


def lasso_logistic(hits: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty on the weights, by accelerated proximal
    gradient steps."""
    n = len(y)
    a = np.hstack([hits, np.ones((n, 1), hits.dtype)])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 3.5 * n / float(v @ (a.T @ (a @ v)))
    w = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = ahead - step * (a.T @ (1.0 / (1.0 + np.exp(-np.clip(a @ ahead, -35, 35))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0.0, np.abs(new[:-1]) - step * penalty)
        t, before = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0, t
        ahead = new + (before - 1.0) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The logistic of the kept rules' weights, as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def labelled(docs: DataFrame, labels: DataFrame, training: Column, label: str, most_rows: int) -> DataFrame:
    """Statistics and label of at most ``most_rows`` labelled documents. The ids that are joined are bounded by
    that parameter, and so may be broadcast."""
    known = labels.where(training & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    spread = F.xxhash64("doc_id")
    chance = min(1.0, 2.0 * most_rows / max(1, known.count()))
    some = known.where(F.pmod(spread, F.lit(1 << 20)) < chance * (1 << 20)).orderBy(F.xxhash64(spread), "doc_id").limit(most_rows)
    found = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), ("doc_id", "label"))
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("label", "s.*")


def learn(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", most_rows: int = MOST_ROWS, trees: int = 30, depth: int = 3,
          penalty: float = 0.0005, seed: int = 7) -> Ensemble:
    """An ensemble from the labels that ``training`` (a condition on ``labels``) selects. The driver gets the
    statistics of at most ``most_rows`` documents."""
    rows = labelled(docs, labels, training, label, most_rows).toArrow()
    y = rows["label"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y[0], 1e-6, 1 - 1e-6))
        return Ensemble([], [], float(np.log(share / (1 - share))))
    x = np.stack([rows[s].to_numpy() for s in STATISTICS], axis=1)
    x = x[np.lexsort((*x.T, y))]
    y = np.sort(y)
    rules = grow_rules(x, y, trees, depth, seed)
    hits = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    weights, intercept = lasso_logistic(hits, y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9]
    return Ensemble([r for r, _ in kept], [w for _, w in kept], intercept)


def score(docs: DataFrame, ensemble: Ensemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs with ``score``, the chance of label 1."""
    return with_statistics(docs, keep).select(*keep, ensemble.score().alias("score"))
