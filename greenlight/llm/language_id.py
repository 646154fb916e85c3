"""Language of whole texts: the family first, then one-versus-one linear SVMs within the family.

A text is its UTF-8 bytes with Latin letters lower-cased and every run of ASCII non-letters as one blank. Its
features are the relative frequencies of hashed byte 2- to 4-grams, so a linear classifier's value is the mean
weight over the grams and a text is scored in one pass, in bounded pieces, whatever its length.

The classifiers are fitted on the driver from at most ``per_label`` texts for each label and the 3000 most common
of the 32,768 hashed grams: families one against the rest, then each pair of languages of one family. Which languages
belong together is a parameter. The driver gets one count a label, so the labels must be the bounded set of a language
column.

Defined results
- Null text and text without a letter: ``und`` with score 0.
- Labels that are null are not learned. With one label in the training rows, every text with a letter gets it;
  with none, all get ``und``.
- Very long texts are read in pieces and judged whole. Equal pair wins go to the higher sum of pair values, then to the
  label that sorts first; equal families likewise.
- Rows are judged one by one, repeated or not; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenlight.llm.words import slices

PER_LABEL = 400
BITS = 15
ORDERS = (2, 3, 4)
PIECE = 256 << 10
UNKNOWN = "und"

#: Families of ISO 639-1 languages (fixed values); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "semitic": "ar he mt",
    "indo-aryan": "hi bn ur mr pa gu ne",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[128:] = np.arange(128, 256)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank for each run of other ASCII, and the new offsets."""
    out = _LOWER[data]
    capital = np.zeros(len(out), bool)  # U+00C0 to U+00DE are C3 80 to C3 9E in UTF-8
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out = out + capital.astype(np.uint8) * np.uint8(32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of every gram, by its first byte."""
    code, out = np.zeros(len(data), np.uint32), []
    for k in range(max(ORDERS)):
        code = code[: max(0, len(data) - k)] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        if k + 1 in ORDERS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def pieces(column):
    """Row numbers, normalised bytes, offsets and the number of first places for grams, of pieces of bounded size. A row
    longer than a piece comes in several; grams begin in one of them and may end in the next one's bytes."""
    for row, data, offsets in slices(column, PIECE):
        if len(offsets) == 2 and len(data) > PIECE:
            data, offsets = normalised(data, offsets)
            step = PIECE - max(ORDERS) + 1
            for at in range(0, len(data), step):
                part = data[at : at + PIECE]
                yield np.array([row]), part, np.array([0, len(part)]), step
        else:
            data, offsets = normalised(data, offsets)
            yield row + np.arange(len(offsets) - 1), data, offsets, len(data)


def gram_bounds(offsets: np.ndarray, order: int, first_places: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams that lie within each row begin and end."""
    return offsets[:-1], np.maximum(offsets[:-1], np.minimum(offsets[1:] - order + 1, first_places))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from each start to its end; the ranges are in order."""
    full = ends > starts
    out = np.zeros((len(starts), *values.shape[1:]))
    if full.any():
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= len(values) else edges
        out[full] = np.add.reduceat(values, edges, axis=0, dtype=np.float64)[::2]
    return out


def text_features(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and relative frequencies of each text, one text at a time."""

    def sparse(counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counted)
        return at.astype(np.int32), counted[at] / max(1.0, counted.sum())

    own, current = np.zeros(1 << BITS), 0
    for rows, data, offsets, places in pieces(column):
        coded = [(code, *gram_bounds(offsets, order, places)) for order, code in zip(ORDERS, grams(data))]
        for k, row in enumerate(rows.tolist()):
            if row > current:
                yield sparse(own)
                own[:], current = 0.0, row
            for code, starts, ends in coded:
                own += np.bincount(code[starts[k] : ends[k]], minlength=1 << BITS)
    if len(column):
        yield sparse(own)


def fit_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, L2) by accelerated gradient steps; classes weigh the same."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * cost
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)
    step = 1.0 / (1.0 + 2.0 * cost * (1.0 + float(np.einsum("ij,ij->i", x, x).max())))
    w = ahead = np.zeros(x.shape[1] + 1, x.dtype)  # the last one is the bias
    t = 1.0
    for _ in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - x.dtype.type(step) * (ahead - 2 * np.append(x.T @ pull, pull.sum()))
        t, before = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0, t
        ahead = new + x.dtype.type((before - 1.0) / t) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weights of all classifiers side by side: ``families`` one against the rest, then ``pairs``."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)

    def margins(self, column) -> np.ndarray:
        """The value of each classifier for each text."""
        sums = np.zeros((len(column), len(self.bias)))
        counts = np.zeros(len(column))
        for rows, data, offsets, places in pieces(column):
            for order, code in zip(ORDERS, grams(data)):
                starts, ends = gram_bounds(offsets, order, places)
                np.add.at(sums, rows, _sums(self.weights[code], starts, ends))
                np.add.at(counts, rows, ends - starts)
        return sums / np.maximum(counts, 1.0)[:, None] + self.bias

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each text: the product of the family's and the weakest pair's
        logistic values."""
        if not self.families:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        margins = self.margins(column)
        sure = 1.0 / (1.0 + np.exp(-4.0 * np.clip(margins, -10.0, 10.0)))
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1)
        score = sure[np.arange(len(column)), family] if n > 1 else np.ones(len(column))
        names = np.empty(len(column), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            codes = self.languages[name]
            wins, least = np.zeros((len(rows), len(codes))), np.ones((len(rows), len(codes)))
            for p, (a, b) in enumerate(self.pairs):
                if a in codes and b in codes:
                    s = sure[rows, n + p]
                    for code, value in ((codes.index(a), s), (codes.index(b), 1.0 - s)):
                        wins[:, code] += (value > 0.5) + 1e-3 * value
                        least[:, code] = np.minimum(least[:, code], value)
            best = wins.argmax(axis=1)
            names[rows] = np.array(codes, object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return names.tolist(), score


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], family_of: dict[str, str], most_features: int = 3000) -> Model:
    """A model from (label, buckets, frequencies); buckets are scaled by their spread, the most common are used."""
    labels = np.array([s[0] for s in samples], object)
    languages: dict[str, list[str]] = {}
    for code in sorted(set(labels.tolist())):
        languages.setdefault(family_of.get(code, code), []).append(code)
    families = sorted(languages)
    pairs = [pair for name in families for pair in combinations(languages[name], 2)]
    size = len(families) + len(pairs)
    model = Model(families, languages, pairs, np.zeros((1 << BITS, size), np.float32), np.zeros(size))
    if not samples:
        return model
    seen = np.zeros(1 << BITS)
    for _, at, _ in samples:
        seen[at] += 1
    used = np.sort(np.argsort(-seen, kind="stable")[:most_features])
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    x = np.zeros((len(samples), len(used)), np.float32)
    for row, (_, at, value) in enumerate(samples):
        inside = place[at] >= 0
        x[row, place[at][inside]] = value[inside]
    mean, spread = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32)
    for k in range(0, len(used), 64):  # in place: the features are the largest table on the driver
        part, here = x[:, k : k + 64], slice(k, k + 64)
        mean[here], spread[here] = part.mean(axis=0), part.std(axis=0) + 1e-4
        part -= mean[here]
        part /= spread[here]
    x /= np.float32(np.sqrt(len(used)))
    family = np.array([family_of.get(c, c) for c in labels], object)

    def put(k, rows, positive):
        w, b = fit_svm(x[rows], positive)
        w = w / (spread * np.sqrt(len(used)))
        model.weights[used, k] = w
        model.bias[k] = b - float(w @ mean)

    for k, name in enumerate(families if len(families) > 1 else []):
        put(k, slice(None), family == name)
    for k, (a, b) in enumerate(pairs):
        rows = np.flatnonzero((labels == a) | (labels == b))
        put(len(families) + k, rows, labels[rows] == a)
    return model


def sample(docs: DataFrame, training: Column, per_label: int) -> DataFrame:
    """At most ``per_label`` texts for each label among the training rows, spread by a hash of text and id."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    chance = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, 4.0 * per_label / r["count"])))) if counts else None
    if chance is None:
        return rows.limit(0).select("lang", "text")
    spread = F.xxhash64("text", "doc_id")
    rows = rows.where(F.pmod(spread, F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(spread), "doc_id"))
    return rows.withColumn("k", order).where(F.col("k") <= per_label).select("lang", "text")


def learn(docs: DataFrame, training: Column, per_label: int = PER_LABEL, family_of: dict[str, str] = FAMILY_OF) -> Model:
    def featured(batches):
        for batch in batches:
            found = list(text_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float64()))],
                ["lang", "at", "value"],
            )

    rows = sample(docs, training, per_label).mapInArrow(featured, "lang string, at array<int>, value array<double>").toArrow()
    at, value = lists_of(rows["at"]), lists_of(rows["value"])
    return fit(list(zip(rows["lang"].to_pylist(), at, value)), family_of)


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as slices of its own memory, without a Python object for each number."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(text: pa.Array) -> pa.Array:
        names, score = shared.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    letter = F.expr(r"coalesce(cast(text as string), '') rlike '\\p{L}'")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    judged = docs.select(*keep, judge(text).alias("_judged"), letter.alias("_letter"))
    return judged.select(
        *keep,
        F.when(F.col("_letter"), F.col("_judged.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letter"), F.col("_judged.score")).otherwise(0.0).alias("score"),
    )
