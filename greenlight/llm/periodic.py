"""Maximal periodic runs of words, found through string synchronising sets.

A run is a stretch of at least three periods that no neighbouring word extends. For a scale tau, a power of
two, the synchronising set holds the places i at which the least hash of the tau-word windows i .. i+tau stands
at one of the two ends; windows of period tau/3 or less don't count. Whether a place belongs to the set follows
from the 2*tau words after it, so equal contexts are chosen together, and only highly periodic stretches hold
none. A run of a period q with 2*tau <= q < 4*tau therefore has a chosen place i such that i+q is chosen with
the same context. Pairs of chosen places with equal contexts propose periods, at most eleven a place, and each
proposal is extended word by word to the whole run. Periods under ``SMALL`` are too short for a scale: their
runs are read off directly, and with the runs of earlier scales they say which windows are highly periodic.

All documents of a slice are laid one after the other, each followed by a mark of its own that no run can hold,
and only those long enough go on to the next scale. So the work is about n log n for n words and no group is
ever formed across documents: nothing is shuffled.

Defined results
- null text is empty: no words, no runs, an empty collapsed text.
- A very long text is one slice of its own, read whole; its arrays take about 150 bytes a word.
- Of the periods of a stretch only the smallest counts. Runs of different periods may overlap; all are returned.
- Repeated rows and ids are judged row by row. An empty table gives no rows; other columns are not read.
- Words are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import hash_spans, mix, slices, word_bounds

SMALL = 8
CELLS = 1 << 20
SLICE = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of all runs of True."""
    edge = np.diff(np.concatenate([[False], same, [False]]).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of runs (start, end, period) with equal ends, that of the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def _extend(line: np.ndarray, at: np.ndarray, period: np.ndarray, block: int, step: int, most: int | None = None) -> np.ndarray:
    """How many words from ``at`` on, going by ``step`` (1 or -1), equal the word a period later; ``most`` at most."""
    length = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    offsets = np.arange(block) * step
    while len(active):
        going = []
        for part in np.array_split(active, -(-len(active) * block // CELLS)):
            places = (at[part] + length[part] * step)[:, None] + offsets
            inside = (places >= 0) & (places + period[part][:, None] < len(line))
            places = np.where(inside, places, 0)
            same = inside & (line[places] == line[np.where(inside, places + period[part][:, None], 0)])
            count = np.where(same.all(axis=1), block, same.argmin(axis=1))
            length[part] += count
            going.append(part[count == block])
        active = np.concatenate(going)
        if most is not None:
            active = active[length[active] < most]
    return length


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by windows of doubling width."""
    have = 1
    while have < width:
        move = min(have, width - have)
        values = np.minimum(values[: len(values) - move], values[move:])
        have += move
    return values


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring windows from theirs; not linear, so that no text is hard for it."""
    return mix(left + mix(right ^ np.uint64(0xA0761D6478BD642F)))


def _chosen(windows: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale from the hashes of its windows and the mark of periodic ones."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(periodic, top, windows)
    least = _window_min(value, tau + 1)
    return np.flatnonzero((least != top) & ((least == value[: len(least)]) | (least == value[tau:])))


def _proposals(places: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of chosen places with equal contexts that are 2*tau to 4*tau words apart."""
    order = np.argsort(context, kind="stable")
    places, context = places[order], context[order]
    left = np.arange(len(places))
    at, period = [], []
    ahead = 1
    while len(left):
        left = left[left + ahead < len(places)]
        apart = places[left + ahead] - places[left]
        near = (context[left + ahead] == context[left]) & (apart < 4 * tau)
        left, apart = left[near], apart[near]
        far = apart >= 2 * tau
        at.append(places[left[far]])
        period.append(apart[far])
        ahead += 1
    return np.concatenate(at or [places[:0]]), np.concatenate(period or [places[:0]])


def _whole(line: np.ndarray, at: np.ndarray, period: np.ndarray, tau: int) -> np.ndarray:
    """The runs (start, end, period) of three periods or more around proposals."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    block = min(max(tau, 16), 1024)
    stop = at + _extend(line, at, period, block, 1, 6 * tau)
    apart = period * (2 * len(line))  # sets the periods apart, so that one pass joins the stretches of each
    reach = np.maximum.accumulate(stop + apart)
    first = np.flatnonzero(np.concatenate([[True], at[1:] + apart[1:] > reach[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    period, start, stop = period[first], at[first], reach[last] - apart[first]
    stop = stop + _extend(line, stop, period, block, 1)
    start = start - _extend(line, start - 1, period, block, -1)
    found = np.unique(np.stack([start, stop + period, period], axis=1), axis=0)
    return found[found[:, 1] - found[:, 0] >= 3 * found[:, 2]]


def _laid(words: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of these documents, each with a mark of its own after it, and where each begins."""
    count = np.diff(rows)[docs]
    begins = np.cumsum(count + 1) - count - 1
    line = np.empty(int((count + 1).sum()), np.uint64)
    marks = np.zeros(len(line), bool)
    marks[begins + count] = True
    line[marks] = mix(np.arange(len(docs), dtype=np.uint64) + np.uint64(0x51ED270B35C1A2F7))
    line[~marks] = words[np.arange(int(count.sum())) + np.repeat(rows[docs] - begins + np.arange(len(docs)), count)]
    return line, begins


def _short_periods(line: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of periods under ``SMALL``."""
    found = [np.zeros((0, 3), np.int64)]
    for period in range(1, SMALL):
        start, stop = _stretches(line[:-period] == line[period:])
        long = stop - start >= 2 * period
        found.append(np.stack([start[long], stop[long] + period, np.full(int(long.sum()), period)], axis=1))
    return _smallest(np.concatenate(found))


def _scale(line: np.ndarray, windows: np.ndarray, found: np.ndarray, tau: int) -> np.ndarray:
    """Runs of periods from 2*tau to 4*tau, given the hashes of all tau-word windows and the runs of lower scales."""
    dense = found[(found[:, 2] <= tau // 3) & (found[:, 1] - found[:, 0] >= tau)]
    edge = np.bincount(dense[:, 0], minlength=len(line) + 1) - np.bincount(dense[:, 1] - tau + 1, minlength=len(line) + 1)
    places = _chosen(windows, tau, np.cumsum(edge)[: len(windows)] > 0)
    at, period = _proposals(places, _joined(windows[places], windows[places + tau]), tau)
    return _whole(line, at, period, tau) if len(at) else found[:0]


def runs(words: np.ndarray, rows: np.ndarray, least: int = 24) -> np.ndarray:
    """All maximal runs of at least three periods and ``least`` words as rows (row, start, length, period),
    in order of row, start and period. ``rows`` has the first word of each row and, last, the count of all."""
    if least < 3 * SMALL:
        raise ValueError(f"least must be {3 * SMALL} or more")
    count = np.diff(rows)
    docs = np.flatnonzero(count >= least)
    done = [np.zeros((0, 4), np.int64)]
    if len(docs):
        line, begins = _laid(words, rows, docs)
        found = _short_periods(line)
        windows, tau = line, SMALL // 2
        for width in (2**k for k in range(tau.bit_length() - 1)):
            windows = _joined(windows[:-width], windows[width:])
    while len(docs):
        if len(line) > 2 * tau:
            found = _smallest(np.concatenate([found, _scale(line, windows, found, tau)]))
            windows = _joined(windows[:-tau], windows[tau:])
        tau *= 2
        stay = count[docs] >= 6 * tau  # room for three periods of this scale
        owner = np.searchsorted(begins, found[:, 0], side="right") - 1
        out = ~stay[owner]
        rest, place = found[out], found[out, 0] - begins[owner[out]]
        done.append(np.stack([docs[owner[out]], place, rest[:, 1] - rest[:, 0], rest[:, 2]], axis=1))
        found = found[~out]
        if not stay.all():
            kept = np.repeat(stay, count[docs] + 1)
            found[:, :2] -= np.concatenate([[0], np.cumsum(~kept)])[found[:, :1]]
            line, windows, docs = line[kept], windows[kept[: len(windows)]], docs[stay]
            begins = np.cumsum(count[docs] + 1) - count[docs] - 1
        windows = windows[: max(0, len(line) - tau + 1)]
    done = np.concatenate(done)
    done = done[done[:, 2] >= least]
    return done[np.lexsort((done[:, 3], done[:, 1], done[:, 0]))]


def _reader(least: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), SLICE):
                starts, ends, rows = word_bounds(data, offsets)
                found = runs(hash_spans(data, starts, ends), rows, least)
                raw = data.tobytes()
                texts = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                bounds = np.searchsorted(found[:, 0], np.arange(len(rows)))
                for k in np.unique(found[:, 0]).tolist():
                    edge = np.zeros(rows[k + 1] - rows[k] + 1, np.int64)
                    mine = found[bounds[k] : bounds[k + 1]]
                    np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
                    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    split = texts[k].split(b" ")
                    texts[k] = b" ".join([split[i] for i in kept.tolist()])
                spans = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, len(texts)), pa.array(np.diff(rows)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), pa.array(texts, pa.binary()).cast(pa.string()),
                ], schema=schema)

    return read


def collapse(docs: DataFrame, least: int = 24) -> DataFrame:
    """A row for each document: its number of words, its runs (first word, words, period) by start and period, and
    its words joined by single spaces without those that a run repeats, that is, all but its first period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_reader(least), RUNS)
