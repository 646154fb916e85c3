"""A bigram language model in a log-frequency Bloom filter.

Counting: tasks count the words and word pairs of their training texts and deal them out by the upper bits of
their hash; each share is merged into exact counts of words and one stretch of the filter. For a count c the
filter holds the n-gram with each level from 1 to ``bit_length(c)``, so probing level after level until a miss
gives back the count up to a factor of two. A level sets two bits in the one 512-bit block of its n-gram.

Scoring: p(w | v) = L * min(1, c(v w) / c(v)) + (1 - L) * min(1, (c(w) + 1) / (N + V + 1)) with all counts from the
filter; N and V are exact. The base score needs the exact count of every word: the most frequent words, at most
``head_words`` of them, are broadcast, and all others are looked up by a join.

The filter has a bit or two for every second byte of training text at every size; a level with a share f of its bits
set hits by chance with f * f. A filter of at most ``max_bytes`` is broadcast. A larger one stays a table of shares:
the distinct n-grams of each slice of documents are sent to the shares that hold them, probed there, and what comes
back meets its slice, so no task holds more than a share or a slice. Both ways give the same scores.

Defined results
- Null text is empty and has the end as its only token. Words are runs of bytes other than ASCII white space,
  A-Z lower-cased; the end counts as a token of the vocabulary once it is trained.
- Without training rows N and V are 0 and all counts too.
- Rows are scored one by one, repeated or not; extra columns don't matter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import hashed_words, mix, slices
from greenlight.session import cut_lineage

MAX_BYTES = 64 << 20
HEAD_WORDS = 1 << 19
SHARE_BYTES = 16 << 20
BLOCK_BITS = 512
LEVELS = 40
WEIGHT = 0.6
HOLD = 3_000_000

END = np.uint64(0x5BD1E995A3C59AC3)
BEGIN = np.uint64(0xC2B2AE3D27D4EB4F)
PAIR = np.uint64(0x9FB21C651E98DF25)
STEP = 0xA24BAED4963EE407

DEALT = "share long, kind int, keys binary, counts binary"
SHARE = "share long, bits binary, words array<long>, counts array<long>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and where each row starts (one more at the end)."""
    hashes, rows = hashed_words(data, offsets)
    return np.insert(hashes, rows[1:], END), rows + np.arange(len(rows))


def pairs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it in its row."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts[:-1]] = BEGIN
    return mix(before * PAIR + words)


def count_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def at_level(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64(level * STEP % (1 << 64)))


def level_bits(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits, within the block, of each key at a level."""
    h = at_level(keys, level)
    return h & np.uint64(BLOCK_BITS - 1), (h >> np.uint64(32)) & np.uint64(BLOCK_BITS - 1)


def block_of(keys: np.ndarray, block_power: int) -> np.ndarray:
    return keys >> np.uint64(64 - block_power) if block_power else np.zeros(len(keys), np.uint64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels > 0, np.ldexp(1.5, levels.astype(np.int64) - 1) - 0.5, 0.0)


@dataclass
class Filter:
    """Blocks of eight 64-bit words; the upper ``block_power`` bits of a hash give its block."""

    words: np.ndarray = field(repr=False)
    block_power: int = 0

    def add(self, places: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> None:
        """Set the levels of each key in the block that the upper bits of its place give."""
        levels = np.frexp(counts.astype(np.float64))[1]
        base = block_of(places, self.block_power) * np.uint64(8)
        for level in range(1, min(LEVELS, int(levels.max(initial=0))) + 1):
            own = levels >= level
            for bit in level_bits(keys[own], level):
                np.bitwise_or.at(self.words, (base[own] + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))

    def count(self, keys: np.ndarray) -> np.ndarray:
        """About the count of each key: the middle of the counts of its highest level."""
        return middle(self.levels(keys, keys))

    def levels(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key, in the block that the upper bits of its place give."""
        levels = np.zeros(len(keys), np.uint8)
        base = block_of(places, self.block_power) * np.uint64(8)
        left = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            h = at_level(keys[left], level)
            for shift in (0, 32):
                bit = (h >> np.uint64(shift)) & np.uint64(BLOCK_BITS - 1)
                word = self.words[(base[left] + (bit >> np.uint64(6))).astype(np.int64)]
                hit = ((word >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                left, h = left[hit], h[hit]
            levels[left] = level
            if not len(left):
                break
        return levels


class Head:
    """Exact counts of the most frequent words: a table with one place for each of the upper bits of a hash. A word
    whose place a more frequent one has taken isn't in it, and is left to the join."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.power = max(4, int(4 * len(words)).bit_length())
        order = np.argsort(counts, kind="stable")
        at = (words[order] >> np.uint64(64 - self.power)).astype(np.int64)
        self.words = np.zeros(1 << self.power, np.uint64)
        self.counts = np.zeros(1 << self.power, np.int64)
        self.words[at] = words[order]
        self.counts[at] = counts[order]

    def find(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, 0 for one that isn't in the table."""
        at = (words >> np.uint64(64 - self.power)).astype(np.int64)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _dealer(power: int):
    """Counts of words (kind 0) and pairs (kind 1) of a task's texts, cut by the upper bits of the hash."""

    def deal(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def settle(kind):
            keys, counts = count_up(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))
            held[kind] = [(keys, counts)]
            return len(keys)

        def flush(kind):
            keys, counts = held[kind][0]
            held[kind] = []
            share = (keys >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)
            at = np.flatnonzero(np.diff(share, prepend=-1))
            ends = np.append(at[1:], len(keys))
            wide = np.minimum(counts, (1 << 63) - 1).astype("<i8")
            for a in range(0, len(at), 64):
                parts = list(zip(at[a : a + 64].tolist(), ends[a : a + 64].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(share[at[a : a + 64]]), pa.array([kind] * len(parts), pa.int32()),
                    pa.array([keys[i:j].tobytes() for i, j in parts], pa.binary()), pa.array([wide[i:j].tobytes() for i, j in parts], pa.binary()),
                ], ["share", "kind", "keys", "counts"])

        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                words, starts = tokens(data, offsets)
                for kind, keys in enumerate((words, pairs(words, starts))):
                    held[kind].append(count_up(keys, np.ones(len(keys), np.int64)))
                    if sum(len(k) for k, _ in held[kind]) > HOLD and settle(kind) > HOLD // 2:
                        yield from flush(kind)
        for kind in (0, 1):
            if held[kind]:
                settle(kind)
                yield from flush(kind)

    return deal


def _merger(power: int, block_power: int):
    """Exact counts of one share, as its words and its stretch of the filter."""

    def merge(table: pa.Table) -> pa.Table:
        share = table.column("share")[0].as_py()
        kinds = np.array(table.column("kind").to_pylist())
        bits = np.zeros(8 << (block_power - power), np.uint64)
        own = Filter(bits, block_power - power)
        found = {}
        for kind in (0, 1):
            rows = table.filter(pa.array(kinds == kind))
            raw = [np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.int64))]
            keys, counts = count_up(*raw)
            own.add(keys << np.uint64(power), counts, keys)
            found[kind] = keys, counts
        keys, counts = found[0]
        return pa.table({"share": [share], "bits": pa.array([bits.tobytes()], pa.binary()), "words": pa.array([keys.view(np.int64)]), "counts": pa.array([counts])},
                        schema=pa.schema([("share", pa.int64()), ("bits", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))

    return merge


@dataclass
class Model:
    filter: Filter | None
    head: Head
    documents: int
    total: int  # N
    distinct: int  # V
    weight: float
    shares: DataFrame | None = field(default=None, repr=False)  # of a filter that isn't broadcast
    power: int = 0
    block_power: int = 0

    def __getstate__(self):
        return self.__dict__ | {"shares": None}

    def text_scores(self, data: np.ndarray, offsets: np.ndarray, count=None) -> dict[str, np.ndarray]:
        """For each text its tokens, the model's log10 probability, what the head knows of the base score, and the
        words, with their times, that the head doesn't know. ``count`` gives the filter's counts of keys."""
        count = count or self.filter.count
        words, starts = tokens(data, offsets)
        linked = pairs(words, starts)
        distinct, inverse = np.unique(words, return_inverse=True)
        about = count(distinct)[inverse]
        before = np.empty(len(words))
        before[1:] = about[:-1]
        before[starts[:-1]] = self.documents
        together = count(linked)
        share = np.minimum(1.0, together / np.maximum(before, 1.0))
        chance = self.weight * share + (1.0 - self.weight) * np.minimum(1.0, (about + 1.0) / (self.total + self.distinct + 1.0))
        exact = self.head.find(distinct)
        known = exact[inverse] > 0
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        rest = np.flatnonzero(~known)
        keyed = np.stack([row[rest].astype(np.uint64), words[rest]])
        order = np.lexsort((keyed[1], keyed[0]))
        keyed = keyed[:, order]
        new = np.ones(keyed.shape[1], bool)
        new[1:] = (keyed[:, 1:] != keyed[:, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        per_row = np.bincount(keyed[0, at].astype(np.int64), minlength=len(starts) - 1)
        return {
            "n_tokens": np.diff(starts),
            "score": np.add.reduceat(np.log10(chance), starts[:-1]),
            "head_known": np.add.reduceat(known.astype(np.int64), starts[:-1]),
            "head_sum": np.add.reduceat(np.log10(exact + 1.0)[inverse], starts[:-1]),
            "rest_words": keyed[1, at].view(np.int64),
            "rest_times": np.diff(np.append(at, keyed.shape[1])),
            "rest_ends": np.concatenate([[0], np.cumsum(per_row)]),
        }


def learn(docs: DataFrame, max_bytes: int = MAX_BYTES, head_words: int = HEAD_WORDS, weight: float = WEIGHT, share_bytes: int = SHARE_BYTES) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs``, and the table (word, count) of all its words. A filter of more than ``max_bytes``
    isn't broadcast."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    block_power = (size["b"] // 2 // BLOCK_BITS).bit_length()
    power = min(block_power, (size["b"] // share_bytes).bit_length())
    shares = texts.mapInArrow(_dealer(power), DEALT).groupBy("share").applyInArrow(_merger(power, block_power), SHARE)
    shares = cut_lineage(shares)
    whole = None
    if BLOCK_BITS // 8 << block_power <= max_bytes:
        bits = np.zeros(8 << block_power, np.uint64)
        stretch = 8 << (block_power - power)
        for row in shares.select("share", "bits").toLocalIterator():
            bits[row["share"] * stretch : (row["share"] + 1) * stretch] = np.frombuffer(row["bits"], np.uint64)
        whole = Filter(bits, block_power)
    words = shares.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    by_size = words.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("count").alias("c")).collect()
    least, room = 64, head_words
    for k, n in sorted(((r["k"], r["n"]) for r in by_size), reverse=True):
        room -= n
        if room < 0:
            break
        least = k
    head = words.where(F.col("count") >= F.lit(2.0**least)).toArrow()
    table = Head(head["word"].to_numpy().view(np.uint64), head["count"].to_numpy())
    total, distinct = sum(r["c"] for r in by_size), sum(r["n"] for r in by_size)
    return Model(whole, table, size["n"], total, distinct, weight, shares.select("share", "bits"), power, block_power), words


SCORED = "n_tokens long, score double, head_known long, head_sum double, rest_words array<long>, rest_times array<long>"


def _scored(part: pa.RecordBatch, names: list[str], x: dict[str, np.ndarray]) -> pa.RecordBatch:
    rest = pa.array(x["rest_ends"].astype(np.int32), pa.int32())
    return pa.RecordBatch.from_arrays(
        [*(part.column(n) for n in names), pa.array(x["n_tokens"]), pa.array(x["score"]), pa.array(x["head_known"]), pa.array(x["head_sum"]),
         pa.ListArray.from_arrays(rest, pa.array(x["rest_words"])), pa.ListArray.from_arrays(rest, pa.array(x["rest_times"]))],
        [*names, "n_tokens", "score", "head_known", "head_sum", "rest_words", "rest_times"],
    )


def _scorer(shared, names: list[str]):
    def score(batches):
        model = shared.value
        for batch in batches:
            for first, data, offsets in slices(batch.column("_text")):
                yield _scored(batch.slice(first, len(offsets) - 1), names, model.text_scores(data, offsets))

    return score


# -- a filter in shares --------------------------------------------------------


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The distinct words and pairs of some texts, in order."""
    words, starts = tokens(data, offsets)
    return np.unique(np.concatenate([words, pairs(words, starts)]))


def _asker(power: int):
    """Each slice of documents as a row of its own, with no share, and its distinct keys, cut by the upper bits."""

    def ask(batches):
        for batch in batches:
            for first, data, offsets in slices(batch.column("_text")):
                keys = _keys(data, offsets)
                share = (keys >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)
                at = np.flatnonzero(np.diff(share, prepend=-1))
                sink = pa.BufferOutputStream()
                part = batch.slice(first, len(offsets) - 1)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                blobs = [sink.getvalue().to_pybytes(), *(keys[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(keys))))]
                name = uuid.uuid4().hex
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blobs)), pa.array([None, *share[at].tolist()], pa.int64()), pa.array(blobs, pa.binary())], ["slice", "share", "data"])

    return ask


def _prober(power: int, block_power: int):
    """The levels of all keys that are asked of one share."""

    def probe(asked: pa.Table, share: pa.Table) -> pa.Table:
        bits = np.frombuffer(share.column("bits")[0].as_py(), np.uint64) if len(share) else np.zeros(8 << (block_power - power), np.uint64)
        own = Filter(bits, block_power - power)
        keys = [np.frombuffer(x, np.uint64) for x in asked.column("data").to_pylist()]
        return pa.table({"slice": asked.column("slice"), "share": asked.column("share"), "data": pa.array([own.levels(k << np.uint64(power), k).tobytes() for k in keys], pa.binary())})

    return probe


def _slice_scorer(shared, names: list[str]):
    def score(table: pa.Table) -> pa.Table:
        shares, blobs = table.column("share").to_pylist(), table.column("data").to_pylist()
        order = sorted((k, i) for i, k in enumerate(shares) if k is not None)
        levels = np.frombuffer(b"".join(blobs[i] for _, i in order), np.uint8)
        part = pa.ipc.open_stream(blobs[shares.index(None)]).read_next_batch()
        _, data, offsets = next(slices(part.column("_text"), 1 << 62))
        keys, counts = _keys(data, offsets), middle(levels)
        return pa.Table.from_batches([_scored(part, names, shared.value.text_scores(data, offsets, lambda x: counts[np.searchsorted(keys, x)]))])

    return score


def _score_by_shares(rows: DataFrame, model: Model, shared, keep: list[str], schema: str) -> DataFrame:
    # the slices' names are made once and kept
    asked = cut_lineage(rows.mapInArrow(_asker(model.power), "slice string, share long, data binary"))
    keys = asked.where("share is not null")
    levels = keys.groupBy("share").cogroup(model.shares.groupBy("share")).applyInArrow(_prober(model.power, model.block_power), keys.schema)
    return asked.where("share is null").unionByName(levels).groupBy("slice").applyInArrow(_slice_scorer(shared, keep), schema)


def score(docs: DataFrame, model: Model, words: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs with n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), SCORED])
    rows = rows.mapInArrow(_scorer(shared, list(keep)), schema) if model.filter else _score_by_shares(rows, model, shared, list(keep), schema)
    rows = cut_lineage(rows).withColumn("_row", F.monotonically_increasing_id())
    rest = rows.select("_row", F.explode(F.arrays_zip("rest_words", "rest_times")).alias("x"))
    rest = rest.select("_row", F.col("x.rest_words").alias("word"), F.col("x.rest_times").alias("times"))
    found = (
        rest.join(words, "word").groupBy("_row")
        .agg(F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("rest_sum"))
    )
    size = float(np.log10(model.total + model.distinct + 1.0))
    return rows.join(found, "_row", "left").select(
        *keep, "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), "score",
    )
