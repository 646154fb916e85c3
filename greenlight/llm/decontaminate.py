"""Benchmark decontamination by templates.

Texts are read as tokens, runs of letters or of digits; of scripts written without spaces every character is one. A template replaces numbers by one placeholder, units
after a number by another, and capitalised words, which may be names, by a third; a second, lower-case template
keeps the words and replaces numbers and units only. Windows of templates are hashed, the documents' windows
pass a bit table of the benchmark's, and what passes meets the benchmark in an exact hash join. Windows that
meet along one diagonal of a document and an item count as they are if their slots hold what the item's do; others
must agree on the slots: what stood in the benchmark in a slot is always replaced by the same thing, and windows with
a slot that is replaced in two ways don't count. An item leaks if windows that count cover ``cover`` of its own, or if
``run`` of its tokens stand in the document one after the other, whatever share of the item they are.

A window counts if at least ``literals`` of its tokens are words. Windows with several numbers are also hashed as they
stand, values included; they count for items of a window or more that have no other windows. An item shorter than a
window is one window of its own length; a short one with fewer than three words in it can't be looked for
(``without_windows`` names these).

Defined results
- Null texts are empty. Upper, lower and mixed case, punctuation and white space don't matter.
- Rows of documents that share id and text count as one; items that share an id are merged.
- Extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import hash_spans, latin_capital, lower_latin, mix, rolling, slices

WINDOW = 8
LITERALS = 4
COVER = 0.4
RUN = 13
MOST_BYTES = 32 << 20
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x5A17F00D00000001, 0x5A17F00D00000002, 0x5A17F00D00000003))

#: Units that may follow a number (fixed values).
UNITS = (
    "mm cm m km kg g mg t l ml in ft yd mi lb lbs oz s min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw kwh v kv a ma k c f pa kpa j kj cal kcal "
    "percent inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents degree degrees"
).split()

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit
_KIND[128:] = 1
_KIND[list(range(97, 123)) + list(range(65, 91))] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
LOWER, CASED, VERBATIM = 0, 1, 2  # kinds of windows
_JOINS = np.zeros(256, bool)
_JOINS[list(b".,:/")] = True


def _hashed(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return hash_spans(data, np.array([0]), np.array([len(data)]))[0]


UNIT_HASHES = np.sort(np.array([_hashed(w) for w in UNITS], np.uint64))


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the characters of scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han), and the
    starts of their punctuation and of full-width signs, all of three bytes."""
    at = np.flatnonzero(data >= 0xE0)
    lead, second, third = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) if len(data) else at for k in range(3))
    code = (lead - 0xE0 << 12) + (second - 0x80 << 6) + third - 0x80
    code[lead >= 0xF0] = 0
    inside = lambda *ranges: np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges])
    mark = inside((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
    rare = (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)  # Han beyond U+20000, of four bytes
    own = rare | inside((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D)) & ~mark
    return at[own], at[own] + 3 + rare[own], at[mark]


class Tokens:
    """Tokens of some texts: what a slot holds or a word is (``value``), both templates, and the first token of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        alone, behind, marks = unspaced(data)
        for k in range(3):
            kind[marks + k] = 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        turn = np.ones(len(data) + 1, bool)
        turn[1:-1] = kind[1:] != kind[:-1]
        turn |= edge
        turn[alone] = turn[behind] = True
        starts = np.flatnonzero((kind > 0) & turn[:-1])
        ends = np.flatnonzero((kind > 0) & turn[1:]) + 1
        number = kind[starts] == 2
        # 3.5, 1,000 or 12:30 is one number
        if len(starts) > 1:
            glued = number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1)
            glued[glued] = _JOINS[data[ends[:-1][glued]]] & ~edge[starts[1:][glued]] & ~edge[ends[:-1][glued]]
            first, last = np.append(True, ~glued), np.append(~glued, True)
            starts, ends, number = starts[first], ends[last], number[first]
        capitals = _UPPER[data]
        if len(data) > 1:
            capitals[1:] |= latin_capital(data)
        counted = np.concatenate([[0], np.cumsum(capitals)])
        wide = data[starts] == 0xC3
        leading = _UPPER[data[starts]] | (wide & capitals[np.minimum(starts + 1, len(data) - 1)]) if len(starts) else np.zeros(0, bool)
        name = leading & (counted[ends] - counted[starts] == 1) & (ends - starts > 1 + wide)
        self.value = hash_spans(lower_latin(data), starts, ends)
        self.rows = np.searchsorted(starts, offsets)
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1]
        after[self.rows[:-1][self.rows[:-1] < len(starts)]] = False
        unit = after.copy()
        unit[after] = np.isin(self.value[after], UNIT_HASHES)
        self.lower = np.where(number, NUMBER, np.where(unit, UNIT, self.value))
        self.cased = np.where(name & ~unit, NAME, self.lower)
        self.slot = {LOWER: number | unit, CASED: number | unit | name, VERBATIM: np.zeros(len(number), bool)}
        self.number = number

    def windows(self, kind: int, length: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first token and row of each window within a row. Of the cased template only windows with a name. Verbatim
        windows have so many numbers that the units after them, or one before, may leave too few words."""
        template = (self.lower, self.cased, self.value)[kind]
        joined = rolling(template, length)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        slots = np.concatenate([[0], np.cumsum(self.number if kind == VERBATIM else self.slot[kind])])
        at = np.arange(len(joined))
        filled = (slots[length:] - slots[:-length])[: len(joined)] if len(joined) else at
        enough = 2 * filled >= length - literals if kind == VERBATIM else length - filled >= literals
        use = (row[at] == row[at + length - 1]) & enough if len(joined) else np.zeros(0, bool)
        if kind == CASED:
            names = np.concatenate([[0], np.cumsum(self.cased != self.lower)])
            use &= (names[length:] > names[:-length])[: len(joined)] if len(joined) else use
        at = at[use]
        return mix(joined[use] ^ np.uint64(4 * length + kind)), at, row[at]

    def slots(self, kind: int, at: np.ndarray, length: int) -> list[np.ndarray]:
        """What stands in the slots of each window; 0 for words."""
        index = at[:, None] + np.arange(length)
        return np.where(self.slot[kind][index], self.value[index], np.uint64(0)).view(np.int64) if len(at) else np.zeros((0, length), np.int64)


def _rows(tokens: Tokens, ids: list[pa.Array], names: list[str], kind: int, length: int, hashes, at, row) -> pa.RecordBatch:
    values = tokens.slots(kind, at, length)
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * length)
    return pa.RecordBatch.from_arrays(
        [*(x.take(pa.array(row)) for x in ids), pa.array(np.full(len(at), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array((at - tokens.rows[row]).astype(np.int64)),
         pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
        [*names, "kind", "hash", "at", "slots"],
    )


def _item_windows(length: int, literals: int):
    def cut(batches):
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                tokens = Tokens(data, offsets)
                ids = [batch.column("item_id").slice(first, len(offsets) - 1)]
                counts = np.diff(tokens.rows)
                for n in sorted(set(np.minimum(counts, length).tolist()) - {0}):
                    for kind in (LOWER, CASED, VERBATIM)[: 3 if n == length else 2]:
                        hashes, at, row = tokens.windows(kind, n, literals if n == length else 3)
                        own = np.minimum(counts, length)[row] == n
                        out = _rows(tokens, ids, ["item_id"], kind, n, hashes[own], at[own], row[own])
                        yield out.append_column("length", pa.array(np.full(out.num_rows, n, np.int64)))

    return cut


def _document_windows(literals: int, window: int, lengths: list[int], shared):
    def find(batches):
        bits = shared.value
        power = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                tokens = Tokens(data, offsets)
                ids = [batch.column(c).slice(first, len(offsets) - 1) for c in ("doc_id", "text_key")]
                for n in lengths:
                    for kind in (LOWER, CASED, VERBATIM)[: 3 if n == window else 2]:
                        hashes, at, row = tokens.windows(kind, n, literals if n == window else 3)
                        place = (hashes >> power).astype(np.int64)
                        hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                        if hit.any():
                            yield _rows(tokens, ids, ["doc_id", "text_key"], kind, n, hashes[hit], at[hit], row[hit])

    return find


def bit_table(hashes: DataFrame, most_bytes: int) -> np.ndarray:
    """A table with a bit set for each hash: 1,024 bits a hash at first, ``most_bytes`` at most, which is what reaches the
    driver and the workers."""
    count = hashes.count()
    power = min(max(10, (count * 1024).bit_length()), (most_bytes * 8).bit_length() - 1)
    rows = hashes.select(F.shiftrightunsigned("hash", 64 - power).alias("place"))
    rows = rows.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    out = np.zeros(1 << (power - 6), np.int64)
    for row in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def own_windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shape = "item_id long, kind int, hash long, at long, slots array<long>, length long"
    return items.mapInArrow(_item_windows(window, literals), shape).dropDuplicates(["item_id", "kind", "hash", "at"])


def without_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """The item_id of the items that can't be looked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id")).distinct()
    found = own_windows(benchmark, window, literals).select(F.col("item_id").alias("_item")).distinct()
    return items.join(found, F.col("item_id").eqNullSafe(F.col("_item")), "left_anti")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, cover: float = COVER, run: int = RUN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, the item's windows and how many of them the document holds, for each
    document and item of which it holds ``cover`` or more, or ``run`` tokens in a row."""
    from greenlight.session import cut_lineage

    spark = docs.sparkSession
    own = cut_lineage(own_windows(benchmark, window, literals))
    # an item's windows are those of the lower-case template, and if it has none, the verbatim ones
    by_kind = [F.countDistinct(F.when(F.col("kind") == k, F.col("at"))) for k in (LOWER, VERBATIM)]
    whole = own.groupBy("item_id").agg(*(x.alias(n) for x, n in zip(by_kind, ("worded", "numeric"))))
    whole = whole.select("item_id", (F.col("worded") == 0).alias("verbatim"), F.when(F.col("worded") > 0, F.col("worded")).otherwise(F.col("numeric")).alias("windows"))
    lengths = sorted(r["length"] for r in own.select("length").distinct().collect())  # at most ``window`` of them
    shared = spark.sparkContext.broadcast(bit_table(own.select("hash"), most_bytes))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = rows.mapInArrow(_document_windows(literals, window, lengths, shared), "doc_id long, text_key long, kind int, hash long, at long, slots array<long>")
    counts = F.col("verbatim") == (F.col("kind") == VERBATIM)  # others only make runs
    theirs = own.join(whole.select("item_id", "verbatim"), "item_id").select("item_id", "length", counts.alias("counts"), "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = found.join(theirs, "hash").withColumn("diagonal", F.col("at") - F.col("item_at"))
    filled = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0)
    diagonal = met.groupBy("doc_id", "text_key", "item_id", "diagonal").agg(F.max("length").alias("length"), F.collect_set(F.struct("item_at", "counts", filled.alias("filled"))).alias("met"))  # an item's length bounds it
    pairs = F.array_distinct(F.flatten(F.transform("met", lambda x: x["filled"])))
    diagonal = diagonal.withColumn("values", F.transform(pairs, lambda x: x["item_slots"]))
    # a value that stands in two pairs is replaced in two ways
    diagonal = diagonal.withColumn("torn", F.filter("values", lambda x, k: F.array_position("values", x) != k + 1))
    exact = lambda x: F.forall(x["filled"], lambda y: y["item_slots"] == y["slots"])
    agrees = lambda x: ~F.arrays_overlap(F.transform(x["filled"], lambda y: y["item_slots"]), F.col("torn"))
    places = F.transform(F.filter("met", lambda x: x["counts"] & (exact(x) | agrees(x))), lambda x: x["item_at"])
    copied = F.array_sort(F.array_distinct(F.transform(F.filter("met", exact), lambda x: x["item_at"])))
    diagonal = diagonal.select("doc_id", "text_key", "item_id", "length", places.alias("places"), copied.alias("copied"))
    # a run is so many exact windows of which each begins one token after the one before
    more = F.greatest(F.lit(run) - F.col("length"), F.lit(0)).cast("int")
    ahead = F.transform("copied", lambda x, k: F.get("copied", k + more) - x == more)
    diagonal = diagonal.select("doc_id", "text_key", "item_id", "places", "copied", ((F.col("length") == window) & F.coalesce(F.exists(ahead, lambda x: x), F.lit(False))).alias("run"))
    covered = diagonal.where((F.size("places") > 0) | F.col("run")).groupBy("doc_id", "text_key", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("run"), F.array_union("places", "copied")).otherwise(F.col("places")))))).alias("matched"), F.max("run").alias("run")
    )
    return (
        covered.join(whole, "item_id").where(F.col("run") | (F.col("matched") >= F.greatest(F.lit(1.0), cover * F.col("windows"))))
        .select("doc_id", "text_key", "item_id", F.col("windows").cast("long").alias("windows"), F.least("matched", "windows").cast("long").alias("matched"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all their columns."""
    found = leaks(docs, benchmark, **parameters).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_key")), "left_anti")
