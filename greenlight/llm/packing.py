"""Cost-balanced packing of token sequences.

Documents become token ids, and the ids are laid into sequences of a fixed capacity. A piece of n ids
costs ``linear * n + quadratic * n * n``, since attention stays within a piece; pieces go in descending
size to the sequence of lowest cost that has room, and are cut where the room ends. Every partition packs
its own rows in bounded rounds while it reads them, so nothing is shuffled and no key can be hot.

Defined results
- null text is empty; every document ends with ``end_id``, so an empty one has that id alone.
- A document longer than a round is cut into pieces like any other.
- Repeated rows and repeated ids are packed row by row. An empty table gives no rows.
- All sequences of a partition are full but for the last round, whose remainder is laid into sequences
  of powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import LOWER, hash_spans, slices, word_bounds

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cost double"
)
CACHE_WORDS = 1_000_000
ROUND_TOKENS = 1 << 20

#: What the tokenizer's own split does with words of these letters, digits and signs (fixed values).
PLAIN_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[!-/:-@\[-`{-~]+"
PLAIN_WORD = r"[A-Za-zß-öø-ÿœÀ-ÖØ-Þ0-9!-/:-@\[-`{-~]+"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across white space.

    Each distinct word is encoded once and kept, by hash, up to ``CACHE_WORDS`` words; words of plain Latin
    letters and ASCII are looked up by their parts, all others are encoded as they are.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part = regex.compile(PLAIN_PARTS)
        self.plain = regex.compile(PLAIN_WORD)
        self.parts: dict[str, list[int]] = {}
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        split, missing, whole = [], {}, []
        for word in words:
            if "<|" not in word and self.plain.fullmatch(word):
                found = self.part.findall(word.lower())
                for x in found:
                    if x not in self.parts:
                        missing[x] = None
                split.append(found)
            else:
                split.append(None)
                whole.append(word)
        new = list(missing)
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.parts[x] = e.ids
        others = iter([e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        out = [next(others) if x is None else [i for p in x for i in self.parts[p]] for x in split]
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        return out

    def _learn(self, keys: np.ndarray, words: list[str]):
        encoded = self._encode(words)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for x in encoded for i in x), np.uint32, int(lengths.sum()))
        keys = np.concatenate([self.keys, keys])
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        lengths = np.concatenate([self.lengths, lengths])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.lengths = keys[order], starts[order], lengths[order]
        self.ids = np.concatenate([self.ids, flat])

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the count of each row."""
        starts, ends, rows = word_bounds(data, offsets)
        hashes = hash_spans(LOWER[data], starts, ends)  # A-Z and a-z have the same ids
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            raw = data.tobytes()
            places = first[~known]
            self._learn(distinct[~known], [raw[s:e].decode() for s, e in zip(starts[places].tolist(), ends[places].tolist())])
            at = np.searchsorted(self.keys, distinct)
        lengths = self.lengths[at][inverse]
        begins = self.starts[at][inverse]
        stops = np.cumsum(lengths)
        index = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(begins - (stops - lengths), lengths)
        totals = np.concatenate([[0], stops])
        return self.ids[index], np.diff(totals[rows])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and its kept words for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Lay documents of these lengths into as few sequences as hold them.

    Returns pieces (document, start, length, sequence, offset) and the cost of each sequence. The sum of the
    lengths divided by the capacity, rounded up, gives the number of sequences; all but the part of the last
    that isn't needed are filled.
    """
    total = int(lengths.sum())
    full, rest = divmod(total, capacity)
    room = [capacity] * full
    while rest:  # powers of two, largest first
        room.append(1 << (rest.bit_length() - 1))
        rest -= room[-1]
    sizes, cost = list(room), [0.0] * len(room)
    heap = [(0.0, k) for k in range(len(room))]
    pieces = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            spent, k = heapq.heappop(heap)
            n = min(left, room[k])
            pieces.append((doc, start, n, k, sizes[k] - room[k]))
            room[k] -= n
            start, left = start + n, left - n
            cost[k] = spent + linear * n + quadratic * n * n
            if room[k]:
                heapq.heappush(heap, (cost[k], k))
    return pieces, cost


def _packer(path: str, capacity: int, end_id: int, linear: float, quadratic: float, round_tokens: int, id_type: pa.DataType):
    schema = pa.schema([
        ("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = tokenizer(path)
        next_sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, int, int, np.ndarray]] = []  # document, ids before, all its ids, ids
        held_tokens = 0

        def lay(docs):
            nonlocal next_sequence
            pieces, cost = assign(np.array([len(d[3]) for d in docs], np.int64), capacity, linear, quadratic)
            rows = {name: [] for name in schema.names}
            for doc, start, n, k, offset in pieces:
                doc_id, before, whole, ids = docs[doc]
                for name, value in zip(schema.names, (doc_id, before + start, n, zlib.crc32(ids[start : start + n]), whole, next_sequence + k, offset, cost[k])):
                    rows[name].append(value)
            next_sequence += len(cost)
            return pa.RecordBatch.from_pydict(rows, schema)

        def round_off():
            """Pack all full sequences; what goes beyond them stays for the next round."""
            nonlocal held, held_tokens
            over = held_tokens % capacity
            kept = []
            while over:
                doc_id, before, whole, ids = held.pop()
                if len(ids) > over:
                    cut = len(ids) - over
                    held.append((doc_id, before, whole, ids[:cut]))
                    before, ids = before + cut, ids[cut:]
                kept.append((doc_id, before, whole, ids))
                over -= len(ids)
            full, held, held_tokens = held, kept[::-1], sum(len(k[3]) for k in kept)
            return lay(full)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for row, data, offsets in slices(batch.column("text")):
                flat, counts = words.ids_of(data, offsets)
                stops = np.cumsum(counts)
                for k, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist())):
                    ids = np.empty(count + 1, "<u4")
                    ids[:-1], ids[-1] = flat[stop - count : stop], end_id
                    held.append((names[row + k], 0, len(ids), ids))
                    held_tokens += len(ids)
                    if held_tokens >= round_tokens:
                        yield round_off()
        if held:
            yield lay(held)

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 1024,
         round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """A row for each piece: its document and place there, its sequence and place there, the CRC-32 of its ids
    (little-endian, unsigned 32-bit), the tokens of the whole document and the cost of the sequence.

    ``doc_id`` keeps its value as a long. A sequence's number is the partition shifted by 33 bits plus a count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, capacity, end_id, linear, quadratic, round_tokens, pa.int64()), PIECE)
