"""Alignment of the tokens of two tokenizers over the same bytes.

A token covers a stretch of bytes. Batch by batch, ``pandas.merge_asof`` keyed by document finds for the start of
every token of one side the token of the other side that covers it; done both ways, the union of the pairs is all
overlaps. Where a token begins just where its covering token begins, both sides ended a token before; these places
cut the document into groups. A token pair is linked if both lie in one group.

Texts are cut before a space that follows another byte than a space and precedes a visible one. Neither tokenizer
joins across such a place, so pieces are encoded once and kept by their hash, up to ``CACHE_PIECES`` of them.

How many documents hold a linked id pair is counted over the whole corpus. The links of each document, one row for
each pair of ids with its occurrences, are written once to the shared folder and counted there. The most frequent
pairs, ``HEAD_PAIRS`` at most, are then broadcast with their counts, so that the links on which a hot pair could
sit don't move; the others are joined by pair. The highest count of an id is at most a row for each id.

Defined results
- Texts that are null, empty, or not given back byte for byte by both sides have no tokens: zeros, an empty digest.
- Strings of special tokens within texts are plain text.
- A very long text goes through in parts of about ``PART`` bytes, cut between groups; its distinct pairs are held.
- In a group of many tokens the pairs of distinct ids are formed, not those of occurrences.
- Repeated rows and ids are documents of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.words import hash_spans, slices
from greenlight.session import shared_dir

CACHE_PIECES = 400_000
PART = 1 << 19
TOGETHER = 64
LARGE_GROUP = 4096
CELLS = 1 << 21
HEAD_PAIRS = 1 << 18

LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))
FIELDS = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", LINKS),
]
ROWS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, "
    "links array<struct<a: int, b: int, m: long>>"
)

#: First bytes of characters beyond ASCII that may be white space (fixed values); texts are not cut before them.
WIDE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)
#: How a byte-level tokenizer splits a text before it joins bytes (fixed value).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = np.arange(256) > 0x20
VISIBLE[[0x7F, *WIDE_SPACE]] = False
SEEN = frozenset(np.flatnonzero(VISIBLE).tolist())


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves,
    the other bytes, in order, are the characters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def byte_pair_encoder(path: str, spelled: list[bytes]):
    """The ids of texts by a byte-level vocabulary file through ``tiktoken``, which is several times as fast; None for
    a file whose ids aren't its merges in order, which ranks stand for, or that changes texts before."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model.get("merges", [])]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
    if model["type"] != "BPE" or not plain or merged != list(range(256, 256 + len(merged))):
        return None
    ranks = {x: k for k, x in enumerate(spelled[: 256 + len(merged)])}
    made = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [made.encode_ordinary(x) for x in texts]


class Side:
    """One tokenizer: ids of pieces, and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            by_char = byte_level()
            self.bytes = [b""] * made.get_vocab_size()
            for entry, k in made.get_vocab().items():
                self.bytes[k] = bytes(map(by_char.get, entry)) if all(c in by_char for c in entry) else entry.encode()
            fast = byte_pair_encoder(path, self.bytes)
            self.encode = fast or (lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)])
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            whole = [model.id_to_piece(k) for k in range(model.get_piece_size())]
            self.bytes = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(whole)]
            self.encode = lambda texts: model.encode([x[1:] for x in texts], num_threads=1)  # it puts a space first itself
        self.size = len(self.bytes)
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        self.digits = decimals(self.size)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, where those of each begin, how many it has, and whether their bytes give the piece back.

        Pieces that could follow one another in a text are encoded ``TOGETHER`` at a time; texts that don't come
        back byte for byte are encoded again piece by piece.
        """
        joins = np.fromiter((len(x) > 1 and x[0] == 0x20 and x[1] in SEEN and x[-1] != 0x20 for x in pieces), bool, len(pieces))
        order = np.argsort(~joins, kind="stable")
        pieces = [pieces[k] for k in order.tolist()]
        n = int(joins.sum())
        edges = [*range(0, n, TOGETHER), *range(n, len(pieces) + 1)]
        texts = [b"".join(pieces[a:b]) for a, b in zip(edges, edges[1:])]
        encoded = list(self.encode([x.decode() for x in texts]))
        good = np.ones(len(pieces), bool)
        if self._bytes(_flat(encoded)) == b"".join(pieces):
            ids = _flat(encoded)
            stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(x) for x in pieces])) + 1
            count = np.diff(stops, prepend=0)
        else:
            single = []
            for a, b, text, ids in zip(edges, edges[1:], texts, encoded):
                if b - a == 1:
                    single.append(ids)
                elif self._bytes(np.array(ids, np.int64)) == text:
                    stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(x) for x in pieces[a:b]])) + 1
                    single += [ids[x:y] for x, y in zip([0, *stops.tolist()], stops.tolist())]
                else:
                    single += self.encode([x.decode() for x in pieces[a:b]])
            good = np.fromiter((self._bytes(np.array(x, np.int64)) == y for x, y in zip(single, pieces)), bool, len(pieces))
            ids, count = _flat(single), np.fromiter(map(len, single), np.int64, len(pieces))
        back = np.argsort(order)
        return ids, (np.cumsum(count) - count)[back], count[back], good[back]

    def _bytes(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        stop = np.cumsum(n)
        return self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.at[ids] - (stop - n), n)].tobytes()


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))


def decimals(size: int) -> np.ndarray:
    """The decimal digits of all numbers below ``size``, left-aligned, 0 where there is none."""
    width = len(str(size))
    text = np.array([str(k).ljust(width + 1, "\0") for k in range(size)]).astype(f"S{width + 1}")
    return np.frombuffer(text.tobytes(), np.uint8).reshape(size, width + 1)


class Known:
    """Ids of pieces by their hash, for both sides."""

    def __init__(self, paths: tuple[str, str]):
        self.sides = (Side(paths[0]), Side(paths[1]))
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.whole = np.zeros(0, bool)
        self.start = [np.zeros(0, np.int64)] * 2
        self.count = [np.zeros(0, np.int64)] * 2
        self.ids = [np.zeros(0, np.int32)] * 2

    def learn(self, keys: np.ndarray, pieces: list[bytes]):
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        whole = np.ones(len(pieces), bool)
        for k, side in enumerate(self.sides):
            ids, start, count, good = side.ids(pieces)
            whole &= good
            self.start[k] = np.concatenate([self.start[k], len(self.ids[k]) + start])[order]
            self.count[k] = np.concatenate([self.count[k], count])[order]
            self.ids[k] = np.concatenate([self.ids[k], ids])
        self.whole = np.concatenate([self.whole, whole])[order]
        self.keys = np.concatenate([self.keys, keys])[order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each piece among the known ones; new pieces are learnt."""
        distinct, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            self.learn(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, distinct)
        return at[inverse]

    def tokens(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after the other, and how many each has."""
        count, start = self.count[side][places], self.start[side][places]
        stop = np.cumsum(count)
        return self.ids[side][np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - count), count)], count


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at rows, and before a space after another byte and before a visible one."""
    begins = np.zeros(len(data), bool)
    begins[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & VISIBLE[data[2:]]
    begins[offsets[1:-1] - 1] = False  # the byte after it belongs to the next row
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins)


def covering(starts: np.ndarray, docs: np.ndarray, other_starts: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each token start the token of the other side that covers it, within its document."""
    left = pd.DataFrame({"start": starts, "doc": docs}, copy=False)
    right = pd.DataFrame({"start": other_starts, "doc": other_docs, "token": np.arange(len(other_starts))}, copy=False)
    return pd.merge_asof(left, right, on="start", by="doc")["token"].to_numpy(np.int64)


class Aligned:
    """Groups of the tokens of some documents; tokens of a side lie one after the other."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        starts = [np.cumsum(n) - n for n in lengths]
        self.ids, self.docs = ids, docs
        self.cover = [covering(starts[k], docs[k], starts[1 - k], docs[1 - k]) for k in (0, 1)]
        fresh = [starts[1 - k][self.cover[k]] == starts[k] for k in (0, 1)]  # both sides begin a token here
        self.group = [np.cumsum(f) - 1 for f in fresh]
        self.first = [np.flatnonzero(f) for f in fresh]
        self.size = [np.diff(np.append(f, len(x))) for f, x in zip(self.first, ids)]
        self.group_doc = docs[0][self.first[0]]
        self.fresh = fresh

    def overlaps(self) -> np.ndarray:
        """All (token of A, token of B) that share a byte: the union of both directions."""
        a, b = np.arange(len(self.ids[0])), np.arange(len(self.ids[1]))
        later = ~self.fresh[1]  # a B token that begins with an A token is that token's covering one already
        return np.concatenate([np.stack([a, self.cover[0]], 1), np.stack([self.cover[1][later], b[later]], 1)])

    def links(self, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, id of A, id of B) that are linked, as one number, and their occurrences."""
        large = self.size[0] * self.size[1] > LARGE_GROUP
        terms = []
        for k in (0, 1):
            group, ids = self.group[k], self.ids[k].astype(np.int64)
            times = np.ones(len(ids), np.int64)
            if large.any():  # distinct ids of large groups with their counts
                inside = large[group]
                key, count = np.unique(group[inside] * sizes[k] + ids[inside], return_counts=True)
                group = np.concatenate([group[~inside], key // sizes[k]])
                order = np.argsort(group, kind="stable")
                group, ids, times = group[order], np.concatenate([ids[~inside], key % sizes[k]])[order], np.concatenate([times[~inside], count])[order]
            terms.append((group, ids, times))
        (group, a, times_a), (group_b, b, times_b) = terms
        count_b = np.bincount(group_b, minlength=len(large))
        first_b = np.cumsum(count_b) - count_b
        fan = count_b[group]
        out = []
        for part in np.split(np.arange(len(a)), np.searchsorted(np.cumsum(fan), np.arange(CELLS, int(fan.sum()), CELLS))):
            n = fan[part]
            stop = np.cumsum(n)
            at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first_b[group[part]] - (stop - n), n)
            key = np.repeat((self.group_doc[group[part]] * sizes[0] + a[part]) * sizes[1], n) + b[at]
            out.append(summed(key, np.repeat(times_a[part], n) * times_b[at]))
        return out[0] if len(out) == 1 else summed(np.concatenate([k for k, _ in out]), np.concatenate([t for _, t in out]))

    def written(self, digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for all groups, and the number of bytes up to the end of each."""
        place = [np.arange(len(self.ids[0])) + np.append(0, np.cumsum(self.size[1]))[self.group[0]], np.arange(len(self.ids[1])) + np.cumsum(self.size[0])[self.group[1]]]
        cells = np.zeros((len(self.ids[0]) + len(self.ids[1]), max(d.shape[1] for d in digits)), np.uint8)
        for k, mark in ((0, b"|"), (1, b";")):
            mine = digits[k][self.ids[k]]
            last = self.first[k] + self.size[k] - 1
            sign = np.full(len(mine), ord(","), np.uint8)
            sign[last] = ord(mark)
            mine[np.arange(len(mine)), (mine != 0).sum(axis=1)] = sign
            cells[place[k], : mine.shape[1]] = mine
        used = cells != 0
        ends = np.cumsum(used.sum(axis=1))
        return cells[used].tobytes(), ends[np.cumsum(self.size[0] + self.size[1]) - 1]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


_KNOWN: dict[tuple[str, str], Known] = {}


def known(paths: tuple[str, str]) -> Known:
    """The tokenizers and their kept pieces, once for each Python worker."""
    if paths not in _KNOWN:
        _KNOWN[paths] = Known(paths)
    return _KNOWN[paths]


def _aligner(paths: tuple[str, str]):
    schema = pa.schema(FIELDS)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_row = TaskContext.get().partitionId() << 33
        both = known(paths)
        sides = both.sides
        sizes = (sides[0].size, sides[1].size)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), PART):
                n = len(offsets) - 1
                begins = cuts(data, offsets)
                stops = np.append(begins[1:], len(data))
                doc = np.searchsorted(offsets, begins, side="right") - 1
                places = both.find(data, begins, stops)
                sound = np.diff(offsets) > 1
                sound[doc[~both.whole[places]]] = False
                kept = sound[doc]
                doc, places, nbytes = doc[kept], places[kept], (stops - begins)[kept]
                totals = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")}
                digests = [hashlib.sha256() for _ in range(n)]
                pairs = []
                for part in np.split(np.arange(len(doc)), np.searchsorted(np.cumsum(nbytes), np.arange(PART, int(nbytes.sum()), PART))):
                    if not len(part):
                        continue
                    (ids_a, count_a), (ids_b, count_b) = both.tokens(0, places[part]), both.tokens(1, places[part])
                    docs = np.repeat(doc[part], count_a), np.repeat(doc[part], count_b)
                    found = Aligned((ids_a, ids_b), docs, (sides[0].length[ids_a], sides[1].length[ids_b]))
                    text, ends = found.written((sides[0].digits, sides[1].digits))
                    last = np.flatnonzero(np.append(found.group_doc[1:] != found.group_doc[:-1], True))
                    at = 0
                    for k, stop in zip(found.group_doc[last].tolist(), ends[last].tolist()):
                        if totals["n_groups"][k]:
                            digests[k].update(b";")  # goes on from the part before
                        digests[k].update(text[at : stop - 1])
                        at = stop
                    totals["n_a"] += np.bincount(docs[0], minlength=n)
                    totals["n_b"] += np.bincount(docs[1], minlength=n)
                    totals["n_groups"] += np.bincount(found.group_doc, minlength=n)
                    totals["n_overlaps"] += np.bincount(docs[0][found.overlaps()[:, 0]], minlength=n)
                    np.add.at(totals["n_links"], found.group_doc, found.size[0] * found.size[1])
                    pairs.append(found.links(sizes))
                key, times = pairs[0] if len(pairs) == 1 else summed(*(np.concatenate([x[k] for x in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1)))
                pair = key % (sizes[0] * sizes[1])
                spans = pa.StructArray.from_arrays(
                    [pa.array((pair // sizes[1]).astype(np.int32)), pa.array((pair % sizes[1]).astype(np.int32)), pa.array(times)], fields=list(LINKS.value_type)
                )
                bounds = np.searchsorted(key, np.arange(n + 1) * (sizes[0] * sizes[1]))
                hexed = [d.hexdigest() if m else "" for d, m in zip(digests, totals["n_groups"].tolist())]
                columns = [pa.array(np.arange(next_row, next_row + n)), batch.column("doc_id").slice(row, n), *map(pa.array, totals.values())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hexed), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)], schema=schema)
                next_row += n

    return align


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its tokens, groups, overlaps and links, the digest of its groups, and its linked id
    pairs with their occurrences. Side A is a ``tokenizers`` file, side B a ``sentencepiece`` model that puts a space
    before a text; A gets the same space."""
    text = F.concat(F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_aligner((path_a, path_b)), ROWS)


def pair_counts(links: DataFrame) -> DataFrame:
    """For each linked id pair the number of documents that hold it."""
    return links.groupBy("a", "b").agg(F.count("*").alias("n_docs"))


def align(docs: DataFrame, path_a: str, path_b: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``groups`` with, for each document, ``count_sum``, the sum of the pair counts of its links, and ``n_best``, how
    many of its links have the highest count of their id of A."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    groups(docs, path_a, path_b).write.parquet(f"{folder}/groups")
    rows = spark.read.parquet(f"{folder}/groups")
    links = rows.select("row", F.explode("links").alias("link")).select("row", "link.a", "link.b", "link.m")
    pair_counts(links).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    best = counts.groupBy("a").agg(F.max("n_docs").alias("best"))
    counts = counts.join(F.broadcast(best), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("best")).cast("long").alias("is_best"))

    # The lowest number of bits of a count at which all pairs from there on fit the head.
    bits = counts.groupBy(F.length(F.bin("n_docs")).alias("bits")).count().collect()
    least, room = 64, head_pairs
    for size in sorted(bits, reverse=True):
        if size["count"] > room:
            break
        least, room = size["bits"], room - size["count"]
    frequent = F.length(F.bin("n_docs")) >= least
    head, tail = F.broadcast(counts.where(frequent)), counts.where(~frequent)
    sums = [F.sum(F.col("m") * F.col("n_docs")).alias("count_sum"), F.sum(F.col("m") * F.col("is_best")).alias("n_best")]
    often = links.join(head, ["a", "b"]).groupBy("row").agg(*sums)
    seldom = links.join(head.select("a", "b"), ["a", "b"], "left_anti").join(tail, ["a", "b"]).groupBy("row").agg(*sums)
    both = often.unionByName(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.drop("links").join(both, "row", "left").fillna(0, ["count_sum", "n_best"]).drop("row")
