"""N-gram Jaccard self-join by token-combination prefixes, and the classes that its links make.

A document is the set of hashes of its word n-grams. The tokens of all sets have one order: rare ones before
frequent ones, by hash within. Two sets of n and m tokens with Jaccard similarity t share most of their tokens,
so of the first ``u + k`` tokens of each, where ``u = n - ceil(t * n)``, they share k at least. Hence

- a set with more than u rare tokens is indexed by its first u + 1 rare tokens, one by one;
- any other set is indexed by all its rare tokens, one by one, and its prefix is extended to ``2 u + 2``
  tokens. Similar sets that share no rare token share 2 + u of the frequent ones there, and as at most u of each
  list lie between, two shared tokens follow each other with at most two others between them in both lists
  together. So the frequent tokens are indexed by combinations of two that are at most three places apart.

Sets that meet under a key are compared in full. Keys with few sets give their pairs; keys with many compare
all their sets with one, the set of fewest rare tokens, link by link, until a key's sets are of one class, and
then whatever the triangle inequality of the Jaccard distance leaves undecided. So no link between classes is
lost, and no group is ever multiplied out.

Which tokens are frequent is learned by counting all n-grams of all texts; the class table that is broadcast
has a fixed size.

Defined results
- A text with fewer words than n is one token, without words it is empty and linked with nothing.
- Equal sets are one class. Null text is empty. A null doc_id belongs to its class like any other; the
  component is the smallest id that isn't null, null if there is none.
- Repeated rows stay rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.llm.components import components
from greenlight.llm.space import release
from greenlight.llm.words import hashed_words, mix, rolling, row_of, slices
from greenlight.session import cut_lineage

TOKEN_BITS = 48
CLASS_BITS = 26
MOST_FREQUENT = 1 << 21
LEAST_FREQUENT = 16
SMALL_KEY = 32
SHARE_BYTES = 16 << 20
HOLD = 3_000_000
APART = 3
STAR_ROUNDS = 6
BLOCK_PAIRS = 500
BLOCK_SETS = 10_000


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each row, one row after the other, and where each row starts."""
    values, row, count = all_tokens(data, offsets, words)
    keyed = np.sort((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | values)
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[new]
    owner = (keyed >> np.uint64(TOKEN_BITS)).astype(np.int64)
    return keyed & np.uint64((1 << TOKEN_BITS) - 1), np.searchsorted(owner, np.arange(count + 1))


def all_tokens(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Every n-gram's token and row, and the count of rows. A row of fewer words is one token."""
    hashes, rows = hashed_words(data, offsets)
    row = row_of(rows)
    joined = rolling(hashes, words)
    inside = row[: len(joined)] == row[words - 1 :] if len(joined) else np.zeros(0, bool)
    values, owner = joined[inside], row[: len(joined)][inside]
    counts = np.diff(rows)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        own = np.array([mix(rolling(hashes[rows[k] : rows[k + 1]], int(counts[k])) + np.uint64(counts[k]))[0] for k in short], np.uint64)
        values, owner = np.concatenate([values, own]), np.concatenate([owner, short])
    return values >> np.uint64(64 - TOKEN_BITS), owner, len(counts)


def set_ids(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit values for each set, from order-free sums over its tokens; two zeros for an empty one."""
    sizes = np.diff(starts).astype(np.uint64)
    out = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xD1342543DE82EF95)):
            out[full, k] = mix(np.add.reduceat(mix(tokens + np.uint64(salt)), starts[:-1][full]) + sizes[full])
    return out


def _binary(pairs: np.ndarray, valid: np.ndarray) -> pa.Array:
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs.astype(">u8")).tobytes())])
    return pa.compute.if_else(pa.array(valid), values.cast(pa.binary()), pa.scalar(None, pa.binary()))


# -- frequent tokens -----------------------------------------------------------


def _counter(words: int, power: int):
    """Counts of the upper 32 bits of tokens, as blobs for each share of their upper bits."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            share = (keys >> np.uint32(32 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)
            at = np.flatnonzero(np.diff(share, prepend=-1))
            ends = np.append(at[1:], len(keys))
            yield pa.RecordBatch.from_arrays([
                pa.array(share[at]), pa.array([keys[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
                pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in zip(at, ends)], pa.binary()),
            ], ["share", "keys", "counts"])

        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                tokens = (all_tokens(data, offsets, words)[0] >> np.uint64(TOKEN_BITS - 32)).astype(np.uint32)
                held.append(tokens)
                size += len(tokens)
                if size > 2 * HOLD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return count


def _sums(least: int):
    def add_up(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        sums = np.add.reduceat(counts, at) if len(at) else counts
        many = sums >= least
        return pa.table({"key": pa.array(keys[at][many].astype(np.int64)), "count": pa.array(sums[many])})

    return add_up


def frequent_table(texts: DataFrame, words: int, power: int, least_frequent: int) -> np.ndarray:
    """A bit for each of the upper CLASS_BITS bits of a token, set for the most frequent tokens. At most
    MOST_FREQUENT counts come to the driver."""
    blobs = texts.mapInArrow(_counter(words, power), "share long, keys binary, counts binary")
    found = cut_lineage(blobs.groupBy("share").applyInArrow(_sums(least_frequent), "key long, count long"))
    by_size = found.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).count().collect()
    least, room = 64, MOST_FREQUENT
    for k, n in sorted(((r["k"], r["count"]) for r in by_size), reverse=True):
        room -= n
        if room < 0:
            break
        least = k
    keys = found.where(F.col("count") >= F.lit(2.0**least)).select("key").toArrow()["key"].to_numpy()
    return _bits(keys >> (32 - CLASS_BITS))


def _bits(places: np.ndarray) -> np.ndarray:
    """The bit table with these bits set, first bit first, without a byte for each bit on the driver."""
    table = np.zeros(1 << (CLASS_BITS - 3), np.uint8)
    np.bitwise_or.at(table, places >> 3, (128 >> (places & 7)).astype(np.uint8))
    return table


def is_frequent(packed: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(TOKEN_BITS - CLASS_BITS)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


# -- keys ----------------------------------------------------------------------


def prefix_keys(tokens: np.ndarray, starts: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Single keys with their rows, combined keys with their rows, and the rare tokens of each row.

    Sets of which no other set can be similar, fewer than ``100 / (100 - percent)`` tokens less one, have none.
    """
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    spare = n + (-percent * n // 100)  # n - ceil(percent / 100 * n)
    rare_before = np.concatenate([[0], np.cumsum(~frequent)])
    rare = rare_before[starts[1:]] - rare_before[starts[:-1]]
    rank = rare_before[:-1] - rare_before[starts[:-1]][row]
    large = 100 * n >= percent * (n + 1)
    single = ~frequent & (rank <= spare[row]) & large[row]
    rank = np.arange(len(tokens)) - starts[:-1][row] - rank
    open_rows = large & (rare <= spare)
    use = frequent & open_rows[row] & (rank < (2 * spare + 2 - rare)[row])
    listed, owner = tokens[use], row[use]
    keys, rows = [], []
    for apart in range(1, APART + 1):
        same = owner[apart:] == owner[:-apart]
        keys.append(mix(listed[:-apart][same] * np.uint64(0x9E3779B97F4A7C15) + listed[apart:][same]) if len(listed) > apart else listed[:0])
        rows.append(owner[:-apart][same] if len(listed) > apart else owner[:0])
    return tokens[single], row[single], np.concatenate(keys), np.concatenate(rows), rare


def _documents(words: int, percent: int, shared):
    """doc_id, set size, set id, handle and, for sets that need them, combined keys."""

    def describe(batches):
        packed = shared.value
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                tokens, starts = token_sets(data, offsets, words)
                n = np.diff(starts)
                ids = set_ids(tokens, starts)
                _, _, keys, rows, rare = prefix_keys(tokens, starts, is_frequent(packed, tokens), percent)
                order = np.argsort(rows, kind="stable")
                ends = np.searchsorted(rows[order], np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(n)), batch.column("text_key").slice(first, len(n)), pa.array(n), _binary(ids, n > 0), pa.array(ids[:, 0].view(np.int64), mask=n == 0),
                    pa.array(rare), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))),
                ], ["doc_id", "text_key", "n", "sid", "handle", "rare", "keys"])

    return describe


def _singles(words: int, percent: int, power: int, shared):
    """Single keys with handle and set size, as blobs for each share of the upper bits of the key."""

    def index(batches):
        packed = shared.value
        held, size = [], 0

        def flush():
            keys, handles, sizes = (np.concatenate(x) for x in zip(*held))
            share = (keys >> np.uint64(TOKEN_BITS - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)
            order = np.argsort(share, kind="stable")
            share, keys, handles, sizes = share[order], keys[order], handles[order], sizes[order]
            at = np.flatnonzero(np.diff(share, prepend=-1))
            ends = np.append(at[1:], len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(share[at]), *(pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for x in (keys, handles, sizes))],
                ["share", "keys", "handles", "sizes"],
            )

        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                tokens, starts = token_sets(data, offsets, words)
                keys, rows, *_ = prefix_keys(tokens, starts, is_frequent(packed, tokens), percent)
                held.append((keys, set_ids(tokens, starts)[rows, 0], np.diff(starts)[rows].astype(np.uint32)))
                size += len(keys)
                if size > HOLD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return index


def _meetings(percent: int, small_key: int):
    """Of one share of the single keys: the pairs of keys with few sets, and the members of keys with many."""

    def meet(table: pa.Table) -> pa.Table:
        keys, handles, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("handles", np.uint64), ("sizes", np.uint32)))
        order = np.lexsort((handles, keys))
        keys, handles, sizes = keys[order], handles[order], sizes[order].astype(np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (handles[1:] != handles[:-1])
        keys, handles, sizes = keys[new], handles[new], sizes[new]
        at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        runs = np.diff(np.append(at, len(keys)))
        length = np.repeat(runs, runs)
        few = (length > 1) & (length <= small_key)
        k, h, n = keys[few], handles[few], sizes[few]
        a, b = [], []
        for apart in range(1, min(small_key, len(k))):
            near = (k[apart:] == k[:-apart]) & (100 * np.minimum(n[apart:], n[:-apart]) >= percent * np.maximum(n[apart:], n[:-apart]))
            if not (k[apart:] == k[:-apart]).any():
                break
            a.append(h[:-apart][near])
            b.append(h[apart:][near])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.uint64)
        many = length > small_key
        return pa.table({
            "key": pa.array(np.concatenate([np.zeros(len(pairs), np.uint64), keys[many]]).view(np.int64), mask=np.arange(len(pairs) + many.sum()) < len(pairs)),
            "a": pa.array(np.concatenate([pairs[:, 0], handles[many]]).view(np.int64)),
            "b": pa.array(np.concatenate([pairs[:, 1], handles[many]]).view(np.int64)),
        })

    return meet


# -- verification --------------------------------------------------------------

MEMBER_WORDS = 1 << 18


def _membership(handles: DataFrame) -> np.ndarray:
    """A bit for each handle in a table of fixed size; others may share it."""
    place = F.shiftrightunsigned("handle", 64 - 24)
    rows = handles.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(handle, 40), 64) as int))").alias("bit"))
    out = np.zeros(MEMBER_WORDS, np.int64)
    for row in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def _sets(words: int, shared):
    """The sets whose handle may be asked for."""

    def take(batches):
        wanted = shared.value
        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                tokens, starts = token_sets(data, offsets, words)
                ids = set_ids(tokens, starts)
                place = ids[:, 0] >> np.uint64(40)
                asked = np.flatnonzero((wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) & (np.diff(starts) > 0).astype(np.uint64))
                asked = asked[np.unique(ids[asked], axis=0, return_index=True)[1]] if len(asked) else asked
                pieces = [tokens[starts[k] : starts[k + 1]].view(np.int64) for k in asked]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[asked, 0].view(np.int64)), _binary(ids[asked], np.ones(len(asked), bool)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int64))),
                ], ["handle", "sid", "tokens"])

    return take


def sets_of(handles: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """handle, sid and tokens of the sets with these handles, and of a few more, by one pass over the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(_membership(handles))
    sets = texts.mapInArrow(_sets(words, shared), "handle long, sid binary, tokens array<long>")
    return sets.groupBy("handle").agg(F.first("sid").alias("sid"), F.first("tokens").alias("tokens"))


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (handles), their sets' ids, whether they are linked, and their Jaccard distance."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = lambda x: sets.select(F.col("handle").alias(x), F.col("sid").alias(f"{x}_sid"), F.col("tokens").alias(f"{x}_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    all_ = F.size("a_tokens") + F.size("b_tokens")
    joined = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_sid", "b_sid", both.alias("i"), all_.alias("s"))
    union = F.col("s") - F.col("i")
    compared = cut_lineage(joined.select("a", "b", "a_sid", "b_sid", (100 * F.col("i") >= percent * union).alias("linked"), (1 - F.col("i") / union).alias("far")))
    release(pairs.sparkSession)
    return compared


def _overlaps(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
    """How many tokens each asked pair shares, out of the sets of two blocks."""
    handles = held.column("handle").to_numpy()
    column = held.column("tokens").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    tokens = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
    order = np.argsort(handles)
    a, b = (order[np.searchsorted(handles[order], asked.column(c).to_numpy())] for c in ("a", "b"))
    by_a = np.argsort(a, kind="stable")
    a, b = a[by_a], b[by_a]
    shared, marked = np.zeros(len(a), np.int64), np.zeros(len(tokens), bool)
    edges = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
    for i, j in zip(edges[:-1], edges[1:]):
        mine = tokens[ends[a[i]] : ends[a[i] + 1]]
        marked[mine] = True
        for k in range(i, j):
            shared[k] = np.count_nonzero(marked[tokens[ends[b[k]] : ends[b[k] + 1]]])
        marked[mine] = False
    return pa.table({"a": pa.array(handles[a]), "b": pa.array(handles[b]), "i": pa.array(shared), "s": pa.array(np.diff(ends)[a] + np.diff(ends)[b])})


def _compare_blocks(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b, a_sid, b_sid) among pairs of which a set may have very many: handles are dealt to blocks, and a set
    goes to each two blocks that have a pair of it once, not once a pair."""
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = pairs.count()
    blocks = max(1, isqrt(n // BLOCK_PAIRS), n // BLOCK_SETS)
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks))
    asked = pairs.select("a", "b", block("a").alias("p"), block("b").alias("q"))
    needed = asked.select(F.inline(F.array(*(F.struct(F.col(x).alias("handle"), F.col("p").alias("held_p"), F.col("q").alias("held_q")) for x in "ab")))).distinct()
    held = needed.join(sets.select("handle", "tokens"), "handle")
    found = asked.groupBy("p", "q").cogroup(held.groupBy("held_p", "held_q")).applyInArrow(_overlaps, "a long, b long, i long, s long")
    linked = cut_lineage(found.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"))
    release(pairs.sparkSession)
    one = lambda x: sets.select(F.col("handle").alias(x), F.col("sid").alias(f"{x}_sid"))
    return linked.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_sid", "b_sid")


def _labelled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of keys with their present class; only of keys whose members are of several."""
    found = members
    if "part" in members.columns:
        found = members.drop("part")
    parts = components(linked.select("a", "b")).select(F.col("node").alias("handle"), F.col("component").alias("_part"))
    found = found.join(parts, "handle", "left").withColumn("part", F.coalesce("_part", "handle")).drop("_part")
    several = found.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low <> _high").select("key")
    return cut_lineage(found.join(several, "key", "left_semi"))


def _possible(a: str, b: str, percent: int):
    """Whether two sets that meet under a combined key may be similar. If they share a rare token they meet under that
    as well and are decided there, so here each set's rare tokens count as missing from the other."""
    most = F.least(F.col(f"{a}n") - F.col(f"{a}rare"), F.col(f"{b}n") - F.col(f"{b}rare"))
    return F.col("single") | (100 * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n") - most))


def _crowded(members: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b, a_sid, b_sid) that decide all links among the members (key, single, handle, n, rare) of keys with many sets."""
    members = _labelled(members, linked)
    done = None
    left = members
    for k in range(STAR_ROUNDS):
        if left.isEmpty():
            break
        # every member is held against the member of fewest rare tokens
        share = (F.col("rare") / F.col("n")).alias("share")
        pivot = left.groupBy("key").agg(F.min(F.struct(share, "handle", "part", "n", "rare")).alias("p"))
        stars = left.join(pivot.select("key", "p", F.col("p.n").alias("p_n"), F.col("p.rare").alias("p_rare")), "key")
        stars = stars.where((F.col("part") != F.col("p.part")) & _possible("", "p_", percent))
        compared = _compare(stars.select(F.col("p.handle").alias("a"), F.col("handle").alias("b")), sets, percent)
        linked = linked.unionByName(compared.where("linked").select("a", "b", "a_sid", "b_sid"))
        done = compared if done is None else done.unionByName(compared)
        if k == 0:
            first = pivot.select("key", F.col("p.handle").alias("pivot"))
        if compared.where("linked").isEmpty():
            break
        members = _labelled(members, linked)
        # those that aren't in the class of a pivot yet get one of their own
        pivot = pivot.select("key", F.col("p.handle").alias("handle"))
        reached = members.join(pivot, ["key", "handle"], "left_semi").select("key", F.col("part").alias("_reached")).distinct()
        again = left.drop("part").join(members.select("key", "handle", "part"), ["key", "handle"])
        left = cut_lineage(again.join(reached, (again["key"] == reached["key"]) & (again["part"] == reached["_reached"]), "left_anti"))
    if done is None:
        return None
    # keys whose members are still of several classes, each in that of a pivot or not: pairs that the distances to the
    # key's first pivot don't rule out
    far = done.select(F.col("a").alias("pivot"), F.col("b").alias("handle"), "far").unionByName(done.select(F.col("b").alias("pivot"), F.col("a").alias("handle"), "far")).dropDuplicates(["pivot", "handle"])
    placed = members.join(first, "key").join(far, ["pivot", "handle"], "left").withColumn("far", F.when(F.col("handle") == F.col("pivot"), 0.0).otherwise(F.col("far")))
    main = placed.where("handle = pivot").select("key", F.col("part").alias("main"))
    placed = cut_lineage(placed.join(main, "key"))
    rest = placed.where("part <> main").select("key", F.col("handle").alias("a"), F.col("part").alias("a_part"), F.col("far").alias("a_far"), F.col("n").alias("a_n"), F.col("rare").alias("a_rare"))
    room = 1 - percent / 100 + 1e-9
    undecided = rest.join(placed, "key").where(
        (F.col("part") != F.col("a_part")) & (F.col("part").eqNullSafe(F.col("main")) | (F.col("a") < F.col("handle")))
        & (F.coalesce(F.abs(F.col("far") - F.col("a_far")), F.lit(0.0)) <= room)
        & (100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")) & _possible("", "a_", percent)
    )
    last = _compare_blocks(undecided.select("a", F.col("handle").alias("b")), sets, percent)
    return done.where("linked").select("a", "b", "a_sid", "b_sid").unionByName(last)


def links(docs: DataFrame, words: int, percent: int, least_frequent: int = LEAST_FREQUENT, small_key: int = SMALL_KEY) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text_key, n, sid) and links (a, b) between different sets that join all that belong together.

    A token counted ``least_frequent`` times or more is frequent, as far as the class table has room; a single key
    with more than ``small_key`` sets is treated as a combined one. Neither changes the classes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    power = min(20, (size // SHARE_BYTES).bit_length())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frequent_table(texts.select("text"), words, power, least_frequent))
    release(docs.sparkSession)
    described = cut_lineage(texts.mapInArrow(_documents(words, percent, shared), "doc_id long, text_key long, n long, sid binary, handle long, rare long, keys array<long>"))
    blobs = texts.select("text").mapInArrow(_singles(words, percent, power, shared), "share long, keys binary, handles binary, sizes binary")
    met = cut_lineage(blobs.groupBy("share").applyInArrow(_meetings(percent, small_key), "key long, a long, b long").distinct())
    del blobs
    release(docs.sparkSession)
    only = texts.select("text")
    pairs = cut_lineage(met.where("key is null").select("a", "b").distinct())
    compared = _compare(pairs, sets_of(pairs.select(F.col("a").alias("handle")).union(pairs.select("b")), only, words), percent)
    linked = compared.where("linked").select("a", "b", "a_sid", "b_sid")
    sizes = described.where("handle is not null").groupBy("handle").agg(F.max("n").alias("n"), F.min("rare").alias("rare"))
    combined = described.where(F.size("keys") > 0).select("handle", F.explode("keys").alias("key"), F.lit(False).alias("single"))
    crowded = combined.unionByName(met.where("key is not null").select(F.col("a").alias("handle"), "key", F.lit(True).alias("single")))
    crowded = crowded.groupBy("key", "handle").agg(F.max("single").alias("single"))
    shared_keys = crowded.groupBy("key").agg(F.count("*").alias("k"), F.max("single").alias("single")).where("k > 1").select("key", "single")
    crowded = cut_lineage(crowded.drop("single").join(shared_keys, "key").join(sizes, "handle"))
    if crowded.isEmpty():
        decided = None
    else:
        decided = _crowded(crowded, linked, cut_lineage(sets_of(crowded.select("handle"), only, words)), percent)
    if decided is not None:
        linked = linked.unionByName(decided)
    return described.select("doc_id", "text_key", "n", "sid"), linked.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))


def classes(docs: DataFrame, words: int = 4, percent: int = 85, **sizes: int) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: two rows are of one component if their sets are equal or joined
    by links of ``100 * intersection >= percent * union``; the component is its smallest doc_id."""
    described, found = links(docs, words, percent, **sizes)
    parts = components(found).select(F.col("node").alias("sid"), F.col("component").alias("part"))
    full = described.where("sid is not null")
    owners = full.groupBy("sid").agg(F.min("doc_id").alias("least")).join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    smallest = owners.groupBy("part").agg(F.min("least").alias("component_id"))
    named = owners.select("sid", "part").join(smallest, "part").select("sid", "component_id")
    out = full.join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(described.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, **sizes: int) -> DataFrame:
    """The rows of ``docs`` without those that have a smaller one in their component, by (id, hash of the text), a null id
    last. Rows that share id and text are one document; rows without words stay."""
    described, found = links(docs, words, percent, **sizes)
    parts = components(found).select(F.col("node").alias("sid"), F.col("component").alias("part"))
    full = described.where("sid is not null").join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    stays = full.groupBy("part").agg(F.min(key).alias("stays"), F.max(key).alias("last")).where("stays <> last").select("part", "stays")
    goes = full.join(stays, "part").where(~key.eqNullSafe(F.col("stays"))).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(goes, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_key")), "left_anti")
