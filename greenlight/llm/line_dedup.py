"""Fuzzy duplicate lines, with DataFrame functions only.

Lines are normalised to their lower-case words; every character of a script written without spaces is one. Each line gets a 64-bit SimHash of its words. SimHashes that
differ in at most three bits agree in all but three of B blocks, so lines meet under every choice of B - 3
blocks, and pairs that meet are verified: near by Hamming distance, then by the edit similarity of their
words. Of the lines of each connected group one occurrence stays, the one with the smallest
(doc_id, hash of the text, line number).

B follows the number of distinct lines, so that a key of B - 3 blocks has more values than there are lines;
which pairs meet within three bits doesn't depend on it. Under one key every line is held against the 31 lines
before it and against the first. Where a key has more lines and they don't all end up in one group, the lines
outside the first line's group are held against all others of the key within three bits.

Defined results
- Lines are what stands between newlines. A line of fewer than ``min_words`` words stays and takes no part.
- Null text stays null; extra columns stay.
- Rows that share id and text are treated alike: they keep and lose the same lines.
- Equal normalised lines are recognised by a 64-bit hash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenlight.llm.components import components
from greenlight.llm.space import release
from greenlight.session import cut_lineage

MIN_WORDS = 3
BITS_APART = 3
SIMILARITY = 0.8
NEIGHBOURS = 31
SHORT = 127
BYTES_OF_ONE = 0x0101010101010101
BYTES_OF_64 = 0x4040404040404040
MEMBER_BITS = 20


UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def words_of(line: Column) -> Column:
    """The lower-case runs of letters and digits of a line, and its characters of scripts written without spaces."""
    kept = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")
    kept = F.when(F.octet_length(line) > F.char_length(line), F.regexp_replace(kept, UNSPACED, " $1 ")).otherwise(kept)
    return F.array_remove(F.split(F.trim(kept), " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _counted(hashes: Column, shift: int, mask: int) -> Column:
    """The sum over the hashes of every bit of a mask, each in a counter of its own."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, x: total + F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))


def _majority(hashes: Column) -> Column:
    """For each of 64 bits whether more than half of at most 127 hashes have it. Eight longs hold a counter in each
    byte; a counter above half of n reaches 64 when 63 - n / 2 is added."""
    bump = F.lit(BYTES_OF_ONE) * (F.lit(63) - F.floor(F.size(hashes) / 2))
    out = None
    for j in range(8):
        above = (_counted(hashes, j, BYTES_OF_ONE) + bump).bitwiseAND(F.lit(BYTES_OF_64))
        bits = F.shiftleft(F.shiftrightunsigned(above, 6), j)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def _long_majority(hashes: Column) -> Column:
    """The same for any number of hashes: bytes are counted over stretches of 127, and the stretches' bytes are added
    up in counters of 32 bits."""
    last = F.ceil(F.size(hashes) / SHORT).cast("int") - 1
    stretches = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(hashes, k * SHORT + 1, SHORT))
    size, half = F.size(hashes), F.lit((1 << 32) - 1)

    def bits_of(j):
        def of(total):
            found = F.lit(0).cast("long")
            for count, bit in ((total.bitwiseAND(half), j), (F.shiftrightunsigned(total, 32), j + 32)):
                one = (1 << bit) - (1 << 64 if bit == 63 else 0)
                found = found.bitwiseOR(F.when(count * 2 > size, F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
            return found

        return of

    def lane(j):
        def of(counts):
            found = F.lit(0).cast("long")
            for k in range(4):
                found = found.bitwiseOR(_let(_counted(counts, 8 * k, 0x000000FF000000FF), bits_of(j + 8 * k)))
            return found

        return of

    def all_lanes(parts):
        out = F.lit(0).cast("long")
        for j in range(8):
            counts = F.transform(parts, (lambda j: lambda part: _counted(part, j, BYTES_OF_ONE))(j))
            out = out.bitwiseOR(_let(counts, lane(j)))
        return out

    return _let(stretches, all_lanes)


def simhash(hashes: Column) -> Column:
    """The SimHash of a list of words' hashes: a bit is set if more than half of them have it."""
    return F.when(F.size(hashes) <= SHORT, _majority(hashes)).otherwise(_long_majority(hashes))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, pos, h, n and sim of every line that takes part."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc_id", "text_key", "pos", words_of(F.col("line")).alias("words")).where(F.size("words") >= min_words)
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("doc_id", "text_key", "pos", F.xxhash64("words").alias("h"), F.size("words").alias("n"), hashed.alias("hashes"))
    return rows.select("doc_id", "text_key", "pos", "h", "n", simhash(F.col("hashes")).alias("sim"))


def block_keys(sim: Column, count: int) -> list[Column]:
    """A key for every choice of all but BITS_APART of B blocks; B is the least number of blocks whose keys have four
    times as many values as there are lines."""
    blocks = next(b for b in range(BITS_APART + 1, 17) if 64 * (b - BITS_APART) // b >= (4 * count).bit_length() or b == 16)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    assert comb(blocks, BITS_APART) < 1000
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - BITS_APART)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(k), sim.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS_APART


def candidates(distinct: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines within three bits that are near each other under a key, and the lines (key, h, sim) of keys
    with more lines than are held against each other."""
    keyed = distinct.select("h", "sim", F.explode(F.array(*block_keys(F.col("sim"), count))).alias("key"))
    by_key = Window.partitionBy("key").orderBy("h")
    seen = keyed.select(
        "key", "h", "sim", F.row_number().over(by_key).alias("k"), F.first(F.struct("h", "sim")).over(by_key).alias("first"),
        F.count(F.lit(1)).over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("many"),
        F.collect_list(F.struct("h", "sim")).over(by_key.rowsBetween(-NEIGHBOURS, -1)).alias("before"),
    ).where("many > 1")
    far = F.when(F.col("k") > NEIGHBOURS + 1, F.array("first")).otherwise(F.array().cast("array<struct<h:bigint,sim:bigint>>"))
    met = F.transform(F.filter(F.concat("before", far), lambda x: near(x["sim"], F.col("sim"))), lambda x: x["h"])
    # a key with more lines than that keeps them all, so that they are not dealt out by key again
    found = seen.select((F.col("many") > NEIGHBOURS + 1).alias("crowded"), "key", "h", "sim", met.alias("met"))
    found = cut_lineage(found.where((F.size("met") > 0) | F.col("crowded")))
    pairs = cut_lineage(found.select(F.explode("met").alias("a"), F.col("h").alias("b")).distinct())
    release(distinct.sparkSession)
    return pairs, found.where("crowded").select("key", "h", "sim")


def _member(key: Column, keys: DataFrame) -> Column:
    """Whether a 64-bit key may be in a table, by a bit table of fixed size; others may share a bit."""
    rows = keys.select(F.shiftrightunsigned("key", 64 - MEMBER_BITS).cast("int").alias("place"))
    rows = rows.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    table = [0] * (1 << (MEMBER_BITS - 6))
    for row in rows.collect():  # at most 2 ** 14 rows
        table[row["word"]] = row["bits"]
    literal = F.expr(f"array({','.join(str(x) + 'L' if x != -(1 << 63) else 'bigint(-9223372036854775808)' for x in table)})")
    place = F.shiftrightunsigned(key, 64 - MEMBER_BITS).cast("int")
    return F.bit_get(F.element_at(literal, F.shiftright(place, 6) + 1), place % 64) == 1


def in_letters(words: Column) -> Column:
    """A string with one letter for each word, out of 20,480 letters by the word's hash."""
    code = lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(0x5000)) + F.lit(0x4E00))  # noqa: E731  (four digits each)
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


def verify(pairs: DataFrame, first: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words have the edit similarity: one less the words to put in, take out or change over the
    words of the longer line.

    The texts are read from the first occurrences of the lines (h, doc_id, text_key, pos)."""
    asked = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(first.join(asked, "h", "left_semi"))
    rows = docs.where(_member(F.xxhash64("text"), wanted.select(F.col("text_key").alias("key"))))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    same = (F.col("x.text_key") == F.col("w.text_key")) & (F.col("x.pos") == F.col("w.pos")) & F.col("x.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = rows.alias("x").join(wanted.alias("w"), same).select("h", in_letters(words_of(F.col("line"))).alias("words")).dropDuplicates(["h"])
    texts = cut_lineage(texts)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("words").alias("y")), "b")
    longer = F.greatest(F.length("x"), F.length("y"))
    most = F.floor(longer * (1 - similarity) + 1e-9).cast("int")
    shorter = F.least(F.length("x"), F.length("y"))
    both = both.where(longer - shorter <= most)
    edits = F.expr("levenshtein(x, y, most)")  # -1 beyond
    return cut_lineage(both.withColumn("most", most).where(edits >= 0).select("a", "b"))


def groups(docs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """h and component (the smallest h) of the lines that are linked with another line. ``found`` is ``lines(docs)``."""
    distinct = cut_lineage(found.groupBy("h").agg(F.min("sim").alias("sim"), F.min(F.struct("doc_id", "text_key", "pos")).alias("at")))
    first = distinct.select("h", "at.*")
    pairs, crowded = candidates(distinct.select("h", "sim"), distinct.count())
    linked = verify(pairs, first, docs, similarity)
    release(docs.sparkSession)
    parts = components(linked)
    crowded = crowded.join(parts.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("part", F.coalesce("component", "h")).drop("component")
    several = crowded.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "h").alias("main")).where("low <> high").select("key", "main")
    crowded = cut_lineage(crowded.join(several, "key"))
    if not crowded.isEmpty():
        rest = crowded.where("part <> main").select("key", F.col("h").alias("a"), F.col("sim").alias("a_sim"), F.col("part").alias("a_part"))
        once = (F.col("part") == F.col("main")) | (F.col("a") < F.col("h"))
        more = rest.join(crowded, "key").where((F.col("part") != F.col("a_part")) & once & near(F.col("sim"), F.col("a_sim")))
        more = cut_lineage(more.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct())
        parts = components(linked.unionByName(verify(more, first, docs, similarity)))
    return parts.select(F.col("node").alias("h"), "component")


def dropped(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key and pos of every line that goes."""
    found = cut_lineage(lines(docs, min_words))
    parts = groups(docs, found, similarity)
    named = found.select("doc_id", "text_key", "pos", "h").join(parts, "h", "left").withColumn("part", F.coalesce("component", "h"))
    stays = named.groupBy("part").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("stays"), F.count("*").alias("k")).where("k > 1")
    here = F.struct("doc_id", "text_key", "pos")
    return named.join(stays, "part").where(~here.eqNullSafe(F.col("stays"))).select("doc_id", "text_key", "pos")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the lines that go taken out of ``text``, and ``n_lines`` and ``n_dropped`` of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = dropped(rows, min_words, similarity)
    gone = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.collect_set("pos").alias("_gone"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    text = F.col("text").cast("string")
    same = (F.xxhash64(text) == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))
    out = docs.join(gone, same, "left")
    all_ = F.split(text, "\n")
    left = F.filter(all_, lambda x, k: ~F.array_contains("_gone", k))
    return out.select(
        *keep, F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(F.size(all_), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"),
    )
