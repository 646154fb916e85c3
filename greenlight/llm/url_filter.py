"""URL rules by host and path prefix: a blocked Bloom filter in front of an exact hash join.

A rule is a canonical ``host/path`` with a verdict. It fits a url whose host is the rule's or below it and
whose path starts with the rule's; the longest rule that fits decides. Listed keys set one bit in each of
the eight 32-bit words of one block, so a probe touches one block. The filter's size follows the list up to
``max_bytes``, which bounds the broadcast; a fuller filter only lets more keys through to the exact join,
which removes every false positive. Urls without a possible hit get the default at once and meet neither the join nor
a shuffle.

Defined results
- A null url and one without ``://`` have empty host and path; no rule with a path fits them.
- Urls of any length are judged whole.
- Rules with a null host, path or verdict are left out; of rules with the same key, ``block`` wins.
- Repeated rows are judged row by row; extra columns are ignored. An empty list gives ``default`` to all.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 16 << 20
BITS_PER_KEY = 16
WORDS = 8
#: One odd multiplier for each word of a block, by rule: powers of an odd constant.
SALT = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(1, WORDS + 1)], dtype=np.uint32)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def block_and_masks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash (upper half) and the bit it sets in each word (lower half)."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = (h.astype(np.uint32)[:, None] * SALT[None, :]) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def build_filter(keys: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of a table of ``hash`` (long), as an array of blocks by words. Each task ors its keys, and the
    driver gets at most ``max_bytes``."""
    count = keys.count()
    most = max(1, max_bytes // (4 * WORDS))
    blocks = min(most, 1 << max(0, (max(1, count) * BITS_PER_KEY // (32 * WORDS)).bit_length()))

    def setting(batches):
        for batch in batches:
            block, masks = block_and_masks(batch.column("hash").to_numpy(zero_copy_only=False), blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block)] + [pa.array(masks[:, k].astype(np.int64)) for k in range(WORDS)], ["block"] + [f"w{k}" for k in range(WORDS)]
            )

    names = [f"w{k}" for k in range(WORDS)]
    bits = keys.select("hash").mapInArrow(setting, "block long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((blocks, WORDS), np.uint32)
    for row in bits.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toLocalIterator():
        out[row["block"]] = [row[n] for n in names]
    return out


def maybe_contains(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, masks = block_and_masks(hashes, len(bloom))
    return ((bloom[block] & masks) == masks).all(axis=1)


def _prune(shared):
    """Keep, in each row's list of keys, those that the filter may hold."""

    def prune(batches):
        bloom = shared.value
        for batch in batches:
            lists, hashes = batch.column("keys"), batch.column("hashes")
            keep = maybe_contains(bloom, hashes.flatten().to_numpy(zero_copy_only=False)) if len(hashes.flatten()) else np.zeros(0, bool)
            lengths = np.diff(lists.offsets.to_numpy())
            kept = np.add.reduceat(np.append(keep, False).astype(np.int64), np.cumsum(lengths) - lengths) * (lengths > 0) if len(lengths) else lengths
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            pruned = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.flatten().filter(pa.array(keep)))
            columns = {n: batch.column(n) for n in ("page_id", "host", "path")} | {"keys": pruned}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return prune


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; ``rules`` has host, path and verdict.

    The lookup keys of a url are its host's last labels with its path's first characters, for each pair of
    label count and path length that the list has; these pairs are what the driver learns of the list.
    """
    spark = pages.sparkSession
    listed = (
        rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        .groupBy(F.concat("host", "path").alias("key"))
        .agg(F.max("verdict").alias("verdict"), F.first("host").alias("host"), F.first("path").alias("path"))
    )
    shapes = [
        (r["labels"], r["chars"])
        for r in listed.select((F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels"), F.length("path").alias("chars"))
        .distinct().toLocalIterator()
    ]
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    missed = lambda rows: rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not shapes:
        return missed(rows)
    shared = spark.sparkContext.broadcast(build_filter(listed.select(F.xxhash64("key").alias("hash")), max_bytes))
    pairs = F.array(*(F.struct(F.lit(-j).alias("labels"), F.lit(n).alias("chars")) for j, n in sorted(shapes)))
    cut = lambda s: F.concat(F.call_function("substring_index", "host", F.lit("."), s["labels"]), F.call_function("substring", "path", F.lit(1), s["chars"]))
    rows = rows.withColumn("keys", F.array_distinct(F.transform(pairs, cut))).withColumn("hashes", F.transform("keys", lambda key: F.xxhash64(key)))
    rows = rows.mapInArrow(_prune(shared), "page_id long, host string, path string, keys array<string>")
    hits = rows.where(F.size("keys") > 0).groupBy("page_id", "host", "path", "keys").agg(F.count("*").alias("n"))
    possible = hits.select("page_id", "host", "path", "n", F.explode("keys").alias("key"))
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("size"), F.col("key").alias("rule"), "verdict"))).alias("best")
    found = possible.join(listed.select("key", "verdict"), "key", "left").groupBy("page_id", "host", "path", "n").agg(best)
    found = found.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
    return missed(rows.where(F.size("keys") == 0)).unionByName(found)
