"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards only; one more shard takes rows only into itself, about one in
n + 1 of them. No ring table is kept: a task computes the shard of a whole Arrow batch of keys at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key by jump consistent hashing (Lamping and Veach, 2014)."""
    keys = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    landed = np.zeros(len(keys), np.float64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = landed[live].astype(np.int64)
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        landed[live] = np.floor((shard[live] + 1) * step)
        live = live[landed[live] < shards]
    return shard


def with_shards(df: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """df with a shard column for each (name, number of shards) of counts; key is a column of hashed 64-bit keys."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[key].to_numpy(np.int64).view(np.uint64)
            yield batch.assign(**{name: jump(keys, n).astype(np.int32) for name, n in counts.items()})

    extra = ", ".join(f"`{name}` int" for name in counts)
    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(each, f"{known}, {extra}")


def assign(docs: DataFrame, shards: int = 16, buckets: int = 1024) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus 1 (a null text has none; its checksum is that of no bytes). grown_shard is the
    shard that one more would give. Slots number a shard's rows from 0 without gaps: rows are spread over `buckets`
    buckets by a hash of id and checksum, so that a shard is counted in as many parts; buckets follow each other, and
    within one the order is doc_id, checksum, size. Rows without an id share a shard, and rows that repeat an id are in
    the same one; equal rows get slots in any order. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).select("*", F.xxhash64("doc_id").alias("key"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    placed = with_shards(narrow, "key", {"shard": shards, "grown_shard": shards + 1})
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("nth", F.row_number().over(within))
    return ranked.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )
