"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

Fingerprints are computed by Spark tasks over Arrow batches. Links come from a join of probes with tables: each
fingerprint is cut into segments, the small Hamming ball around each segment's value is enumerated, the table of
that segment is asked for each value, and complete distances are verified. Segments whose table holds many
fingerprints under one value (large groups of near copies) leave that join: two fingerprints lie within 2r bits
exactly if their balls of radius r meet, so there each fingerprint emits the points of its ball and the
fingerprints that share a point are tied together, which is linear in their number.

Where similarity of shingle sets is what counts, fingerprints only find the nearest candidates: at 0.8 on five words
they differ by up to a dozen bits. The others are found by shared shingles (prefix filter), which misses none, and all
are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import alike
from loomline.llm.shared import components, dropped, small_batches, written

SEED = 42
BITS = 64


def hashed(text: str | None, words: int) -> np.ndarray:
    """A hash of each of the text's word shingles; a shorter text is one shingle, a text without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(parts), len(parts)
    k = min(words, n)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), "<u8", n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that most hashes have, as a signed 64-bit integer; zero without hashes."""
    ones, total = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, total, 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer; zero for a text without words."""
    return majority(hashed(text, words))


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [fingerprint(x, words) for x in batch["text"]]})

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInPandas(each, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All values of the given width with at most radius bits set."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(width), r)]


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of two segments: if two fingerprints differ in at most radius bits, then the first
    segment differs in at most its radius or the second in at most its own, since both larger makes radius + 1."""
    high = (radius - 1 + 1) // 2 if radius else 0
    low = max(radius - 1 - high, 0)
    return [(32, 32, high), (0, 32, low)] if radius else [(0, 32, 0)]


def links(nodes: DataFrame, radius: int = 2, hot: int = 64) -> DataFrame:
    """(a, b) between the reps of nodes (fp, rep) whose fingerprints differ in at most radius bits.

    nodes has one row per distinct fingerprint. Pairs under one segment value are compared only where at most `hot`
    fingerprints have that value; all others get tied through shared points, so the connectivity is that of all
    pairs, with fewer rows than pairs.
    """
    if radius > 8:
        raise ValueError("balls of that size aren't small")
    value = lambda shift: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
    table = nodes.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), value(shift).alias("value")) for i, (shift, _, _) in enumerate(segments(radius))])).alias("s"), "fp", "rep"
    ).select("s.seg", "s.value", "fp", "rep")
    probes = None
    for i, (shift, width, r) in enumerate(segments(radius)):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, r)])
        part = nodes.select(F.lit(i).alias("seg"), F.explode(masks).alias("mask"), "fp", "rep").select(
            "seg", value(shift).bitwiseXOR(F.col("mask")).alias("value"), "fp", "rep"
        )
        probes = part if probes is None else probes.unionByName(part)
    crowded = written(table.groupBy("seg", "value").count().where(F.col("count") > hot).select("seg", "value"), "crowded")
    calm = table.join(crowded, ["seg", "value"], "left_anti").select("seg", "value", F.col("fp").alias("other"), F.col("rep").alias("b"))
    pairs = (
        probes.join(calm, ["seg", "value"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
        .select(F.col("rep").alias("a"), "b")
    )
    asking = probes.join(crowded, ["seg", "value"], "left_semi").select("fp", "rep").distinct()
    return pairs.unionByName(tied(asking, radius)).distinct()


def tied(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) that tie all nodes (fp, rep) within radius bits: a ball of half the radius around each meets another's.

    For an odd radius the balls of half of it, rounded up, meet up to one bit too far; there each pair that shares a
    point is verified. A point's group is bounded: only so many fingerprints lie that near to it.
    """
    half = (radius + 1) // 2
    points = nodes.select(
        F.explode(F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in ball(BITS, half)])).alias("mask"), "fp", "rep"
    ).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp", "rep")
    if radius % 2 == 0:
        least = points.groupBy("point").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a != last").select("point", "a")
        return points.join(least, "point").where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    other = points.select("point", F.col("fp").alias("other"), F.col("rep").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    return points.join(other, "point").where((F.col("fp") < F.col("other")) & near).select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most radius bits reach.

    Null and empty texts have fingerprint zero and link like any other. Documents without an id take part, but a null
    is never a component's id unless all its documents lack one. Repeated ids stay repeated rows. An empty table gives
    an empty result. Columns besides the two named are ignored.
    """
    prints = written(fingerprints(docs, words, doc_id, text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius))
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Counters of the sketch and rows that it travels in.
SLOTS, CHUNKS = 1 << 22, 64


def shingle_counts(rows: DataFrame, words: int, slots: int = SLOTS) -> np.ndarray:
    """How many of all documents have a shingle that falls into each of `slots` counters, a number fixed beforehand: at
    least as many as have any one of them. Tasks count their own texts, counters are added up."""
    size = slots // CHUNKS

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for text in batch["text"]:
                at, times = np.unique(np.unique(hashed(text, words)) % np.uint64(slots), return_counts=True)
                counts[at] += times.astype(np.uint32)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1)
            yield pd.DataFrame({"chunk": range(CHUNKS), "data": [pack.compress(x.tobytes()) for x in counts.reshape(CHUNKS, size)]})

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total, unpack = np.zeros(size, np.uint32), zstandard.ZstdDecompressor()
        for data in parts["data"]:
            total += np.frombuffer(unpack.decompress(data), np.uint32)
        return pd.DataFrame({"chunk": [int(key[0])], "data": [total.tobytes()]})

    found = np.zeros((CHUNKS, size), np.uint32)
    for row in rows.select("text").mapInPandas(each, "chunk int, data binary").groupBy("chunk").applyInPandas(added, "chunk int, data binary").collect():  # 16 MB
        found[row.chunk] = np.frombuffer(row.data, np.uint32)
    return found.reshape(-1)


def shingle_rows(rows: DataFrame, words: int, least: float) -> DataFrame:
    """(key, sig, fp, n, prefix) of rows (key, text): sig names the set of n distinct shingles, prefix has so many of its
    first ones, rare before common, that two sets with a similarity of `least` share one of them."""
    counts = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, words))  # of fixed size

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counts.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                hashes = hashed(text, words)
                own = np.unique(hashes)
                n = len(own)
                length = n - math.ceil(least * n - 1e-9) + 1 if n else 0
                sig = xxhash.xxh64_intdigest(own.tobytes(), SEED) if n else 0
                first = own[np.lexsort((own, known[own % np.uint64(len(known))]))[:length]].view("<i8")
                out.append((sig - (1 << 64) if sig >> 63 else sig, majority(hashes), n, first))
            sigs, prints, sizes, prefixes = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"key": batch["key"], "sig": list(sigs), "fp": list(prints), "n": list(sizes), "prefix": list(prefixes)})

    return rows.select("key", "text").mapInPandas(each, "key long, sig long, fp long, n int, prefix array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sig, own, bits) of texts (sig, text). Shingles travel as 32 bits of their hashes: within two sets hardly any two of
    these coincide."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique((hashed(t, words) >> np.uint64(32)).astype("<u4")).view("<i4") for t in batch["text"]]
            yield pd.DataFrame({"sig": batch["sig"], "own": own, "bits": [alike.set_bits(x) for x in own]})

    return texts.select("sig", "text").mapInPandas(each, "sig long, own array<int>, bits array<long>")


def similar_groups(rows: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """(key, group) of rows (key, text): what links of shingle similarity `least` or more connect, all of them.

    The first candidates are what multi-index hashing finds within radius bits. Alike texts may differ by more bits, so the
    holders of each shingle of a prefix, rarest first by the counts of all documents, follow in rounds: the exact
    complement that misses none. Every link is verified on whole texts.
    """
    small_batches(rows.sparkSession)
    prints = written(shingle_rows(rows, words, least), "shingles")
    nodes = written(prints.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("fp").alias("fp"), F.first("n").alias("n")), "nodes")
    prefixes = prints.select("key", "prefix").join(nodes.select("key", "sig", "n"), "key").dropDuplicates(["key"])
    held = alike.shared_only(prefixes.select("sig", "n", F.posexplode("prefix").alias("at", "h")).select("h", "sig", "n", "at"))
    by_print = nodes.groupBy("fp").agg(F.min("sig").alias("rep"))
    found = links(by_print, radius).unionByName(nodes.join(by_print, "fp").where("sig <> rep").select(F.col("rep").alias("a"), F.col("sig").alias("b")))
    found = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-prints")
    ends = held.select("sig").unionByName(found.select(F.explode(F.array("a", "b")).alias("sig"))).distinct()
    texts = rows.join(nodes.join(ends, "sig").select("sig", "key"), "key").select("sig", "text").dropDuplicates(["sig"])
    sets = written(shingle_sets(texts, words), "shingle-sets")
    whole = written(components(alike.links(held, sets, least, found)), "groups")
    groups = written(prints.join(whole, F.col("sig") == F.col("node"), "left").select("key", F.coalesce("component", "sig").alias("group")), "similar")
    dropped(prints, nodes, held, found, sets, whole)
    return groups


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without all but one document of each group of similar ones: the one with the smallest (doc_id, key), null ids
    last.

    A row's key is the hash of its id and text, so rows that share an id, or have none, are documents of their own;
    only rows equal in both are the same document, of which one stays. Texts without words are one group.
    """
    return chosen(docs, similar_groups(docs.select(row_key().alias("key"), "text"), words, least))


def row_key() -> Column:
    """Nulls are told apart from all values, which the hash alone would pass over."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def chosen(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first row of docs in each group (key, group)."""
    ids = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("id")).distinct().join(groups.distinct(), "key")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("row"))
    stay = written(first.select(F.col("row.key").alias("stay_key")), "stay")
    once = docs.withColumn("stay_key", row_key()).join(stay, "stay_key", "left_semi")
    return once.dropDuplicates(["stay_key"]).select(*docs.columns)
