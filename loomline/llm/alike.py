"""Groups of sets that are alike, from buckets of which every pair of alike sets shares one.

Comparing all pairs of a bucket grows with its square. Here rounds come first: in each bucket whose holders aren't yet in
one group, holders are compared with the bucket's first one, and of all the firsts that a set meets only with the one it
shares most buckets with. What a round verifies joins groups, and buckets whose holders have met are closed. Once rounds
find little, the pairs that are left in open buckets, those across groups, are compared, so that no link goes unseen. Bitmaps of the sets, which bound how
much two of them differ, keep nearly all pairs that aren't alike from becoming rows there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import components, dropped, written


def near_size(m: Column, n: Column, least: float) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * least - 1e-9


#: Words of 64 bits in a set's bitmap.
WORDS = 32


def set_bits(own: np.ndarray) -> np.ndarray:
    """A set's bitmap: which of its places an odd number of members falls into. Two bitmaps differ in no more places than
    their sets have members that the other lacks."""
    odd = (np.bincount(own.view("<u4") % (64 * WORDS), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def may_be_alike(m: Column, n: Column, of_a: list[str], of_b: list[str], least: float) -> Column:
    """False only for sets of m and n members that their bitmaps show to be less alike: similarity is (m + n - d) /
    (m + n + d) with d members that one of them lacks."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(of_a, of_b, strict=True)), F.lit(0))
    return (m + n) * (1 - least) + 1e-9 >= differ * (1 + least)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) whose sets (sig, own, bits) have a Jaccard similarity of at least `least`."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("own").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = both * (1 + least) >= (F.size("of_a") + F.size("of_b")) * least - 1e-9
    return written(pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select(*pairs.columns), "alike")


def shared_only(held: DataFrame) -> DataFrame:
    """Rows (h, sig, n, at) of buckets h that hold more than one sig; a sig is in a bucket once."""
    more = held.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("h")
    return written(held.join(more, "h"), "shared-buckets")


def _joined(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """rest (h, sig, n, at, group) with the groups joined that edges (ga, gb) connect, without buckets in one group."""
    named = components(edges, "ga", "gb").select(F.col("node").alias("group"), "component")
    rows = rest.join(named, "group", "left").select("h", "sig", "n", "at", F.coalesce("component", "group").alias("group"))
    mixed = rows.groupBy("h").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("h")
    return written(rows.join(mixed, "h"), "open-buckets")


def links(held: DataFrame, sets: DataFrame, least: float, pairs: DataFrame | None = None, little: float = 0.02, ordered: bool = True) -> DataFrame:
    """Verified pairs (a, b), a written table, that connect all that alike pairs sharing a bucket do.

    held: (h, sig, n, at), n the size of the set sig and, where buckets are its members in one order for all sets (ordered), at
    the bucket's place in it, from shared_only. sets: (sig, own, bits) of all sigs. pairs: candidates (a, b) known before, verified first. A round that
    joins fewer than the share `little` of the open sets is the last.
    """
    empty = held.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    tested = written(pairs if pairs is not None else empty, "pairs")
    alike = verified(tested, sets, least)
    rest = _joined(held.withColumn("group", F.col("sig")), alike.select(F.col("a").alias("ga"), F.col("b").alias("gb")))
    while True:
        firsts = rest.groupBy("h").agg(F.min(F.struct("sig", "n", "group")).alias("first"))
        met = rest.join(firsts, "h").where((F.col("group") != F.col("first.group")) & near_size(F.col("n"), F.col("first.n"), least))
        met = met.groupBy(F.col("first.sig").alias("a"), F.col("sig").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.first("first.group").alias("ga"), F.first("group").alias("gb"))
        met = met.join(tested, ["a", "b"], "left_anti")
        best = written(met.groupBy("b").agg(F.max(F.struct("times", "a", "ga", "gb")).alias("with")).select("with.a", "b", "with.ga", "with.gb"), "pairs")
        tested = tested.unionByName(best.select("a", "b"))
        found = verified(best, sets, least)
        alike = alike.unionByName(found.select("a", "b"))
        joined, open_ = found.count(), rest.select("sig").distinct().count()
        if joined:
            before, rest = rest, _joined(rest, found.select("ga", "gb"))
            dropped(before)
        if joined <= little * open_:
            break
    # Of the open buckets that two sets share only the first gives a row for them; a set is in no more than its own number.
    opened = rest.groupBy("sig").agg(F.collect_list("h").alias("open"))
    flat = written(sets.join(opened, "sig").select("sig", "open", *[F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(WORDS)]), "open-sets")
    bits = lambda c: [f"{c}{i}" for i in range(WORDS)]
    side = lambda c: flat.select(F.col("sig").alias(c), F.col("open").alias(f"open_{c}"), *[F.col(f"w{i}").alias(f"{c}{i}") for i in range(WORDS)])
    end = lambda c: rest.select("h", F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("at").alias(f"at_{c}"), F.col("group").alias(f"group_{c}")).join(side(c), c)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    # What two ordered sets share is at most all before the bucket, in the shorter way there, and all from it on.
    most = F.least("at_a", "at_b") + F.least(n_a - F.col("at_a"), n_b - F.col("at_b"))
    placed = (most * (1 + least) >= (n_a + n_b) * least - 1e-9) if ordered else F.lit(True)
    near = near_size(n_a, n_b, least) & placed & may_be_alike(n_a, n_b, bits("a"), bits("b"), least)
    first = F.array_min(F.array_intersect("open_a", "open_b")) == F.col("h")
    last = end("a").join(end("b"), "h").where((F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b")) & near & first).select("a", "b")
    last = written(last.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "last-pairs")
    whole = written(alike.unionByName(verified(last, sets, least)), "links")
    dropped(rest, last, flat)
    return whole
