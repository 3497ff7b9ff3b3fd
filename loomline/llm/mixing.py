"""Mixing sources to target weights by temperature.

A source with share p of all tokens gets weight p ** a / Z. The exponent a is found by bisection, so that the weights'
entropy meets a target, or so far up that no source repeats more often than allowed. Weights are then realised within a
token budget: a source whose budget is k times its tokens and a rest gives k whole passes, each a permutation of its
documents in blocks, and of one more pass the first documents up to the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import free_name, written

#: Stands for a null source, which is a source of its own.
NO_SOURCE = "\x00none"
STEPS, ROUNDS = 16, 6


def words(text: str = "text") -> Column:
    """Tokens of a text: runs of characters other than white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def _figures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy and the largest weight-to-share ratio at each exponent, from one aggregation over the sources."""
    p = F.col("share")
    row = shares.agg(*[x for a in exponents for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1))))]).first()
    found = []
    for i, a in enumerate(exponents):
        z, zlog, most = row[3 * i : 3 * i + 3]
        found.append((math.log(z) - a * zlog / z, most / z))
    return found


def exponent(shares: DataFrame, entropy: float | None, most_passes: float | None, budget_ratio: float) -> float:
    """The exponent in [0, 1] for shares (share > 0): the one at which the entropy falls to `entropy` nats, raised, where
    most_passes needs it, to the one at which no source repeats more often. 1 keeps the shares as they are.

    Both figures fall as the exponent rises; each aggregation looks at STEPS points at once and keeps the interval
    between the last that is too flat and the first that isn't.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        flat = [
            (entropy is not None and h > entropy) or (most_passes is not None and ratio * budget_ratio > most_passes)
            for h, ratio in _figures(shares, points)
        ]
        first = next((i for i, bad in enumerate(flat) if not bad), STEPS)
        if first == 0:
            return low
        low, high = points[first - 1], points[first]
    return high


def plan(
    docs: DataFrame, entropy_share: float | None = 0.98, most_passes: float | None = 2.0, budget_ratio: float = 1.0, blocks: int = 1024, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(sources, cuts). sources: source, tokens, weight, whole (passes), rest (tokens of one more pass).
    cuts: source and the last place (block, order) of its permutation that the rest still takes.

    entropy_share: the target entropy as a share of that of equal weights. budget_ratio: tokens of the mixture as a
    multiple of the input's. The rest takes documents while the tokens before them are below it.
    """
    rows = placed(docs, blocks, seed).select("source_key", "block", "order", words().alias("tokens"))
    sums = written(rows.groupBy("source_key", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = sums.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))
    whole = sources.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).first()
    total, n = whole[0] or 0, whole[1] or 0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    a = exponent(shares, entropy_share * math.log(n) if entropy_share is not None else None, most_passes, budget_ratio) if n > 1 else 1.0
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    power = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a))).otherwise(0.0)
    z = (shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] if n else None) or 1.0
    weighed = sources.withColumn("weight", power / F.lit(z)).withColumn("quota", F.col("weight") * F.lit(budget_ratio * total))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)) + F.lit(1e-9))).otherwise(F.lit(1)).cast("int")
    weighed = weighed.withColumn("whole", passes).withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
    sources = written(weighed.select("source_key", "tokens", "weight", "whole", "rest"), "mix-sources")
    before = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("source_key", "block", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("ahead"))
    open_ = F.col("rest") > F.lit(0.5)
    cut = ahead.join(sources.select("source_key", "rest"), "source_key").where(open_ & (F.col("ahead") < F.col("rest")))
    cut = written(cut.groupBy("source_key").agg(F.max_by(F.struct("block", "ahead", "rest"), "block").alias("c")).select("source_key", "c.*"), "mix-cut")
    inside = rows.join(cut, ["source_key", "block"])
    so_far = Window.partitionBy("source_key", "block").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("before", F.col("ahead") + F.coalesce(F.sum("tokens").over(so_far), F.lit(0))).where("before < rest")
    last = taken.groupBy("source_key").agg(F.max("order").alias("cut_order"))
    return sources, written(cut.select("source_key", F.col("block").alias("cut_block")).join(last, "source_key"), "mix-cuts")


def placed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """docs with source_key, the block of the permutation that a document falls in, and its order there."""
    place = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return docs.withColumns(
        {"source_key": F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)), "order": place, "block": F.pmod(F.shiftright(place, 20), F.lit(blocks)).cast("int")}
    )


def mix(docs: DataFrame, entropy_share: float | None = 0.98, most_passes: float | None = 2.0, budget_ratio: float = 1.0, blocks: int = 1024, seed: int = 17) -> DataFrame:
    """docs' rows as often as the mixture takes them, with all columns of docs and pass (int, from 0), mix_block, mix_order,
    weight.

    docs needs doc_id, text and source. A null source is one of its own; a source without any token gives each of its
    rows once and has weight zero. Equal rows have the same place and are taken together. An empty table gives an empty
    result. An added column whose name docs already has gets underscores to it.
    """
    sources, cuts = plan(docs.select("doc_id", "text", "source"), entropy_share, most_passes, budget_ratio, blocks, seed)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"), F.col("source"))
    found = placed(row, blocks, seed).drop("doc_id", "text", "source").join(sources.select("source_key", "weight", "whole"), "source_key").join(cuts, "source_key", "left")
    # Blocks before the cut are taken whole; in the cut block the order decides.
    more = (F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & (F.col("order") <= F.col("cut_order")))
    copies = F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")
    each = found.where(copies > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), copies - 1)))
    added = {"pass": F.col("pass"), "mix_block": F.col("block"), "mix_order": F.xxhash64("order", "pass"), "weight": F.col("weight")}
    return each.select("row.*", *[x.alias(free_name(docs, name)) for name, x in added.items()])


def in_place(docs: DataFrame, blocks: int = 1024, seed: int = 17) -> tuple[DataFrame, list[str]]:
    """Rows of a mixture with the columns that sort them into its order, and these columns' names: pass, block and order,
    worked out again for a table of the mixture's rows that has none of them.

    Of rows equal in id and text, which are as few as the mixture's passes, each belongs to one pass.
    """
    names = [free_name(docs, x) for x in ("mix_pass", "mix_block", "mix_order")]
    place = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    turn = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))) - 1
    numbered = docs.withColumn(names[0], turn)
    found = numbered.withColumns({names[1]: F.pmod(F.shiftright(place, 20), F.lit(blocks)).cast("int"), names[2]: F.xxhash64(place, names[0])})
    return found, names
