"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them.

Equal vectors are first taken together, with their number. Each vector lives in the cell of its nearest centroid and
asks there and in every cell whose centroid is nearly as near, so that pairs across a border meet too. A cell's vectors
and its askers are cut into blocks; a task multiplies one block by another, and gives back not the pairs but each
vector's number of links and edges that tie what is linked, both no more than the block's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import components, least_hashed, written

#: Vectors that the centroids are fitted on (those with the least hash), and cells: so many for 10,000 vectors, and
#: otherwise as the root of the vectors' number, so that neither the cells that a vector asks nor their sizes run away.
SAMPLE, CELLS, MOST_CELLS = 20_000, 25, 4096
#: A vector also asks in cells whose centroid's cosine is less by no more than so many deviations of what two vectors at the
#: threshold differ by in a direction at random.
DEVIATIONS = 2.0
BLOCK = 1024


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on unit vectors; a cell that runs empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.permutation(len(sample))[: max(1, min(cells, len(sample)))]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centre)
    return centre


def margin_of(threshold: float, length: int) -> float:
    """Two unit vectors with a cosine of threshold lie sqrt(2 - 2 threshold) apart; along the line between two centroids, up
    to sqrt(2) long, the deviation of that is over the root of the length."""
    return DEVIATIONS * (2 * (2 - 2 * threshold) / length) ** 0.5


def units(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(x, np.float64) for x in column])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither squares of huge nor of tiny components leave the range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tie(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links of this product reach from each of its rows and columns."""
    high = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], high).min(axis=0))
        a2 = np.minimum(a, np.where(linked, b2[None, :], high).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def product(home: pd.DataFrame, ask: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(rep, links, tied) of one block of a cell's vectors and one of its askers.

    An asker counts what it finds; a found vector counts an asker that it doesn't find itself, in the asker's own cell.
    """
    none = pd.DataFrame({"rep": np.array([], np.int64), "links": np.array([], np.int64), "tied": np.array([], np.int64)})
    if not len(home) or not len(ask):
        return none
    h_id, q_id = home["rep"].to_numpy(np.int64), ask["rep"].to_numpy(np.int64)
    linked = units(ask["v"]) @ units(home["v"]).T >= threshold
    linked &= q_id[:, None] != h_id[None, :]
    qs, hs = linked.any(axis=1), linked.any(axis=0)
    if not qs.any():
        return none
    linked = linked[np.ix_(qs, hs)]
    ask, home, q_id, h_id = ask[qs], home[hs], q_id[qs], h_id[hs]
    q_n, h_n = ask["n"].to_numpy(np.int64), home["n"].to_numpy(np.int64)
    found = linked @ h_n
    at, place = np.unique(ask["cell_of"].to_numpy(np.int64), return_inverse=True)
    answers = np.stack([np.isin(at, np.asarray(cells, np.int64)) for cells in home["asks"]])  # home vector x cell of an asker
    one_way = linked & ~answers[:, place].T
    credited = q_n @ one_way
    a, b = tie(linked, q_id, h_id)
    return pd.DataFrame({"rep": np.concatenate([q_id, h_id]), "links": np.concatenate([found, credited]), "tied": np.concatenate([a, b])})


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", margin: float | None = None, cells: float = CELLS, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Cosines are computed in double precision. A vector that is null, empty or zero, or has null or non-finite components,
    links with nothing; neither do vectors of different lengths. Equal vectors link with each other. Rows without an id
    count as vectors, but a null is never a component's id unless nothing else is reachable; they are never kept
    unless alone in that. An empty table gives an empty result; other columns are ignored.
    """
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    fine = raw.withColumn("fine", finite & F.exists("v", lambda x: x != 0))
    rows = fine.withColumn("v", F.when(F.coalesce("fine", F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    # One row per distinct vector; ids stand in for vectors from here on, unnamed ones by a negative number.
    groups = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("named"), F.count(F.lit(1)).alias("n"))
    distinct = written(groups.select(F.coalesce("named", -F.abs(F.xxhash64("v")) - 1).alias("rep"), "named", "n", "v"), "vectors")
    shapes = {r.d: r["count"] for r in distinct.groupBy(F.size("v").alias("d")).count().collect()}
    parts = [within(distinct.where(F.size("v") == d), n, threshold, margin_of(threshold, d) if margin is None else margin, round(cells * (n / 10_000) ** 0.5), block, sample) for d, n in sorted(shapes.items())]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = written(found, "vector-links")
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        ties = components(found.where("rep != tied").select(F.col("rep").alias("a"), F.col("tied").alias("b")))
        least = ties.join(distinct.select(F.col("rep").alias("node"), "named"), "node").groupBy("component").agg(F.min("named").alias("component_id"))
        named = ties.join(least, "component").select(F.col("node").alias("rep"), "component_id")
        known = distinct.join(counts, "rep", "left").join(named, "rep", "left").select(
            "v", "named", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "named").alias("component_id")
        )
    else:
        known = distinct.select("v", "named", F.col("n").alias("n_links"), F.col("named").alias("component_id"))
    all_rows = rows.where("v IS NOT NULL").join(known, "v").select("vec_id", "n_links", "component_id").unionByName(
        rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return all_rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def within(distinct: DataFrame, n: int, threshold: float, margin: float, cells: int, block: int, sample: int) -> DataFrame:
    """(rep, links, tied) over all vectors (rep, n, v) of one length."""
    spark = distinct.sparkSession
    chosen = written(least_hashed(distinct.select("rep"), ["rep"], sample, n), "vector-sample")  # ids alone are sorted
    fitted = distinct.join(F.broadcast(chosen), "rep").select("rep", "v").toPandas().sort_values("rep")["v"]
    centre = centroids(units(fitted), min(MOST_CELLS, max(1, cells)))
    shared = spark.sparkContext.broadcast(centre)  # at most MOST_CELLS rows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = shared.value
        for batch in batches:
            if not len(batch):
                continue
            near = units(batch["v"]) @ centre.T
            best = near.argmax(axis=1)
            asks = near >= near.max(axis=1, keepdims=True) - margin
            yield batch.assign(cell_of=best.astype(np.int32), asks=[np.flatnonzero(x).astype(np.int32) for x in asks])

    cells = written(distinct.select("rep", "n", "v").mapInPandas(place, "rep long, n long, v array<double>, cell_of int, asks array<int>"), "vector-cells")
    sizes = cells.groupBy("cell_of").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    asked = cells.select(F.explode("asks").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("ask_blocks"))
    shape = sizes.join(asked, F.col("cell_of") == F.col("cell")).select("cell", "blocks", "ask_blocks")  # a row for each cell
    shape = F.broadcast(shape)
    mark = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(c)).cast("int")
    home = cells.withColumnRenamed("cell_of", "cell").join(shape, "cell").withColumn("i", mark("blocks", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)))
    ask = cells.select("rep", "n", "v", "cell_of", F.explode("asks").alias("cell")).join(shape, "cell").withColumn("j", mark("ask_blocks", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asker = ["ask_cell", "ask_i", "ask_j", "rep", "n", "v", "cell_of"]
    home = home.select("cell", "i", "j", "rep", "n", "v", "asks").groupBy("cell", "i", "j")
    ask = ask.select("cell", "i", "j", "rep", "n", "v", "cell_of").toDF(*[f"ask_{c}" for c in range(7)])
    pairs = home.cogroup(ask.groupBy("ask_0", "ask_1", "ask_2"))
    return pairs.applyInPandas(lambda h, q: product(h, q.set_axis(asker, axis=1), threshold), "rep long, links long, tied long")
