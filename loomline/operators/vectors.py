"""Vectors of sessions: similarity, decomposition, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import selection
from loomline.operators.iterate import settled

LOWEST, HIGHEST, FALLBACK = 0.3, 0.9, 0.7
#: Rows of a tile of a blocked product, and clusters that one task merges in the end.
ROWS, FINISH = 1024, 16384
#: Blocks of a blocked product, rows that a block of a small table has, and rows beyond which there are more blocks.
BLOCKS, SMALLEST, WIDEST = 16, 128, 65536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors in double precision over their length; null, empty and zero ones left out."""
    rows = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def dealt(vectors: DataFrame) -> DataFrame:
    """The vectors with their block, own, once for each pair of blocks (i, j), i <= j, that it's one of. There are BLOCKS
    blocks, so copies grow no faster than the rows; fewer for small tables, more where a block would pass WIDEST rows."""
    n = vectors.count()
    blocks = max(min(BLOCKS, -(-n // SMALLEST)), -(-n // WIDEST), 1)
    marked = vectors.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    each = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def block_products(vectors: DataFrame, each: Callable, schema: str, rows: int = ROWS, fold: Callable | None = None) -> DataFrame:
    """each(left, right, products) for tiles of `rows` rows of every pair of blocks: their rows in order of ids, and all
    products of two different rows, each pair of rows once in all; others are nan. What a pair of blocks gives goes through
    fold, if any, in one frame, else tile by tile. Blocked matrix products over Arrow batches."""

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches)).sort_values("id")  # two blocks
        a, b = held[held["own"] == held["i"]], held[held["own"] == held["j"]]
        if not len(a) or not len(b):
            return
        same = bool(held["i"].iat[0] == held["j"].iat[0])
        left = np.stack(a["v"].to_numpy())
        right = left if same else np.stack(b["v"].to_numpy())
        out = []
        for s in range(0, len(a), rows):
            for t in range(s if same else 0, len(b), rows):
                found = left[s : s + rows] @ right[t : t + rows].T
                if same and s == t:
                    found[np.tril_indices(len(found))] = np.nan
                tile = each(a.iloc[s : s + rows], b.iloc[t : t + rows], found)
                if fold is None:
                    yield tile
                else:
                    out.append(tile)
        if out:
            yield fold(pd.concat(out))

    return dealt(vectors).groupBy("i", "j").applyInPandas(of_blocks, schema)


def pairs(vectors: DataFrame, least: float | None = None, rows: int = ROWS) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of unit vectors (id, v), or those of a cosine of `least` or more; with a column
    part, of those of one part. Work grows with the square of the rows, output only with what is asked for."""
    kind, parted = dict(vectors.dtypes)["id"], "part" in vectors.columns

    def each(a, b, found):
        keep = ~np.isnan(found) if least is None else found >= least
        if parted and len(a):
            keep &= a["part"].to_numpy()[:, None] == b["part"].to_numpy()[None, :]
        x, y = np.nonzero(keep)
        x, y, cosine = a["id"].to_numpy()[x], b["id"].to_numpy()[y], found[x, y]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": cosine})

    return block_products(vectors, each, f"a {kind}, b {kind}, cosine double", rows)


def similar(vectors: DataFrame, least: float) -> DataFrame:
    return pairs(vectors, least)


def near_pairs(vectors: DataFrame, least: float, cells: int, reach: float = 1.0, rows: int = ROWS) -> DataFrame:
    """(a, b, cosine) of the pairs a < b of unit vectors (id, v) of a cosine of `least` or more, from an index of `cells` cells
    instead of all blocks; for tables whose square is too much work.

    Cells are those of vectors of least hash; each vector lives in the nearest's. A vector within an angle t of another
    lies within that one's angle to its centre and t of the centre, so it asks the cells whose widest member leaves that
    possible: with reach 1 no pair is missed. A smaller reach takes that share of the widest angle, asks fewer cells and may
    miss pairs. A cell with many members is dealt to several tasks. Work grows with the rows times what a cell and those
    near to it hold, so cells should grow with the rows; vectors that lie evenly in many dimensions ask nearly all cells.
    """
    kind, spark = dict(vectors.dtypes)["id"], vectors.sparkSession
    picked = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(cells).collect()  # so many vectors
    if not picked:
        return spark.createDataFrame([], f"a {kind}, b {kind}, cosine double")
    shared = spark.sparkContext.broadcast(np.stack([np.asarray(r.v, float) for r in sorted(picked, key=lambda r: str(r.id))]))
    angles = lambda batch: np.arccos(np.clip(np.stack(batch["v"].to_numpy()) @ shared.value.T, -1, 1))
    most = float(np.arccos(np.clip(least, -1, 1)))

    def homes(batches):
        for batch in batches:
            if len(batch):
                found = angles(batch)
                yield batch.assign(cell=found.argmin(axis=1), angle=found.min(axis=1))

    home = settled(vectors.select("id", "v").mapInPandas(homes, f"id {kind}, v array<double>, cell int, angle double"))
    sizes = {r.cell: (r.wide, r.n) for r in home.groupBy("cell").agg(F.max("angle").alias("wide"), F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    wide = np.array([sizes[c][0] * reach if c in sizes else -np.inf for c in range(len(picked))])
    parts = {c: -(-n // rows) for c, (_, n) in sizes.items()}

    def asked(batches):
        for batch in batches:
            if len(batch):
                row, cell = np.nonzero(angles(batch) <= wide + most + 1e-9)
                count = np.array([parts[c] for c in cell.tolist()], int)
                each = np.repeat(np.arange(len(cell)), count)
                part = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                yield pd.DataFrame({"id": batch["id"].to_numpy()[row[each]], "v": batch["v"].to_numpy()[row[each]], "cell": cell[each], "part": part})

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left["id"].iloc[:0], "b": left["id"].iloc[:0], "cosine": np.zeros(0)})
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        held, out = np.stack(left["v"].to_numpy()), []
        for at in range(0, len(y), rows):
            found = held @ np.stack(right["v"].iloc[at : at + rows].to_numpy()).T
            i, j = np.nonzero((found >= least) & (x[:, None] < y[None, at : at + rows]))
            out.append(pd.DataFrame({"a": x[i], "b": y[at + j], "cosine": found[i, j]}))
        return pd.concat(out)

    counts = spark.createDataFrame([(c, n) for c, n in parts.items()], "cell int, parts int")
    dealt_out = home.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asking = vectors.select("id", "v").mapInPandas(asked, f"id {kind}, v array<double>, cell int, part int").toDF("id", "v", "at_cell", "at_part")
    return dealt_out.select("id", "v", "cell", "part").groupBy("cell", "part").cogroup(asking.groupBy("at_cell", "at_part")).applyInPandas(met, f"a {kind}, b {kind}, cosine double")


def centroid_similarity(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, cosine) of the groups' mean vectors; groups: (id, group)."""
    dims = vectors.join(groups, "id").select("group", F.posexplode("v").alias("dim", "x")).groupBy("group", "dim").agg(F.avg("x").alias("x"))
    means = dims.groupBy(F.col("group").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("v"))
    return pairs(unit_vectors(means, "id", "v"))


def dendrogram(vectors: DataFrame, finish: int = FINISH) -> DataFrame:
    """(height, a, b) of every merge of average linkage over unit vectors (id, v), and within each part where they have one.
    The distance is one less the cosine.

    A cluster carries the sum of its vectors: the mean cosine between two clusters is the product of their sums over that
    of their sizes, so no pairs are kept. Equal vectors merge first. All clusters that are each other's nearest merge in one
    round; average linkage is reducible, so the merges are those of the one-by-one loop, and a mean distance to merged clusters
    is no less than the least of theirs, so only new clusters and those whose nearest has gone look for their nearest again.
    At most `finish` clusters that are left merge in one task, without a job for each round. A cluster is named by its least member; of equal distances the least names count first.
    """
    part = F.col("part") if "part" in vectors.columns else F.lit(0)
    rows = vectors.select("id", "v", part.alias("part"))
    alike = settled(rows.withColumn("c", F.min("id").over(Window.partitionBy("part", "v"))))
    kind = dict(rows.dtypes)["id"]
    schema = f"height double, a {kind}, b {kind}"
    merges = alike.where("id <> c").select(F.lit(0.0).alias("height"), F.col("c").alias("a"), F.col("id").alias("b"))
    size = F.count(F.lit(1))
    clusters = settled(alike.groupBy(F.col("c").alias("id"), "part").agg(size.cast("double").alias("n"), F.first("v").alias("v")))
    near = None
    while clusters.count() > finish:
        asking = clusters.withColumn("asks", F.lit(True)) if near is None else clusters.join(near.select("id", F.lit(False).alias("asks")), "id", "left").fillna(True, ["asks"])
        found = nearest(asking, kind)
        near = settled(found if near is None else near.unionByName(found))
        mutual = settled(near.groupBy("l", "g").agg(F.count(F.lit(1)).alias("both"), F.min("dist").alias("dist")).where("both = 2").select("dist", "l", "g"))
        if mutual.isEmpty():
            mutual = settled(near.select("dist", "l", "g").orderBy("dist", "l", "g").limit(1))  # rounding made a ring of equals
        if mutual.isEmpty():  # nothing is left to merge within any part
            return merges
        merges = merges.unionByName(mutual.select(F.col("dist").alias("height"), F.col("l").alias("a"), F.col("g").alias("b")))
        gone = mutual.select(F.col("l").alias("id"), F.col("g").alias("other"))
        more = clusters.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("v").alias("w"))
        share = F.col("m") / (F.col("n") + F.col("m"))
        met = gone.join(clusters, "id").join(more, "other").withColumn("share", share)
        mean = F.zip_with("v", "w", lambda x, y: x + (y - x) * F.col("share"))
        grown = met.withColumn("mean", mean).withColumn("both", F.col("n") + F.col("m")).select("id", "part", F.col("both").alias("n"), F.col("mean").alias("v"))
        used = gone.select("id").unionByName(gone.select(F.col("other").alias("id")))
        clusters = settled(clusters.join(used, "id", "left_anti").unionByName(grown))
        for end in ("l", "g"):  # one of which is the row's own
            near = near.join(used.withColumnRenamed("id", end), end, "left_anti")
    last = clusters.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(rest_merged, schema)
    return merges.unionByName(settled(last))


def pruned_dendrogram(near: DataFrame) -> DataFrame:
    """(height, a, b) of every merge of average linkage where only the pairs near (a, b, cosine), a < b, of a cosine of 0 or
    more are known: a pair that isn't has distance 1 in averages, and clusters without any known pair never merge.

    Clusters keep a row for each other one that they have a known pair with: the sum and the number of known distances.
    Both add up when clusters merge, so a round costs what is left of the pairs, not the square of the clusters. With
    distances of at most 1 merging never brings others nearer, so all clusters that are each other's nearest merge in one
    round, as one by one. Names and ties as in dendrogram; where all pairs are known so are the merges.
    """
    edges = settled(near.select("a", "b", (1 - F.col("cosine")).alias("sum"), F.lit(1.0).alias("known")))
    ends = F.explode(F.array("a", "b")).alias("id")
    sizes = settled(edges.select(ends).distinct().withColumn("n", F.lit(1.0)))
    merges = None
    while True:
        side = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))  # noqa: B023, E731
        pairs_of = F.col("n_a") * F.col("n_b")
        dist = F.round((F.col("sum") + pairs_of - F.col("known")) / pairs_of, 12)
        told = edges.join(side("a"), "a").join(side("b"), "b").withColumn("m", F.struct(dist.alias("dist"), F.col("a").alias("l"), F.col("b").alias("g")))
        best = told.select(F.explode(F.array("a", "b")).alias("id"), "m").groupBy("id").agg(F.min("m").alias("m"))
        mutual = settled(best.groupBy("m").agg(F.count(F.lit(1)).alias("both")).where("both = 2").select("m.*"))
        if mutual.isEmpty():
            kind = dict(near.dtypes)["a"]
            return merges if merges is not None else near.sparkSession.createDataFrame([], f"height double, a {kind}, b {kind}")
        new = mutual.select(F.col("dist").alias("height"), F.col("l").alias("a"), F.col("g").alias("b"))
        merges = new if merges is None else merges.unionByName(new)
        gone = mutual.select(F.col("g").alias("id"), F.col("l").alias("to"))
        for end in ("a", "b"):
            edges = edges.join(gone.select(F.col("id").alias(end), F.col("to").alias("new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        edges = settled(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("sum").alias("sum"), F.sum("known").alias("known")))
        sizes = settled(sizes.join(gone, "id", "left").groupBy(F.coalesce("to", "id").alias("id")).agg(F.sum("n").alias("n")))


def closest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's greatest product as a distance, and the first place that has it of equals at twelve digits."""
    top = found.max(axis=1)
    dist = np.round(1 - top, 12)
    x, y = np.nonzero(found >= top[:, None] - 2e-12)
    same = np.round(1 - found[x, y], 12) == dist[x]
    x, first = np.unique(x[same], return_index=True)
    return dist, y[same][first]


def nearest(clusters: DataFrame, kind: str) -> DataFrame:
    """(id, dist, l, g): of the clusters (id, part, n, v, asks) that ask the nearest one of the same part, and the pair's names.
    Of equals, at twelve digits, the one of least name, with which the pair's names are least too."""

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches)).sort_values("id")  # two blocks
        same = bool(held["i"].iat[0] == held["j"].iat[0])
        a, b = held[held["own"] == held["i"]], held[held["own"] == held["j"]]
        out = []
        for own, other in [(a, b)] if same else [(a, b), (b, a)]:
            at_own = np.flatnonzero(own["asks"].to_numpy())
            if not len(at_own) or not len(other):
                continue
            v, w = np.stack(own["v"].to_numpy()[at_own]), np.stack(other["v"].to_numpy())
            x, y, part, other_part = own["id"].to_numpy()[at_own], other["id"].to_numpy(), own["part"].to_numpy()[at_own], other["part"].to_numpy()
            one = (part == part[0]).all() and (other_part == part[0]).all()
            for s in range(0, len(x), ROWS // 4):
                for t in range(0, len(y), 8 * ROWS):
                    found = v[s : s + ROWS // 4] @ w[t : t + 8 * ROWS].T
                    if same:
                        place = at_own[s : s + ROWS // 4] - t
                        here = np.flatnonzero((place >= 0) & (place < found.shape[1]))
                        found[here, place[here]] = -np.inf
                    if not one:
                        found[part[s : s + ROWS // 4, None] != other_part[None, t : t + 8 * ROWS]] = -np.inf
                    rows = np.flatnonzero(np.isfinite(found.max(axis=1)))
                    if len(rows):
                        dist, near = closest(found[rows] if len(rows) < len(found) else found)
                        left, right = x[s + rows], y[t + near]
                        out.append(pd.DataFrame({"id": left, "dist": dist, "l": np.minimum(left, right), "g": np.maximum(left, right)}))
        if out:
            yield nearest_of(pd.concat(out))

    found = dealt(clusters).groupBy("i", "j").applyInPandas(of_blocks, f"id {kind}, dist double, l {kind}, g {kind}")
    return found.groupBy("id").agg(F.min(F.struct("dist", "l", "g")).alias("m")).select("id", "m.*")


def nearest_of(found):
    """The least of each row's nearest ones."""
    return found.sort_values(["id", "dist", "l", "g"]).drop_duplicates("id")


def rest_merged(clusters):
    """The merges of a bounded number of clusters (id, part, n, v). All that are each other's nearest merge in a round; a mean
    distance to merged clusters is no less than the least of theirs, so only new clusters and those whose nearest has gone
    look again."""
    kind = clusters["id"].dtype
    out = []
    for _, own in clusters.sort_values("id").groupby("part", sort=False, dropna=False):
        name, n, v = own["id"].to_numpy(), own["n"].to_numpy(float), np.stack(own["v"].to_numpy())
        to, dist, asks = np.full(len(name), -1), np.full(len(name), np.inf), np.arange(len(name))
        while len(name) > 1:
            for at in range(0, len(asks), ROWS // 4):
                rows = asks[at : at + ROWS // 4]
                found = v[rows] @ v.T
                found[np.arange(len(rows)), rows] = -np.inf
                dist[rows], to[rows] = closest(found)  # names are in order
            each = np.arange(len(name))
            a = np.flatnonzero((to[to] == each) & (each < to))
            if not len(a):  # rounding made a ring of equals
                a = each[[np.lexsort((np.maximum(each, to), np.minimum(each, to), dist))[0]]]
                a = np.minimum(a, to[a])
                to[to[a]] = a
            b = to[a]
            out.append(pd.DataFrame({"height": dist[a], "a": name[a], "b": name[b]}))
            v[a] += (v[b] - v[a]) * (n[b] / (n[a] + n[b]))[:, None]
            n[a] += n[b]
            gone = np.zeros(len(name), bool)
            gone[b] = True
            ask = gone.copy()
            ask[a] = True
            ask |= ask[to]
            place = np.cumsum(~gone) - 1
            name, n, v, dist, to, ask = name[~gone], n[~gone], v[~gone], dist[~gone], place[to[~gone]], ask[~gone]
            asks = np.flatnonzero(ask)
    none = pd.DataFrame({"height": np.zeros(0), "a": clusters["id"].iloc[:0], "b": clusters["id"].iloc[:0]})
    return (pd.concat(out) if out else none).astype({"a": kind, "b": kind})


def elbow(merges: DataFrame) -> float:
    """The height at the greatest second difference of the sorted heights, within bounds; fewer than three give 0.7."""
    n = merges.count()
    if n < 3:
        return FALLBACK
    names = [c for c in ("a", "b") if c in merges.columns]
    rows = selection.bends(merges.select("height", *names), "height", *names)
    best = rows.where("bend IS NOT NULL").orderBy(F.desc(F.round("bend", 12)), "part", "at").first()
    height = best.height if best.bend > 0 else selection.at_rank(merges, "height", F.lit(n // 2)).first().value
    return min(max(height, LOWEST), HIGHEST)


def cut(merges: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster): what merges up to the threshold tie together, named by the least member."""
    # A merge is b -> a between names, and a name goes but once; names follow theirs by leaps that double.
    to = settled(merges.where(F.col("height") <= threshold).select(F.col("b").alias("name"), F.col("a").alias("to")))
    while True:
        ahead = to.select(F.col("name").alias("to"), F.col("to").alias("further"))
        leaped = settled(to.join(ahead, "to", "left").select("name", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        to = leaped.select("name", "to")
        if leaped.where("moved").isEmpty():
            return ids.join(to.withColumnRenamed("name", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("cluster"))


def median_distance(vectors: DataFrame) -> DataFrame:
    """(part, median): the upper median of the distances, at twelve digits, between all unit vectors (id, v, part) of a part.
    Blocks of products are counted into bins again in each pass, so no pair ever becomes a row; parts are few."""
    sizes = vectors.groupBy("part").agg(F.count(F.lit(1)).alias("s")).where("s > 1")
    kind = dict(vectors.dtypes)["part"]

    def count(left: DataFrame) -> DataFrame:
        bounds = {r.part: (r.low, r.high) for r in left.collect()}  # of the parts that are left

        def each(a, b, found):
            out = []
            if len(a):
                own, other = a["part"].to_numpy(), b["part"].to_numpy()
                for part in set(own) & set(other) & set(bounds):
                    low, high = bounds[part]
                    left_of, right_of = own == part, other == part
                    dist = 1 - (found if left_of.all() and right_of.all() else found[np.ix_(left_of, right_of)])
                    dist = np.round(dist[(dist >= low - 1e-11) & (dist <= high + 1e-11)], 12)  # nan is neither
                    dist = dist[(dist >= low) & (dist <= high)]
                    place = np.minimum((dist - low) / (high - low) * selection.BINS, selection.BINS - 1).astype(int)
                    # Counted where they fall: sorting each tile's distances would take most of a pass.
                    n, least, most = np.bincount(place, minlength=selection.BINS), np.full(selection.BINS, np.inf), np.full(selection.BINS, -np.inf)
                    np.minimum.at(least, place, dist)
                    np.maximum.at(most, place, dist)
                    at = np.flatnonzero(n)
                    if len(at):
                        out.append(pd.DataFrame({"part": part, "bin": at, "n": n[at], "low": least[at], "high": most[at]}))
            none = pd.DataFrame({"part": a["part"].iloc[:0], "bin": np.zeros(0, int), "n": np.zeros(0, int), "low": np.zeros(0), "high": np.zeros(0)})
            return pd.concat([none, *out]) if out else none

        def added(found):
            return found.groupby(["part", "bin"], as_index=False).agg({"n": "sum", "low": "min", "high": "max"})

        counts = block_products(vectors, each, f"part {kind}, bin int, n long, low double, high double", fold=added)
        return counts.groupBy("part", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    half = F.floor(F.col("s") * (F.col("s") - 1) / 4).cast("long")
    state = sizes.select("part", F.lit(-1.0).alias("low"), F.lit(3.0).alias("high"), half.alias("rank"))
    return selection.narrowed(state, ["part"], count).withColumnRenamed("value", "median")


def split_oversized(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """labels with clusters over max(10, n / 4) clustered anew at max(0.15, 0.8 of the upper median of inner distances)."""
    n = labels.count()
    large = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max(10, n // 4))
    own = settled(vectors.join(labels.join(large, "cluster", "left_semi"), "id").select("id", "v", F.col("cluster").alias("part")))
    if own.isEmpty():
        return labels
    middle = median_distance(own).select("part", F.greatest(F.lit(0.15), F.col("median") * 0.8).alias("t"))
    merges = dendrogram(own).join(own.select(F.col("id").alias("a"), "part"), "a").join(middle, "part").where("height <= t").select("height", "a", "b")
    again = cut(merges, own.select("id"), 2.0)
    return labels.join(again.withColumnRenamed("cluster", "inner"), "id", "left").select("id", F.coalesce("inner", "cluster").alias("cluster"))


def merge_narrow(labels: DataFrame, vectors: DataFrame, categories: DataFrame, size: int = 2, distance: float = 0.7, most: int = 8) -> DataFrame:
    """labels with clusters of at most `size` merged that share a category (id, category), are nearer than `distance` on
    average and make at most `most` members; greedily in the order of names.

    Only clusters that are that near can merge, since the mean distance of merged ones is a mean of theirs. So the connected
    components of that relation are worked on one by one, each in one task that holds a mean vector for each cluster.
    """
    from loomline.operators.graph import mirrored

    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= size)
    narrow = settled(labels.join(sizes.select("cluster"), "cluster", "left_semi"))
    summed = narrow.join(vectors, "id").select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("x"))
    means = settled(summed.groupBy(F.col("cluster").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("v")))
    ties = pairs(means, least=1 - distance).where(F.col("cosine") > 1 - distance).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both, names = settled(mirrored(ties)), settled(means.select(F.col("id").alias("node"), F.col("id").alias("root")))
    while True:
        least = both.join(names.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        moved = settled(names.join(least, "node", "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"), (F.col("r") < F.col("root")).alias("changed")))
        names = moved.select("node", "root")
        if moved.where("changed").isEmpty():
            break
    kinds = narrow.join(categories, "id").groupBy("cluster").agg(F.collect_set("category").alias("cats"))
    counted = narrow.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    member = means.withColumnRenamed("id", "cluster").join(names.withColumnRenamed("node", "cluster"), "cluster").join(counted, "cluster").join(kinds, "cluster", "left")

    def greedy(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("cluster")
        name, n = members["cluster"].to_numpy(), members["n"].to_numpy(int)
        sums = np.stack(members["v"].to_numpy()) * n[:, None]
        cats = [sorted(k) if k is not None else [] for k in members["cats"]]
        kinds = {k: i for i, k in enumerate(sorted({k for own in cats for k in own}))}
        has = np.zeros((len(kinds), len(name)), bool)
        for i, own in enumerate(cats):
            has[[kinds[k] for k in own], i] = True
        to, left = np.arange(len(name)), np.ones(len(name), bool)
        for i in range(len(name)):
            while left[i]:
                fits = left[i + 1 :] & (n[i + 1 :] <= most - n[i]) & has[has[:, i], i + 1 :].any(axis=0)
                j = i + 1 + np.flatnonzero(fits)
                near = j[1 - sums[j] @ sums[i] / (n[i] * n[j]) < distance]
                if not len(near):
                    break
                j = near[0]
                left[j], to[j] = False, i
                sums[i] += sums[j]
                n[i] += n[j]
                has[:, i] |= has[:, j]
        return pd.DataFrame({"cluster": name, "merged": name[to]})

    kind = dict(labels.dtypes)["cluster"]
    merged = member.select("root", "cluster", "v", "n", "cats").groupBy("root").applyInPandas(greedy, f"cluster {kind}, merged {kind}")
    return labels.join(merged, "cluster", "left").select("id", F.coalesce("merged", "cluster").alias("cluster"))


def svd(values: DataFrame, sessions: int, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, dimensions, loadings) of the matrix (session_id, feature, value).

    embeddings: (session_id, dim, value), rows of U times the singular values over their length. dimensions: (dim, sigma,
    share of variance at four digits). loadings: (feature, dim, value). k is a quarter of the features between 20 and 80,
    below their number and at most that of sessions.
    """
    from pyspark import StorageLevel
    from pyspark.mllib.linalg import Vectors, VectorUDT
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    spark = values.sparkSession
    values = settled(values)

    def numbered(c: str, n: str) -> DataFrame:
        """The column's different values with a number each, counted on from partition to partition."""
        found = settled(values.select(c).distinct())
        return settled(found.rdd.map(lambda r: r[0]).zipWithIndex().toDF(f"{c} {dict(values.dtypes)[c]}, {n} long"))

    features, rows = numbered("feature", "j"), numbered("session_id", "i")
    m = features.count()
    k = k if k is not None else max(1, min(max(20, min(80, int(m / 4 + 0.5))), m - 1, sessions))
    cells = values.join(features, "feature").join(rows, "session_id").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("cells"))
    sparse = F.udf(lambda own: Vectors.sparse(m, [(c["j"], c["value"]) for c in own if c["value"]]), VectorUDT())
    # Every step of the iteration reads all rows: made once, and kept by the executors as vectors.
    kept = settled(cells.select("i", sparse("cells").alias("vector"))).persist(StorageLevel.MEMORY_AND_DISK)
    found = IndexedRowMatrix(kept, numCols=m).computeSVD(k, computeU=True)
    sigma = [float(x) for x in found.s]
    whole = sum(x * x for x in sigma) or 1.0
    dims = spark.createDataFrame([(d, s, round(s * s / whole, 4)) for d, s in enumerate(sigma)], "dim int, sigma double, share double")
    u = settled(found.U.rows.map(lambda r: (int(r.index), [float(x) * s for x, s in zip(r.vector, sigma, strict=True)])).toDF("i long, v array<double>"))
    kept.unpersist()
    long = u.join(rows, "i").select("session_id", F.posexplode("v").alias("dim", "value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("session_id")))
    embeddings = long.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(0.0))
    # V is A' U over the singular values: a join and a sum, dimension by dimension.
    spread = long.join(values.withColumnRenamed("value", "cell"), "session_id").groupBy("feature", "dim").agg(F.sum(F.col("value") * F.col("cell")).alias("value"))
    loadings = spread.join(F.broadcast(dims.where("sigma > 0")), "dim").select("feature", "dim", (F.col("value") / F.pow("sigma", F.lit(2.0))).alias("value"))
    return embeddings, dims, loadings


def dimension_report(dims: DataFrame, loadings: DataFrame, most: int = 5) -> DataFrame:
    """dimensions with the features of greatest loading over 0.01."""
    nth = Window.partitionBy("dim").orderBy(F.desc(F.abs("value")), "feature")
    top = loadings.where(F.abs("value") > 0.01).withColumn("place", F.row_number().over(nth)).where(F.col("place") <= most)
    named = top.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]).alias("features"))
    return dims.join(named, "dim", "left")
