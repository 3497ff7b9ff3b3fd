"""The topic graph: centrality, communities, neighbourhoods. edges: (src, dst, strength), undirected, one row an edge."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import half_up
from loomline.operators.iterate import removed, settled, shared_dir


def mirrored(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *keep).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *keep))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): neighbours, and their share of all other nodes at four digits."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    counts = mirrored(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.join(counts, "node", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(n))
    return rows.select("node", "degree", F.coalesce(half_up(F.try_divide(F.col("degree"), F.col("n") - 1), 4), F.lit(0.0)).alias("centrality"))


#: Nodes of a block, sources that are searched from together, and searches times nodes that are kept at once.
BLOCK, SOURCES, KEPT = 8192, 512, 1 << 27
#: Steps along edges that a task holds at once, and how many times as many edges a task of whole searches holds.
STEPS, WHOLE = 1 << 22, 8
#: Edges that a search goes along at once.
EDGES = 1 << 15


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, batch: int | None = None, block: int = BLOCK) -> DataFrame:
    """(node, betweenness) of the unweighted graph, over (n - 1)(n - 2) / 2, at four digits.

    Brandes' method: a search keeps how many shortest paths reach each node, and on the way back each node hands its share
    to those before it. Edges are dealt to blocks of nodes. Up to WHOLE * STEPS directed edges go to each of a number of
    tasks, some for each core, which takes its searches one by one, so nothing of a level is written or shuffled. Beyond, a
    search goes level by level: a row of a level holds what hundreds of searches know of one block, so that a step is a
    blocked sparse product. Sources then go in batches of about `batch` (None: as many as leave KEPT numbers in all levels),
    so no more than so many searches are kept; sums of shares add up from batch to batch. With sources (see pivots) only
    paths from these count, scaled up. Nodes without an edge start no search, but have their row and count in n.
    """
    both = settled(mirrored(edges).distinct())
    linked = both.select("node").distinct()
    n_linked, n_steps = linked.count(), both.count()
    whole = n_steps <= WHOLE * STEPS
    asked = sources.count() if sources is not None else 0
    blocks = max(-(-n_linked // block), 4 * n_steps // STEPS if whole else 1, 1)
    named = linked.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    named = settled(named.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1))
    width = (named.agg(F.max("place")).first()[0] or 0) + 1
    ends = both.join(named.withColumnsRenamed({"block": "i", "place": "x"}), "node").join(named.select(F.col("node").alias("other"), F.col("block").alias("j"), F.col("place").alias("y")), "other")
    start = named.join(sources.select("node").distinct(), "node", "left_semi") if sources is not None else named
    count = start.count()
    sums = None
    if whole and count:
        sums = _searched(start, ends, blocks, width, count)
    elif count:
        steps = settled(ends.select("i", "j", "x", "y").groupBy("i", "j").applyInPandas(_packed_steps, "i int, j int, a binary, b binary"))
        batch = batch if batch is not None else max(SOURCES, KEPT // max(n_linked, 1))
        batches = max(-(-count // batch), 1)
        for i in range(batches):
            own = start.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == i) if batches > 1 else start
            part = _shares(own, steps, width, -(-count // batches))
            sums = part if sums is None else settled(sums.unionByName(part).groupBy("block", "place").agg(F.sum("sum").alias("sum")))
    n = nodes.count()
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / max(asked, 1) if sources is not None else 1.0)
    sums = named.join(sums, ["block", "place"]).select("node", "sum") if sums is not None else nodes.select("node", F.lit(0.0).alias("sum"))
    return nodes.join(sums, "node", "left").select("node", half_up(F.round(F.coalesce("sum", F.lit(0.0)) * scale, 9), 4).alias("betweenness"))


def pivots(nodes: DataFrame, error: float = 0.05, doubt: float = 0.01) -> DataFrame:
    """(node): so many sources, those of least hash, that betweenness from them is off by more than `error` for any node
    with a probability of `doubt` at most; all nodes where that is no fewer. One source hands a node n - 2 at most, so what is
    averaged lies between 0 and n / (n - 1), and Hoeffding's bound over all nodes gives the number."""
    n = nodes.count()
    need = math.ceil(math.log(2 * max(n, 1) / doubt) / (2 * error * error) * (n / max(n - 1, 1)) ** 2)
    return nodes.select("node") if need >= n else nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(need)


class _Searches:
    """Searches over edges that one task holds, first ends in order (degree: edges of each node, other: their other ends),
    and the sums of shares that they hand to each node. A step goes along the edges of the nodes that are known or of those
    that are asked, whichever are fewer, in pieces of some EDGES that a core's cache holds."""

    def __init__(self, degree: np.ndarray, other: np.ndarray):
        self.degree, self.other = degree, other
        self.starts = np.cumsum(degree) - degree
        self.given, self.sums = np.zeros(len(degree)), np.zeros(len(degree))

    def _pieces(self, nodes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some of the nodes after another, from and to: other ends of their edges, where each one's begin, and how many."""
        d, starts = self.degree[nodes], self.starts[nodes]
        upto = np.cumsum(d)
        at, before = 0, 0
        for to in [*np.unique(np.searchsorted(upto, np.arange(EDGES, upto[-1], EDGES)) + 1).tolist(), len(nodes)]:
            if to > at:
                begin = upto[at:to] - d[at:to] - before
                yield at, to, self.other[np.arange(upto[to - 1] - before) + np.repeat(starts[at:to] - begin, d[at:to])], begin, d[at:to]
                at, before = to, upto[to - 1]

    def _step(self, known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """What the known nodes' values add up to at each of the asked ones."""
        if self.degree[known].sum() <= self.degree[asked].sum():
            found = np.zeros(len(self.degree))
            for at, to, ends, _, d in self._pieces(known):
                np.add.at(found, ends, np.repeat(values[at:to], d))
            return found[asked]
        found = np.empty(len(asked))
        self.given[known] = values
        for at, to, ends, begin, _ in self._pieces(asked):
            found[at:to] = np.add.reduceat(self.given[ends], begin)
        self.given[known] = 0.0
        return found

    def search(self, source: int, linked: np.ndarray) -> None:
        paths, levels, rest = [np.ones(1)], [np.array([source])], linked[linked != source]
        while len(rest):
            found = self._step(levels[-1], paths[-1], rest)
            new = found > 0
            if not new.any():
                break
            levels.append(rest[new])
            paths.append(found[new])
            rest = rest[~new]
        share = np.zeros(len(levels[-1]))
        for d in range(len(levels) - 1, 0, -1):
            self.sums[levels[d]] += share
            if d > 1:
                share = paths[d - 1] * self._step(levels[d], (1 + share) / paths[d], levels[d - 1])


def _searched(start: DataFrame, ends: DataFrame, blocks: int, width: int, count: int) -> DataFrame:
    """(block, place, sum): what the searches from all of start (node, block, place), count in number, hand to each node on
    their way back; each task holds the edges ends (i, x, j, y) and takes its share of the searches."""

    def packed(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["x", "y"])
        degree = np.bincount(edges["x"], minlength=width)
        return pd.DataFrame({"block": edges["i"].iloc[:1], "degree": [degree.astype("<u4").tobytes()], "other": [edges["y"].to_numpy("<u4").tobytes()]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources, held = [], {}
        for batch in batches:
            own = batch["other"].isna()
            sources.append(batch.loc[own, "block"].to_numpy() * width + batch.loc[own, "place"].to_numpy(int))
            for b, degree, other in batch.loc[~own, ["block", "degree", "other"]].itertuples(index=False):
                held[b] = degree, other
        sources = np.concatenate(sources) if sources else np.zeros(0, int)
        if not len(sources):
            return
        degree = np.zeros(blocks * width, int)
        for b, (own, _) in held.items():
            degree[b * width : (b + 1) * width] = np.frombuffer(own, "<u4")
        other = np.empty(degree.sum(), int)
        at = 0
        for b in sorted(held):
            own = np.frombuffer(held.pop(b)[1], "<u4")
            other[at : at + len(own)] = own
            at += len(own)
        found, linked = _Searches(degree, other), np.flatnonzero(degree)
        for source in sources.tolist():
            found.search(source, linked)
        at = np.flatnonzero(found.sums)
        yield pd.DataFrame({"block": at // width, "place": at % width, "sum": found.sums[at]})

    groups = max(min(2 * start.sparkSession.sparkContext.defaultParallelism, -(-count // 64)), 1)
    rows = settled(ends.select("i", "x", (F.col("j") * width + F.col("y")).alias("y")).groupBy("i").applyInPandas(packed, "block int, degree binary, other binary"))
    around = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("s"), "block", F.lit(None).cast("int").alias("place"), "degree", "other")
    nothing = F.lit(None).cast("binary")
    ahead = start.select(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(groups)).cast("int").alias("s"), "block", "place", nothing.alias("degree"), nothing.alias("other"))
    shares = ahead.unionByName(around).repartitionById(groups, F.col("s")).mapInPandas(each, "block int, place int, sum double")
    return settled(shares.groupBy("block", "place").agg(F.sum("sum").alias("sum")))


def _packed_steps(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges from block i to block j in one row, in order of their first ends."""
    edges = edges.sort_values(["x", "y"])
    return pd.DataFrame({"i": edges["i"].iloc[:1], "j": edges["j"].iloc[:1], "a": [edges["x"].to_numpy("<u4").tobytes()], "b": [edges["y"].to_numpy("<u4").tobytes()]})


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order with the sums of their positive values."""
    if not len(keys):
        return keys, values
    if len(keys) * 8 < int(keys.max()):
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, values)
    sums = np.bincount(keys, values)
    keys = np.flatnonzero(sums)
    return keys.astype("<u4"), sums[keys]


def _joined(packed: Iterable[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind)


def _spread(level: DataFrame, steps: DataFrame, width: int, groups: int) -> DataFrame:
    """(s, i, keys, values): what a level's values (s, i, keys, values) add up to at the other ends of its nodes' edges, from
    each block by itself. A key is the search's number times width plus the node's place."""

    def each(held: pd.DataFrame) -> pd.DataFrame:
        own = held["j"] < 0
        if not own.any():
            return pd.DataFrame({"s": [], "i": [], "keys": [], "values": []})
        keys, values = _joined(held.loc[own, "a"], "<u4"), _joined(held.loc[own, "b"], "<f8")
        base, place = keys // width * width, keys % width
        out = []
        for j, a, b in held.loc[~own, ["j", "a", "b"]].itertuples(index=False):
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            starts = np.searchsorted(x, np.arange(width + 1))
            degree = np.diff(starts)[place]
            has = np.flatnonzero(degree)
            upto, found = np.cumsum(degree[has]), []
            at = 0
            while at < len(has):
                to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEPS, "right")), at + 1)
                rows = has[at:to]
                d = degree[rows]
                edge = np.arange(d.sum()) + np.repeat(starts[place[rows]] - np.cumsum(d) + d, d)
                found.append(_summed(np.repeat(base[rows], d) + y[edge], np.repeat(values[rows], d)))
                at = to
            if found:
                k, v = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if len(found) > 1 else found[0]
                out.append((held["s"].iat[0], j, k.astype("<u4").tobytes(), v.tobytes()))
        return pd.DataFrame(out, columns=["s", "i", "keys", "values"])

    around = steps.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("s"), "i", "j", "a", "b")
    ahead = level.select("s", "i", F.lit(-1).alias("j"), F.col("keys").alias("a"), F.col("values").alias("b"))
    return ahead.unionByName(around).groupBy("s", "i").applyInPandas(each, "s int, i int, keys binary, values binary")


def _shares(start: DataFrame, steps: DataFrame, width: int, count: int) -> DataFrame:
    """(block, place, sum): what the searches from all of start (node, block, place), about count, hand to each node on their
    way back."""
    groups = max(-(-count // SOURCES), min(24, -(-count // 64)), 1)
    numbered = start.withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(groups)).cast("int"))
    numbered = numbered.withColumn("q", F.row_number().over(Window.partitionBy("s").orderBy("node")) - 1)
    schema = "s int, i int, keys binary, values binary"

    def first(held: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(held["q"].to_numpy() * width + held["place"].to_numpy()).astype("<u4")
        return pd.DataFrame([(held["s"].iat[0], held["block"].iat[0], keys.tobytes(), np.ones(len(keys)).tobytes())], columns=["s", "i", "keys", "values"])

    def ahead(held: pd.DataFrame) -> pd.DataFrame:
        known = held["known"].to_numpy()
        keys, values = _summed(_joined(held.loc[~known, "keys"], "<u4"), _joined(held.loc[~known, "values"], "<f8"))
        seen = _joined(held.loc[known, "keys"], "<u4")
        passed = np.zeros(max(keys.max(initial=0), seen.max(initial=0)) + 1, bool)
        passed[seen] = True
        new = ~passed[keys]
        if not new.any():
            return pd.DataFrame({"s": [], "i": [], "keys": [], "values": []})
        return pd.DataFrame([(held["s"].iat[0], held["i"].iat[0], keys[new].tobytes(), values[new].tobytes())], columns=["s", "i", "keys", "values"])

    def back(held: pd.DataFrame) -> pd.DataFrame:
        known = held["known"].to_numpy()
        if not known.any():
            return pd.DataFrame({"s": [], "i": [], "keys": [], "values": [], "sums": []})
        keys, paths = _joined(held.loc[known, "keys"], "<u4"), _joined(held.loc[known, "values"], "<f8")
        from_keys, given = _joined(held.loc[~known, "keys"], "<u4"), _joined(held.loc[~known, "values"], "<f8")
        share = paths * np.bincount(from_keys, given, minlength=int(keys.max()) + 1)[keys]
        sums = np.bincount(keys % width, share, minlength=width)
        return pd.DataFrame([(held["s"].iat[0], held["i"].iat[0], keys.tobytes(), ((1 + share) / paths).tobytes(), sums.tobytes())], columns=["s", "i", "keys", "values", "sums"])

    def by_node(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, packed in zip(batch["i"], batch["sums"], strict=True):
                sums = np.frombuffer(packed, "<f8")
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"block": i, "place": at, "sum": sums[at]})

    with_known = lambda df, known: df.select("s", "i", "keys", "values", F.lit(known).alias("known"))
    levels = [settled(numbered.groupBy("s", "block").applyInPandas(first, schema))]
    while True:
        met = with_known(_spread(levels[-1], steps, width, groups), False)
        # A neighbour of the last level lies on it, on the one before it, or is new.
        for seen in levels[-2:]:
            met = met.unionByName(with_known(seen, True))
        front = settled(met.groupBy("s", "i").applyInPandas(ahead, schema))
        if front.isEmpty():
            break
        levels.append(front)
    total, behind = None, []
    for level in levels[:0:-1]:
        met = with_known(level, True)
        if behind:
            met = with_known(_spread(behind[-1], steps, width, groups), False).unionByName(met)
        behind.append(settled(met.groupBy("s", "i").applyInPandas(back, f"{schema}, sums binary")))
        part = behind[-1].select("i", "sums").mapInPandas(by_node, "block int, place int, sum double")
        total = part if total is None else total.unionByName(part)
    if total is None:
        total = start.select("block", "place", F.lit(0.0).alias("sum")).limit(0)
    total = settled(total.groupBy("block", "place").agg(F.sum("sum").alias("sum")))
    removed(*levels, *behind, front)
    return total


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of the labelling (node, community): by community, the weight within over all weight less the
    square of its nodes' share of strength."""
    both = mirrored(edges, "strength")
    own = labels.select("node", "community")
    rows = both.join(own, "node").join(own.select(F.col("node").alias("other"), F.col("community").alias("across")), "other")
    sums = rows.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("across"), F.col("strength")).otherwise(0.0)).alias("inside"), F.sum("strength").alias("degree"))
    return _quality(sums)


def _quality(sums: DataFrame) -> DataFrame:
    """The modularity of communities (community, inside, degree)."""
    m2 = sums.agg(F.sum("degree").alias("m2"))
    return sums.crossJoin(F.broadcast(m2)).agg(F.coalesce(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)), F.lit(0.0)).alias("modularity"))


def modularity_of_vectors(vectors: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """One row: the modularity of the labelling (node, community) over the graph of unit vectors (id, v) with an edge for a
    cosine of `least` or more, at nine digits. Tiles of products are summed by community, so no edge becomes a row."""
    from loomline.operators.vectors import block_products

    def added(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("community", as_index=False, dropna=False).sum()

    def each(a: pd.DataFrame, b: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        x, y = np.nonzero(found >= least)
        other = a["id"].to_numpy()[x] != b["id"].to_numpy()[y]  # a vector with two labels is two rows
        x, y = x[other], y[other]
        weight = np.round(found[x, y], 9)
        of_a, of_b = a["community"].to_numpy()[x], b["community"].to_numpy()[y]
        inside = np.where(of_a == of_b, weight, 0.0)
        return added(pd.DataFrame({"community": np.concatenate([of_a, of_b]), "inside": np.tile(inside, 2), "degree": np.tile(weight, 2)}))

    rows = vectors.join(labels.select(F.col("node").alias("id"), "community"), "id")
    kind = dict(rows.dtypes)["community"]
    found = block_products(rows, each, f"community {kind}, inside double, degree double", fold=added)
    return _quality(settled(found.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("degree"))))


#: Rows of edges in a bucket, at least and at most, about.
SMALL, BUCKET = 1 << 14, 1 << 21


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, community) by moves that raise modularity: each round one half of the nodes, by hash, joins the neighbouring
    community of greatest gain, the least of equals; a round that doesn't raise modularity is undone and another half
    tried, six in a row at most; 200 halves are the reference's cap of 100 full rounds. Communities are named by their least node, so equal inputs give equal labels; Q never falls.

    Edges are dealt to buckets by node once, and what a round knows of the nodes, a row each, is broadcast to them, so a
    round shuffles no edges. Moves are worked out anew only where labels have changed."""
    n_edges = edges.count()
    if not n_edges:
        return nodes.select("node", F.col("node").alias("community"))
    both, name = _bucketed(mirrored(edges, "strength"), 2 * n_edges)
    strength = both.groupBy("node").agg(F.sum("strength").alias("k"))
    state = _with_sums(strength.select("node", F.col("node").alias("community"), "k"))
    m2 = state.agg(F.sum("k")).first()[0]
    best, idle, move, passed = _quality_of(both, state, m2), 0, None, []
    for r in range(rounds):
        if move is None:
            move = settled(_moves(both, state, m2))
            if move.isEmpty():
                break
        half = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        moved = state.join(move.where(half), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k")
        least = moved.groupBy("community").agg(F.min("node").alias("name"))
        moved = _with_sums(moved.join(least, "community").select("node", F.col("name").alias("community"), "k"))
        q = _quality_of(both, moved, m2)
        if q > best + 1e-9:
            passed += [state, move]
            state, best, idle, move = moved, q, 0, None
        else:
            passed.append(moved)
            idle += 1
            if idle == 6:
                break
    labels = settled(nodes.join(state.select("node", "community"), "node", "left").select("node", F.coalesce("community", "node").alias("community")))
    both.sparkSession.sql(f"DROP TABLE {name}")
    removed(both, state, *passed, *[m for m in [move] if m is not None])
    return labels


def _bucketed(both: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """both as a table of the shared folder in buckets by node, and the table's name."""
    spark = both.sparkSession
    buckets = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL)), -(-rows // BUCKET))
    name = f"edges_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    both.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.settled_at = path
    return table, name


def _with_sums(labels: DataFrame) -> DataFrame:
    """labels (node, community, k) with sum, their community's strength; a settled table."""
    labels = settled(labels)
    summed = settled(labels.join(labels.groupBy("community").agg(F.sum("k").alias("sum")), "community").select("node", "community", "k", "sum"))
    removed(labels)
    return summed


def _moves(both: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """(node, to) of the nodes that gain by a move."""
    ends = F.broadcast(state.select(F.col("node").alias("other"), F.col("community").alias("to"), "sum"))
    across = both.join(ends, "other").groupBy("node", "to").agg(F.sum("strength").alias("weight"), F.max("sum").alias("sum"))
    to = across.join(F.broadcast(state.select("node", "community", "k")), "node")
    rest = F.col("sum") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("weight") - rest * F.col("k") / m2, 12)
    best = to.withColumn("gain", gain).where("gain > 0").groupBy("node", "community").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best"))
    return best.where("best.to != community").select("node", "best.to")


def _quality_of(both: DataFrame, state: DataFrame, m2: float) -> float:
    """The modularity of the labelling (node, community, k)."""
    own = lambda c: F.broadcast(state.select(F.col("node").alias(c), F.col("community").alias(f"of_{c}")))
    inside = both.join(own("node"), "node").join(own("other"), "other").where("of_node = of_other").agg(F.coalesce(F.sum("strength"), F.lit(0.0)).alias("inside"))
    squares = state.groupBy("community").agg(F.sum("k").alias("degree")).agg(F.sum(F.pow(F.col("degree") / m2, 2)).alias("squares"))
    return inside.crossJoin(squares).select(F.col("inside") / m2 - F.col("squares")).first()[0]


def community_table(labels: DataFrame, keywords: DataFrame, projects: DataFrame) -> DataFrame:
    """(community, size, label, project): the three heaviest keywords and the commonest project of each."""
    from loomline.operators.topics import first_by, listed

    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    words = labels.join(keywords.withColumnRenamed("topic_id", "node"), "node").groupBy("community", "term").agg(F.sum("weight").alias("weight"))
    words = listed(first_by(words, ["community"], F.desc("weight"), F.col("term"), most=3), ["community"], "term", "words")
    main = labels.join(projects.withColumnRenamed("topic_id", "node"), "node").groupBy("community", "project").agg(F.count(F.lit(1)).alias("n"))
    main = first_by(main, ["community"], F.desc("n"), F.col("project")).select("community", "project")
    return sizes.join(words, "community", "left").join(main, "community", "left").select("community", "size", F.array_join("words", ", ").alias("label"), "project")


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density at four digits, isolated nodes."""
    degrees = degree(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("degree") == 0).alias("n_isolated"))
    rows = degrees.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    density = half_up(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), 4)
    return rows.select("n_nodes", "n_edges", "n_isolated", F.coalesce(density, F.lit(0.0)).alias("density"))


def bridges(central: DataFrame) -> DataFrame:
    """Of the nodes with a betweenness above zero the tenth, rounded up, with the greatest."""
    between = central.where("betweenness > 0")
    return between.orderBy(F.desc("betweenness"), "node").limit(-(-between.count() // 10))


def context(edges: DataFrame, most: int = 10, communities: DataFrame | None = None, bridge: DataFrame | None = None) -> DataFrame:
    """(node, place, other, direction, type, strength): each node's strongest neighbours. With communities (node, community,
    label) also the node's community's label and size, with bridge (node) whether it is one of them; these only in rows
    of nodes that have a neighbour."""
    kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), kind.alias("type"), "strength")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"), kind.alias("type"), "strength")
    nth = Window.partitionBy("node").orderBy(F.desc("strength"), "other")
    rows = out.unionByName(back).withColumn("place", F.row_number().over(nth)).where(F.col("place") <= most)
    if communities is not None:
        size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))
        rows = rows.join(communities.join(size, "community").select("node", F.col("label").alias("community_label"), "community_size"), "node", "left")
    if bridge is not None:
        rows = rows.join(bridge.select("node", F.lit(True).alias("is_bridge")), "node", "left").fillna(False, ["is_bridge"])
    return rows


def subgraph(labels: DataFrame, edges: DataFrame, visible: list, types: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the visible communities, and edges of the wanted types between them. Nodes with a session_count get val, the
    size they are drawn at."""
    nodes = labels.where(F.col("community").isin(*visible))
    if "session_count" in nodes.columns:
        nodes = nodes.withColumn("val", F.greatest(F.lit(2), 2 * F.col("session_count")).cast("long"))
    kept = edges.where(F.col("type").isin(*types)) if types is not None else edges
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return nodes, kept


def neighbourhood(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, type, other, label, strength): a node's edges by type with the names of those at the other end."""
    return mirrored(edges, "type", "strength").join(labels.select(F.col("topic_id").alias("other"), "label"), "other", "left")
