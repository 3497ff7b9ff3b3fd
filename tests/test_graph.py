import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import graph, overview, sequences, topics, vectors


def frame(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, strength double")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_path_of_three(spark):
    n, e = nodes(spark, "ABC"), frame(spark, ["AB", "BC"])
    assert {r.node: r.centrality for r in graph.degree(n, e).collect()} == {"A": 0.5, "B": 1.0, "C": 0.5}
    assert {r.node: r.betweenness for r in graph.betweenness(n, e).collect()} == {"A": 0.0, "B": 1.0, "C": 0.0}
    assert [r.node for r in graph.bridges(graph.betweenness(n, e)).collect()] == ["B"]


def test_betweenness_of_a_star_and_a_square(spark):
    star = {r.node: r.betweenness for r in graph.betweenness(nodes(spark, "ABCDE"), frame(spark, ["AB", "AC", "AD", "AE"])).collect()}
    assert star == {"A": 1.0, "B": 0.0, "C": 0.0, "D": 0.0, "E": 0.0}
    square = {r.node: r.betweenness for r in graph.betweenness(nodes(spark, "ABCD"), frame(spark, ["AB", "BC", "CD", "DA"])).collect()}
    assert set(square.values()) == {0.1667}


def test_the_betweenness_query_has_all_nodes(spark, sf_dir):
    from loomline.plans.registry import QUERIES

    got = {r.node for r in QUERIES["betweenness"](spark, sf_dir).select("node").collect()}
    assert got == {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}


def test_two_pairs_are_two_communities(spark):
    n, e = nodes(spark, "ABCDE"), frame(spark, ["AB", "CD"])
    found = {r.node: r.community for r in graph.communities(n, e).collect()}
    assert found == {"A": "A", "B": "A", "C": "C", "D": "C", "E": "E"}
    assert abs(graph.modularity(e, graph.communities(n, e)).first()[0] - 0.5) < 1e-9
    assert {r.community for r in graph.communities(n, e.limit(0)).collect()} == set("ABCDE")


def plain_communities(weights, names, halves):
    """The rounds of graph.communities over weights {(a, b): w}; halves(r) are the nodes of a round."""
    both = [(a, b, w) for (a, b), w in weights.items()] + [(b, a, w) for (a, b), w in weights.items()]
    k = {n: sum(w for a, _, w in both if a == n) for n in names}
    m2 = sum(k.values())

    def quality(of):
        degree = {c: sum(k[n] for n in names if of[n] == c) for c in set(of.values())}
        return sum(w for a, b, w in both if of[a] == of[b]) / m2 - sum((d / m2) ** 2 for d in degree.values())

    of, idle = {n: n for n in names}, 0
    for r in range(200):
        moved = dict(of)
        for n in halves(r):
            gains = {}
            for a, b, w in both:
                if a == n:
                    gains[of[b]] = gains.get(of[b], 0) + w
            rest = lambda c, n=n: sum(k[x] for x in names if of[x] == c and x != n)
            gains = {c: round(w - rest(c) * k[n] / m2, 12) for c, w in gains.items()}
            if gains and max(gains.values()) > 0:
                moved[n] = min(gains, key=lambda c: (-gains[c], c))
        moved = {n: min(x for x in names if moved[x] == moved[n]) for n in names}
        if quality(moved) > quality(of) + 1e-9:
            of, idle = moved, 0
        else:
            idle += 1
            if idle == 6:
                break
    return of


def test_communities_equal_plain_rounds_and_shuffle_no_edges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = list(range(30))
    weights = {(a, b): round(rng.random(), 9) for a in names[:-1] for b in names[a + 1 : -1] if rng.random() < (0.6 if a % 3 == b % 3 else 0.08)}
    n = spark.createDataFrame([(i,) for i in names], "node long")
    e = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, strength double")
    halves = lambda r: [x.node for x in n.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0).collect()]
    plans, settled = [], graph.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(graph, "settled", seen)
    tables = {t.name for t in spark.catalog.listTables()}
    got = {r.node: r.community for r in graph.communities(n, e).collect()}
    assert got == plain_communities(weights, names, halves) and 1 < len(set(got.values())) < 12
    rounds = [p for p in plans if "weight" in p]
    assert rounds and not any("hashpartitioning(node" in p for p in rounds)
    assert {t.name for t in spark.catalog.listTables()} == tables


def slow_linkage(dist, n):
    groups, heights = {i: [i] for i in range(n)}, []
    while len(groups) > 1:
        d, a, b = min((np.mean([dist[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        heights.append((d, a, b))
        groups[a] += groups.pop(b)
    return heights


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_frame(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("finish", [1, 8, 256])
def test_dendrogram_equals_the_loop(spark, finish):
    rng = np.random.default_rng(4)
    n = 24
    v = unit(rng.normal(size=(n, 5)))
    want = slow_linkage(1 - v @ v.T, n)
    merges = vectors.settled(vectors.dendrogram(vector_frame(spark, v), finish))
    got = sorted((r.height, r.a, r.b) for r in merges.collect())
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in sorted(want)]
    assert np.allclose([h for h, _, _ in got], sorted(h for h, _, _ in want))
    t = sorted(h for h, _, _ in want)[12] + 1e-9
    roots = list(range(n))
    for h, a, b in want:
        if h <= t:
            roots = [a if r == b else r for r in roots]
    assert {r.id: r.cluster for r in vectors.cut(merges, spark.range(n), t).collect()} == dict(enumerate(roots))


def test_a_few_thousand_clusters_merge_in_few_jobs(spark, monkeypatch):
    """Rounds over clusters that one task holds are no jobs; the tree is that of rounds over blocks, ties included."""
    rng = np.random.default_rng(5)
    v = unit(np.concatenate([rng.normal(size=(500, 6)), rng.integers(0, 2, size=(100, 6)) + [1, 0, 0, 0, 0, 0]]))
    rows = vector_frame(spark, v).withColumn("part", F.when(F.col("id") % 3 == 0, 0).otherwise(1))
    tables, settled = [], vectors.settled
    monkeypatch.setattr(vectors, "settled", lambda df: tables.append(df) or settled(df))
    got = sorted((round(r.height, 9), r.a, r.b) for r in vectors.dendrogram(rows).collect())
    assert len(tables) <= 3
    assert got == sorted((round(r.height, 9), r.a, r.b) for r in vectors.dendrogram(rows, 64).collect()) and len(tables) > 10


def test_only_clusters_whose_nearest_has_gone_look_again(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = vector_frame(spark, unit(rng.normal(size=(300, 5))))
    asked, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda clusters, kind: asked.append((clusters.where("asks").count(), clusters.count())) or nearest(clusters, kind))
    got = sorted((round(r.height, 9), r.a, r.b) for r in vectors.dendrogram(rows, 100).collect())
    assert got == sorted((round(r.height, 9), r.a, r.b) for r in vectors.dendrogram(rows).collect()) and len(got) == 299
    assert asked[0] == (300, 300) and len(asked) > 2 and all(a < 0.9 * n for a, n in asked[1:])


def test_equal_vectors_merge_first_and_parts_stay_apart(spark):
    v = unit(np.array([[1, 0], [0, 1], [1, 0], [1, 0.1], [1, 0], [0, 1.0]]))
    frame = vector_frame(spark, v)
    got = sorted((round(r.height, 9), r.a, r.b) for r in vectors.dendrogram(frame).collect())
    assert got[:3] == [(0.0, 0, 2), (0.0, 0, 4), (0.0, 1, 5)] and len(got) == 5
    for finish in (1, 256):
        apart = vectors.dendrogram(frame.withColumn("part", F.col("id") % 2), finish)
        assert sorted((r.a % 2, r.b % 2) for r in apart.collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_pairs_over_blocks(spark):
    v = unit(np.random.default_rng(2).normal(size=(50, 6)))
    m = v @ v.T
    for least in (None, 0.3):
        got = {(r.a, r.b): r.cosine for r in vectors.pairs(vector_frame(spark, v), least, rows=9).collect()}
        want = {(i, j): m[i, j] for i in range(50) for j in range(i + 1, 50) if least is None or m[i, j] >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert vectors.pairs(vector_frame(spark, v).limit(0)).count() == 0


def test_oversized_clusters_split(spark):
    rng = np.random.default_rng(9)
    centres = unit(rng.normal(size=(2, 8)))
    v = unit(np.concatenate([centres[0] + rng.normal(size=(8, 8)) * 0.05, centres[1] + rng.normal(size=(8, 8)) * 0.05, unit(rng.normal(size=(4, 8)))]))
    labels = spark.createDataFrame([(i, 0 if i < 16 else i) for i in range(20)], "id long, cluster long")
    got = {r.id: r.cluster for r in vectors.split_oversized(labels, vector_frame(spark, v)).collect()}
    inner = sorted(1 - v[i] @ v[j] for i in range(16) for j in range(i + 1, 16))
    t, roots = max(0.15, 0.8 * inner[len(inner) // 2]), list(range(16))
    for h, a, b in slow_linkage(1 - v[:16] @ v[:16].T, 16):
        if h <= t:
            roots = [a if r == b else r for r in roots]
    assert got == dict(enumerate(roots)) | {i: i for i in range(16, 20)} and len(set(roots)) == 2


def test_the_tree_of_the_query_has_far_merges_too(spark, tmp_path):
    from loomline.plans.registry import QUERIES

    rng = np.random.default_rng(6)
    n = 12
    v = rng.normal(size=(n, 64)) + 0.5
    spark.createDataFrame([(i, [float(x) for x in v[i]], 0) for i in range(n)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted(slow_linkage(1 - v @ v.T, n))
    got = sorted((r.height, r.a, r.b) for r in QUERIES["elbow"](spark, str(tmp_path)).collect())
    assert [m[1:] for m in got] == [m[1:] for m in want] and max(h for h, _, _ in want) > 0.6
    assert np.allclose([m[0] for m in got], [m[0] for m in want])


def test_elbow_bounds(spark):
    heights = lambda *h: spark.createDataFrame([(x,) for x in h], "height double")
    assert vectors.elbow(heights(0.3, 0.6)) == 0.7
    assert vectors.elbow(heights(0.01, 0.02, 0.03, 0.04, 0.05)) == 0.3
    assert vectors.elbow(heights(0.91, 0.95, 1.0, 1.1, 1.2)) == 0.9


def test_narrow_clusters_merge_by_category_and_distance(spark):
    labels = spark.createDataFrame([(i, i) for i in range(4)], "id long, cluster long")
    gram = np.full((4, 4), 0.7)
    gram[3] = gram[:, 3] = 0.1
    np.fill_diagonal(gram, 1)
    rows = vector_frame(spark, np.linalg.cholesky(gram))
    kinds = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "x")], "id long, category string")
    assert {r.id: r.cluster for r in vectors.merge_narrow(labels, rows, kinds).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    # Nine that all may merge make one of eight at most.
    many = spark.createDataFrame([(i, i) for i in range(9)], "id long, cluster long")
    near = vector_frame(spark, unit(np.random.default_rng(1).normal(size=(9, 12)) * 0.1 + 1))
    one = spark.createDataFrame([(i, "k") for i in range(9)], "id long, category string")
    assert sorted(r.cluster for r in vectors.merge_narrow(many, near, one).collect()) == [0] * 8 + [8]


def test_upper_median_and_hot_files(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 5, 5, 9)], "v long")
    assert overview.upper_median(rows, "v").first()[0] == 5 and overview.upper_median(rows.where("v > 1 AND v <> 5"), "v").first()[0] == 9
    assert overview.upper_median(rows.limit(0), "v").count() == 0


def test_patterns_within_longer_ones_go(spark):
    rows = [("s1", "p", k, "T", f'{{"x":{k}}}') for k in range(4)] + [("s2", "p", k, "T", "{}") for k in range(4)]
    calls = spark.createDataFrame(rows, "session_id string, project string, at int, tool_name string, input string")
    kept = sequences.maximal(sequences.ngrams(calls, ["at"])).collect()
    assert sorted((r.length, r.n) for r in kept) == [(3, 4), (4, 2)]  # four threes, but only two fours: 2 < 0.8 * 4
    few = sequences.maximal(sequences.ngrams(calls.where("at < 3 OR session_id = 's1'").unionByName(calls.where("session_id = 's1'").withColumn("session_id", F.lit("s3"))), ["at"]))
    assert sorted((r.length, r.n) for r in few.collect()) == [(3, 5), (4, 2)]


def test_calls_are_dealt_to_tasks_by_their_number(spark):
    """A task's calls don't grow with all calls; sessions and projects are counted once, whatever a session has of them."""
    calls = spark.range(4000).select((F.col("id") / 4).cast("long").cast("string").alias("session_id"), "id")
    assert sequences.by_session(calls, rows=100).rdd.getNumPartitions() == 40
    at = [("s1", "p", 0), ("s1", "p", 1), ("s1", "q", 2), ("s1", "q", 3), ("s1", "q", 4), ("s2", "q", 0), ("s2", "q", 1), ("s2", "q", 2)]
    rows = spark.createDataFrame([(s, p, k, "T", "{}") for s, p, k in at], "session_id string, project string, at int, tool_name string, input string")
    plan = sequences.ngrams(rows, ["at"])
    assert [(r.n, r.n_sessions, r.n_projects) for r in plan.where("length = 3").collect()] == [(4, 2, 2)]
    assert "Expand" not in plan._jdf.queryExecution().executedPlan().toString()


def test_facets_of_a_topic(spark):
    members = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "topic_id string, session_id string")
    facets = spark.createDataFrame([("a", "goal", {"fix_x": 1}, "fully_achieved", "essential", {"slow": 2, "bad": 2}, "detail")], "session_id string, underlying_goal string, goal_categories map<string,int>, outcome string, claude_helpfulness string, friction_counts map<string,int>, friction_detail string")
    rows = topics.facets_rollup(members, facets).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.success_rate, r.helpfulness, r.goals, r.categories, r.frictions, r.details) == (0.75, 0.75, ["goal"], ["bugfix"], ["bad", "slow"], ["detail"])


def test_svd_equals_the_dense_one(spark):
    rng = np.random.default_rng(1)
    m = rng.random((9, 5))
    cells = [(f"s{i}", f"f{j}", float(m[i, j])) for i in range(9) for j in range(5)]
    embeddings, dims, loadings = vectors.svd(spark.createDataFrame(cells, "session_id string, feature string, value double"), 9, k=5)
    u, sigma, vt = np.linalg.svd(m, full_matrices=False)
    rows = dims.orderBy("dim").collect()
    assert np.allclose([r.sigma for r in rows], sigma) and np.allclose([r.share for r in rows], (sigma**2 / (sigma**2).sum()).round(4))
    got = np.zeros((9, 5))
    for r in embeddings.collect():
        got[int(r.session_id[1:]), r.dim] = r.value
    want = u * sigma
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    at = np.zeros((5, 5))
    for r in loadings.collect():
        at[r.dim, int(r.feature[1:])] = r.value
    assert np.allclose(np.abs(at), np.abs(vt), atol=1e-6)


def test_svd_makes_its_rows_once(spark, monkeypatch):
    """The iteration reads rows that are kept, not made again in each step."""
    from pyspark.mllib.linalg import distributed

    given, whole = [], distributed.IndexedRowMatrix
    monkeypatch.setattr(distributed, "IndexedRowMatrix", lambda rows, **kw: given.append(rows.is_cached) or whole(rows, **kw))
    cells = [(f"s{i}", f"f{j}", float((i * j) % 7)) for i in range(1, 12) for j in range(1, 6)]
    vectors.svd(spark.createDataFrame(cells, "session_id string, feature string, value double"), 11, k=2)
    assert given[0] is True


def clustered_vectors(n, clusters, dims=8, seed=1):
    """Groups of unit vectors some degrees apart."""
    rng = np.random.default_rng(seed)
    raw = rng.normal(size=(clusters, dims))[np.arange(n) % clusters] + 0.12 * rng.normal(size=(n, dims))
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


@pytest.mark.parametrize("cells", [1, 40, 150])
def test_an_index_of_cells_misses_no_pair(spark, cells):
    unit = clustered_vectors(900, 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
    got = {(r.a, r.b): r.cosine for r in vectors.near_pairs(df, 0.9, cells, rows=64).collect()}
    full = np.triu(unit @ unit.T, 1)
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(full >= 0.9)), strict=True)) and len(got) > 3000
    some = vectors.near_pairs(df, 0.9, cells, reach=0.8).count()
    assert (0.9 if cells > 1 else 0.5) * len(got) <= some <= len(got)
    assert vectors.near_pairs(df.limit(0), 0.9, 5).count() == 0


def test_the_index_asks_near_linearly(spark):
    """Five times the rows in five times the groups ask some five times as many cells' members, not 25 times."""
    found = []
    for n in (400, 2000):
        unit = clustered_vectors(n, n // 20, dims=6, seed=2)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
        found.append(vectors.near_pairs(df, 0.95, n // 10).count())
    assert 4 < found[1] / found[0] < 9


def one_by_one_pruned(n, known):
    """Average linkage pair by pair, unknown pairs at distance 1, never merged without a known one."""
    groups = {i: [i] for i in range(n)}
    out = []
    while True:
        best = None
        for a in sorted(groups):
            for b in sorted(groups):
                own = [(x, y) for x in groups[a] for y in groups[b]]
                if a < b and any((min(p), max(p)) in known for p in own):
                    d = round(sum(known.get((min(p), max(p)), 1.0) for p in own) / len(own), 12)
                    best = min(best, (d, a, b)) if best else (d, a, b)
        if best is None:
            return sorted(out)
        out.append(best)
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("least", [0.0, 0.5, 0.85])
def test_linkage_over_pruned_pairs(spark, least):
    unit = clustered_vectors(26, 6, dims=4, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
    near = vectors.settled(vectors.pairs(df, least))
    known = {(r.a, r.b): 1 - r.cosine for r in near.collect()}
    got = sorted((round(r.height, 9), r.a, r.b) for r in vectors.pruned_dendrogram(near).collect())
    assert got == sorted((round(h, 9), a, b) for h, a, b in one_by_one_pruned(26, known))


def test_linkage_over_all_pairs_is_the_same_tree(spark):
    rng = np.random.default_rng(6)
    raw = np.abs(rng.normal(size=(40, 5)))  # all cosines are positive
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
    told = lambda rows: sorted((round(r.height, 9), r.a, r.b) for r in rows.collect())
    assert told(vectors.pruned_dendrogram(vectors.settled(vectors.pairs(df)))) == told(vectors.dendrogram(df))


def slow_betweenness(n, pairs):
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    sums = np.zeros(n)
    for s in range(n):
        order, paths, dist = [s], {s: 1.0}, {s: 0}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
        for v in order[1:]:
            sums[v] += share[v]
    return sums / ((n - 1) * (n - 2))


def test_betweenness_over_blocks_and_levels_are_few_rows(spark, monkeypatch):
    """Blocks and batches as small as can be give what the plain method gives; a level has a row for many searches."""
    rng = np.random.default_rng(12)
    n = 90
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n - 4, size=(150, 2)).tolist() if p[0] != p[1]}
    sizes, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: sizes.append((df.columns, table := settled(df))) or table)
    monkeypatch.setattr(graph, "removed", lambda *tables: None)
    monkeypatch.setattr(graph, "STEPS", 16)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, strength double")
    got = {r.node: r.betweenness for r in graph.betweenness(spark.range(n).select(F.col("id").alias("node")), edges, block=30).collect()}
    assert got == pytest.approx(dict(enumerate(slow_betweenness(n, pairs))), abs=5.1e-5)
    assert max(t.count() for c, t in sizes if "keys" in c or "source" in c) <= 6 < n


def test_searches_in_tasks_write_no_levels(spark, monkeypatch):
    """Where tasks hold the edges, what is written doesn't grow with the levels, and results are the plain method's and those
    of the way over levels."""
    rng = np.random.default_rng(13)
    n = 80
    path = [(i, i + 1) for i in range(40)]
    pairs = {tuple(sorted(p)) for p in rng.integers(30, n - 4, size=(90, 2)).tolist() if p[0] != p[1]} | set(path)
    sizes, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: sizes.append(df.columns) or settled(df))
    monkeypatch.setattr(graph, "EDGES", 5)
    names = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, strength double")
    got = {r.node: r.betweenness for r in graph.betweenness(names, edges, block=30).collect()}
    assert got == pytest.approx(dict(enumerate(slow_betweenness(n, pairs))), abs=5.1e-5)
    assert len(sizes) <= 5 and not any("keys" in c for c in sizes)
    some = spark.createDataFrame([(3,), (50,)], "node long")
    one = {r.node: r.betweenness for r in graph.betweenness(names, edges.where("src >= 30"), some).collect()}
    monkeypatch.setattr(graph, "STEPS", 4)
    assert one == {r.node: r.betweenness for r in graph.betweenness(names, edges.where("src >= 30"), some).collect()}


def test_copies_of_rows_for_products_grow_as_the_rows(spark):
    """Every row goes to as many pairs of blocks, whatever the number of rows."""
    sizes = [vectors.dealt(spark.range(n).withColumn("v", F.array(F.lit(1.0)))).count() / n for n in (3000, 60000)]
    assert sizes[0] == sizes[1] <= 16


def test_products_by_tiles_give_every_pair_once(spark):
    v = unit(np.random.default_rng(8).normal(size=(700, 3)))
    rows = vectors.pairs(vector_frame(spark, v), 0.99, rows=20).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == int((np.triu(v @ v.T, 1) >= 0.99).sum()) > 1000


def test_modularity_of_vectors_makes_no_edges(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(60)], "node long, community int")
    rows = vector_frame(spark, v)
    edges = vectors.similar(rows, 0.4).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("cosine", 9).alias("strength"))
    want = graph.modularity(edges, labels).first()[0]
    assert abs(graph.modularity_of_vectors(rows, labels, 0.4).first()[0] - want) < 1e-12 and want != 0
    assert graph.modularity_of_vectors(rows, labels, 2.0).first()[0] == 0


def test_prompt_set_links_its_patterns_once(spark, sf_dir, monkeypatch):
    from loomline.plans import topics as plans

    made, link = [], plans.branch_links
    monkeypatch.setattr(plans, "branch_links", lambda *of: made.append(link(*of)) or made[-1])
    found = plans.prompt_set(spark, sf_dir)
    assert len(made) == 1 and found.count() == plans.skill_documents(spark, sf_dir).count()
