"""Ranks, bends, medians of distances, overlaps and edges by bounded work, each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import graph, overview, selection, topics, vectors


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ranks_equal_the_sort(spark, kind):
    rng = random.Random(kind)
    draw = {"long": lambda: rng.choice([7, 7, 7, rng.randrange(10**6), 2**62 + rng.randrange(3), -5]), "double": lambda: rng.choice([0.5, rng.random(), rng.random() * 1e-9, 1e12, -0.25])}[kind]
    rows = [(g, draw() if rng.random() > 0.1 else None) for g in ("a", "b", "c") for _ in range({"a": 1, "b": 150, "c": 400}[g])] + [("none", None)]
    df = spark.createDataFrame(rows, f"g string, x {kind}")
    groups = {g: sorted(x for h, x in rows if h == g and x is not None) for g in ("a", "b", "c")}
    for rank, at in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (F.col("n") - 1, lambda n: n - 1)):
        got = {r.g: r.value for r in selection.at_rank(df, "x", rank, ["g"], bins=16).collect()}
        assert got == {g: v[at(len(v))] for g, v in groups.items() if v}
    whole = sorted(x for _, x in rows if x is not None)
    assert overview.upper_median(df, "x").first().median == whole[len(whole) // 2]
    assert overview.upper_median(df.limit(0), "x").count() == 0


def test_bends_and_elbow_equal_the_sort(spark):
    rng = random.Random(4)
    heights = [0.0] * 40 + [round(rng.random() ** 3, 6) for _ in range(160)]
    df = spark.createDataFrame([(h, i, i + 1) for i, h in enumerate(heights)], "height double, a long, b long").repartition(5)
    h = sorted(heights)
    want = [h[i + 1] - 2 * h[i] + h[i - 1] for i in range(1, len(h) - 1)]
    got = [r.bend for r in selection.bends(df, "height", "a", "b").where("bend IS NOT NULL").orderBy("part", "at").collect()]
    assert np.allclose(got, want)
    best = max(range(len(want)), key=lambda i: (round(want[i], 12), -i))
    assert vectors.elbow(df) == min(max(h[best + 1], 0.3), 0.9)
    straight = spark.createDataFrame([(0.5, i, i + 1) for i in range(9)], "height double, a long, b long")
    assert vectors.elbow(straight) == 0.5 and vectors.elbow(straight.limit(2)) == 0.7


def test_median_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(90, 6)) + np.repeat(rng.normal(size=(3, 6)), 30, axis=0)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    parts = ["x"] * 50 + ["y"] * 39 + ["z"]
    df = spark.createDataFrame([(i, v.tolist(), p) for i, (v, p) in enumerate(zip(unit, parts, strict=True))], "id long, v array<double>, part string")
    got = {r.part: r.median for r in vectors.median_distance(df).collect()}
    for part in "xy":
        own = unit[[p == part for p in parts]]
        dist = np.sort(np.round(1 - own @ own.T, 12)[np.triu_indices(len(own), 1)])
        assert got[part] == pytest.approx(dist[len(dist) // 2], abs=1e-11)
    assert set(got) == {"x", "y"}


def sessions_of(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, topic_id string, project string, git_branch string, us long")
    return df.select("topic_id", "session_id"), df.select("session_id", "project", "git_branch", F.timestamp_micros("us").cast("timestamp_ntz").alias("created_at"))


def test_session_overlap_equals_all_pairs(spark):
    rng = random.Random(8)
    hour = 3_600_000_000
    starts = [hour * h + rng.choice([0, 1, hour - 1, rng.randrange(hour)]) for h in rng.choices(range(500_000, 500_040), k=120)]
    rows = [(i, f"t{rng.randrange(14):02}", f"p{i % 3}", rng.choice(["main", "", None, "x"]), s) for i, s in enumerate(starts)]
    want = {}
    for _, t, p, b, s in rows:
        for _, u, q, c, z in rows:
            if t < u:
                near = 0.6 if p == q and b and b == c else 0.4 if abs(s - z) < hour else 0
                if near:
                    want[t, u] = max(near, want.get((t, u), 0))
    got = {(r.src, r.dst): r.overlap for r in topics.session_overlap(*sessions_of(spark, rows)).collect()}
    assert got == want


def test_a_hundred_thousand_sessions_in_one_hour(spark):
    rows = spark.range(100_000).select(F.col("id").alias("session_id"), F.concat(F.lit("t"), F.col("id") % 10).alias("topic_id"), F.lit("p").alias("project"), F.lit(None).cast("string").alias("git_branch"), F.timestamp_micros(F.lit(3_600_000_000) * 500_000 + F.col("id")).cast("timestamp_ntz").alias("created_at"))
    found = topics.session_overlap(rows.select("topic_id", "session_id"), rows.drop("topic_id"))
    assert found.count() == 45


def test_bounded_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    n = 60
    near = np.repeat(rng.normal(size=(12, 5)), 5, axis=0) + 0.6 * rng.normal(size=(n, 5))
    members = spark.createDataFrame([(f"t{i:03}", i) for i in range(n)], "topic_id string, session_id long")
    values = spark.createDataFrame([(i, int(d), float(near[i, d])) for i in range(n) for d in range(5)], "session_id long, dim int, value double")
    files = spark.createDataFrame([(i, f"/f{x}") for i in range(n) for x in rng.choice(40, 3, replace=False).tolist()], "session_id long, file_path string")
    start = spark.createDataFrame([(i, "p", f"b{i % 25}", 1_800_000_000_000_000 + i * 700_000_000) for i in range(n)], "session_id long, project string, git_branch string, us long")
    start = start.withColumn("created_at", F.timestamp_micros("us").cast("timestamp_ntz"))
    shared, overlap = topics.file_overlap(members, files), topics.session_overlap(members, start)
    rounded = lambda df: sorted((r.src, r.dst, r.strength, round(r.semantic, 9), round(r.file_overlap, 9), r.session_overlap) for r in df.collect())
    want = rounded(topics.edges(topics.semantic(members, values), shared, overlap))
    assert rounded(topics.bounded_edges(members, values, shared, overlap)) == want and 40 < len(want) < n * (n - 1) / 2


def test_pairs_of_many_topics_are_few_rows(spark):
    """5,000 topics whose vectors lie anywhere: far fewer rows than pairs."""
    rng = np.random.default_rng(10)
    v = rng.normal(size=(5000, 20))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"t{i}", x.tolist()) for i, x in enumerate(unit)], "id string, v array<double>")
    rows = vectors.pairs(df, least=0.5).count()
    assert rows == int((np.triu(unit @ unit.T, 1) >= 0.5).sum()) and rows < 0.02 * 5000 * 5000


def test_betweenness_by_batches_and_pivots(spark):
    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(26)]
    pairs = {tuple(sorted(rng.sample(names[:24], 2))) for _ in range(40)}
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, strength double")
    whole = {r.node: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert {r.node: r.betweenness for r in graph.betweenness(nodes, edges, batch=7).collect()} == whole and len(whole) == 26
    assert graph.pivots(nodes).count() == 26
    some = graph.pivots(nodes, error=0.4, doubt=0.1)
    assert 5 < some.count() < 26
    got = {r.node: r.betweenness for r in graph.betweenness(nodes, edges, sources=some, batch=10).collect()}
    assert max(abs(got[n] - whole[n]) for n in names) <= 0.4


def test_a_path_of_150_nodes(spark):
    n = 150
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("strength"))
    ends = spark.createDataFrame([(0,), (n - 1,)], "node long")
    got = {r.node: r.betweenness for r in graph.betweenness(nodes, edges, sources=ends).collect()}
    # From either end, node v is passed on the way to all beyond it.
    for v in (1, 50, 148):
        both = (n - 1 - v) + v
        assert got[v] == pytest.approx(both / ((n - 1) * (n - 2)) * n / 2, abs=1e-4)
    assert got[0] == got[n - 1] == 0.0
