import math

import numpy as np
import pytest

from loomline.llm import vectors


def slow(rows, threshold=0.9):
    ids = [i for i, _ in rows]
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, links = len(rows), np.zeros((len(rows), len(rows)), bool)
    for length in {len(v) for (_, v), ok in zip(rows, fine, strict=True) if ok}:
        at = [k for k in range(n) if fine[k] and len(rows[k][1]) == length]
        m = np.array([rows[k][1] for k in at], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        links[np.ix_(at, at)] = m @ m.T >= threshold
    np.fill_diagonal(links, False)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (int(links[i].sum()), least[find(i)]) for i in range(n)}


def check_recall(want, got):
    assert got.keys() == want.keys()
    wanted = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.9 * wanted
    assert all(got[i][0] <= want[i][0] for i in want)
    return sum(got[i] == want[i] for i in want) / len(want)


def test_query_against_brute_force(spark):
    from loomline.llm.queries import op7_vectors

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = op7_vectors(spark, sf).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert check_recall(slow(rows), {r.vec_id: (r.n_links, r.component_id) for r in found}) > 0.97


@pytest.mark.parametrize("cells", [12, 60, 200])
def test_recall_of_planted_pairs_over_many_cells(spark, cells):
    """To each of 1,500 of the tables' own vectors one is added whose cosine with it is 0.9 to 0.92, and to others 0.92 to 0.97."""
    rng = np.random.default_rng(cells)
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    made = []
    for k, (i, v) in enumerate(rows[:1500]):
        v = v / np.linalg.norm(v)
        side = rng.normal(size=len(v))
        side -= (side @ v) * v
        c = rng.uniform(0.9, 0.92) if k % 2 else rng.uniform(0.92, 0.97)
        made.append((100_000 + i, c * v + (1 - c * c) ** 0.5 * side / np.linalg.norm(side)))
    rows = [(i, v.tolist()) for i, v in rows + made]
    want = slow(rows)
    assert sum(n for n, _ in want.values()) >= 2990
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame, cells=cells * (10_000 / len(rows)) ** 0.5).collect()}
    assert check_recall(want, got) > 0.97


def test_cells_asked_grow_slowly(spark):
    rng = np.random.default_rng(1)
    asked = []
    for n in (1500, 7500):
        centre = vectors.centroids(vectors.units(list(rng.normal(size=(n, 64)))), round(vectors.CELLS * (n / 10_000) ** 0.5))
        near = vectors.units(list(rng.normal(size=(n, 64)))) @ centre.T
        asked.append((near >= near.max(axis=1, keepdims=True) - vectors.margin_of(0.9, 64)).sum())
    assert asked[1] < 12 * asked[0]


@pytest.mark.parametrize(("cells", "block"), [(80, 16), (25, 1024), (35, 7)])
def test_cells_and_blocks_lose_nothing_here(spark, cells, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    made = [base[i % 12] + rng.normal(size=16) * 0.25 * (i % 3) for i in range(300)] + [base[0]] * 20
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, cells=cells, block=block).collect()}
    assert check_recall(slow(rows), got) > 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 1e-300]), (12, [1e300, 1e300])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n long, rep long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}
    assert got == alone | {7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False), 11: (1, 11, True), 12: (1, 11, False)}
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.1]), (None, [0.0, 1.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(unnamed).collect()), key=str)
    assert got == sorted([(None, 3, 3), (None, 3, 3), (3, 3, 3), (4, 3, 3), (None, 0, None)], key=str)
