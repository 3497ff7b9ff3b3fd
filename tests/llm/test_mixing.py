import math
from collections import Counter, defaultdict

import pytest

from loomline.llm import mixing


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


@pytest.mark.parametrize(("share", "passes", "budget"), [(0.98, None, 1.0), (None, 1.5, 1.0), (0.99, 1.2, 1.0), (0.9, None, 0.4)])
def test_weights_meet_the_target(spark, share, passes, budget):
    sizes = {"a": 900, "b": 80, "c": 40, "d": 5}
    rows = [(i, f"w{i} " * (1 + i % 7), s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    got = mixing.mix(docs, share, passes, budget).collect()
    weights = {r.source: r.weight for r in got}
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    ratio = max(budget * weights[s] * total / tokens[s] for s in sizes)
    goal = share * math.log(4) if share else None
    tight = []
    if goal is not None:
        assert entropy(weights.values()) <= goal + 1e-6
        tight.append(math.isclose(entropy(weights.values()), goal, rel_tol=1e-4))
    if passes:
        assert ratio <= passes + 1e-6
        tight.append(math.isclose(ratio, passes, rel_tol=1e-4))
    assert any(tight)
    had = defaultdict(int)
    for r in got:
        had[r.source] += len(r.text.split())
    for s in sizes:
        assert 0 <= had[s] - weights[s] * budget * total + 1e-3 <= 8, s
    times = Counter((r.doc_id, r["pass"]) for r in got)
    assert max(times.values()) == 1
    # A pass begins only when the one before has every document of the source.
    for s, n in sizes.items():
        passes_of = Counter(r["pass"] for r in got if r.source == s)
        assert all(passes_of[p] == n for p in range(len(passes_of) - 1))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b", None, 1), (2, None, "e", 2), (3, "", "e", 3), (None, "x y z", "f", 4), (4, "p q", "f", 5), (4, "p q", "f", 5), (5, "w " * 50_000, "g", 6)],
        "doc_id long, text string, source string, weight int",
    )
    got = mixing.mix(docs).collect()
    assert sum(r.source == "e" for r in got) == 2 and any(r.source is None for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    one = mixing.mix(docs.where("source = 'f'"))
    assert one.count() == 3 and one.columns == ["doc_id", "text", "source", "weight", "pass", "mix_block", "mix_order", "weight_"]
    assert sorted(r.weight for r in one.collect()) == [4, 5, 5]


def test_places_worked_out_again(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 5), "ab"[i % 10 > 0]) for i in range(300)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, 0.98, 3.0)
    want = [(r.doc_id, r["pass"], r.mix_block, r.mix_order) for r in mixed.collect()]
    placed, names = mixing.in_place(mixed.select(*docs.columns))
    assert sorted((r.doc_id, *[r[n] for n in names]) for r in placed.collect()) == sorted(want) and max(w[1] for w in want) > 0


def test_query(spark, sf_dir):
    from loomline.llm.queries import op10_mixing

    got = op10_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got} <= set(docs) and len({(r.doc_id, r["pass"]) for r in got}) == len(got)
    want = sum(len((d.text or "").split()) for d in docs.values())
    assert abs(sum(r.n_tokens for r in got) - want) < 0.2 * want
