import random
import re

import pytest
import xxhash

from loomline.llm import simhash


def slow_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def unsigned(x):
    return x & (2**64 - 1)


def test_query_equals_brute_force(spark, sf_dir):
    from loomline.llm.queries import op5_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d.doc_id: slow_fingerprint(d.text, 3) for d in docs}
    want = slow_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [1, 64])
def test_links_connect_as_all_pairs_do(spark, radius, hot):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: base[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(90)}
    signed = {f - (1 << 64) if f >> 63 else f: min(i for i in prints if prints[i] == f) for f in prints.values()}
    nodes = spark.createDataFrame(list(signed.items()), "fp long, rep long")
    found = simhash.components(simhash.links(nodes, radius, hot))
    got = {r.node: r.component for r in found.collect()}
    want = slow_components({rep: unsigned(fp) for fp, rep in signed.items()}, radius)
    assert {i: got.get(i, i) for i in want} == want


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "A B  C\nd"), (3, None), (4, ""), (None, "a b c d"), (5, "x"), (5, "x"), (6, "É é"), (7, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, unsigned(r.fp)): r.component_id for r in got}
    f = lambda t: slow_fingerprint(t, 3)
    assert by[(1, f("a b c d"))] == by[(2, f("a b c d"))] == by[(None, f("a b c d"))] == 1
    assert by[(3, 0)] == by[(4, 0)] == 3
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_or_with_repeated_ids_are_documents_of_their_own(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (None, texts[3]), (2, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, stay int"))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[0])], key=str)


def jaccard_groups(texts, least=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_similar_groups_equal_brute_force(spark, sf_dir):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))] for _ in range(8)]
    notice = [f"notice{i}" for i in range(40)]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
            texts.append(" ".join(notice + [f"y{rng.randrange(10**6)}" for _ in range(20)]))
    want = jaccard_groups(texts)
    got = {r.key: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()}
    of = lambda labels: {frozenset(i for i in labels if labels[i] == g) for g in set(labels.values())}
    assert of(got) == of(dict(enumerate(want)))
    kept = simhash.keep_one(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in of(got))


def test_rows_without_id_link_others(spark, monkeypatch):
    """0 and 15 differ in four bits; 3 lies between them and has no id."""
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    got = simhash.near_duplicates(prints)
    assert sorted((r.fp, r.component_id or 0) for r in got.collect()) == [(-1, 0), (0, 1), (3, 1), (15, 1)]


def test_components_join_an_edge_but_a_few_times(spark, monkeypatch):
    """Paths, stars, hubs of high and low ids, and a dense group; what rounds write stays a few times the edges."""
    from loomline.llm import shared

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000 - i, 999 - i) for i in range(300)] + [(2000 + i, 5000 + i % 7) for i in range(120)] + [(2000 + i, 2060 + i) for i in range(0, 60, 9)]
    edges += [(6000 + rng.randrange(300), 6000 + rng.randrange(300)) for _ in range(3000)] + [(7, 7), (None, 8), (9, None), (-5, 8000)]
    root = {x: x for e in edges if None not in e for x in e}
    for a, b in edges:
        if a is not None and b is not None and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    rows, real = [], shared.written

    def counted(df, name):
        table = real(df, name)
        rows.append((name, table.count()))
        return table

    monkeypatch.setattr(shared, "written", counted)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in shared.components(frame).collect()}
    assert got == root
    first, *later = [n for name, n in rows if name == "component-edges"]
    assert sum(later) < first / 2
    assert shared.components(frame.limit(0)).count() == 0
