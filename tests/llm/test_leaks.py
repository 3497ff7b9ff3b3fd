import random
import re
import time

import numpy as np

from loomline.llm import leaks


def distance(pattern, text):
    """The least number of edits that turn pattern into some part of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(text):
    return " ".join(re.sub(r"[\W_]+", " ", (text or "").lower()).split())


def test_query_against_brute_force(spark):
    from loomline.llm.queries import op9_leaks

    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in op9_leaks(spark, sf).collect()}
    exact = {(d, i) for d, t in docs for i, p in items if p in t}
    assert exact and {k for k, n in got.items() if n == 0} == exact


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcdefgh")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcdefgh"))
    return "".join(chars)


def test_finds_all_within_the_budget_and_none_beyond():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(6, 40)).encode()) for i in range(12)]
    index = leaks.Index(items, 0.1)
    hits = 0
    for trial in range(60):
        i = trial % 12
        raw = items[i][1].decode()
        body = (text(80) + " " + edited(rng, raw, rng.randint(0, int(0.14 * len(raw)))) + " " + text(80)).encode()
        got = {k: n for k, n, _, _ in index.search(body)}
        for k, (_, p) in enumerate(items):
            d = distance(p, body)
            assert got.get(k) == (d if d <= index.edits[k] else None), (trial, k, d)
            hits += d <= index.edits[k]
    assert hits > 25


def test_places_of_a_match():
    item = b"the quick brown fox jumps over the lazy dog again"
    index = leaks.Index([(1, item)], 0.1)
    body = b"x " * 500 + item.replace(b"fox", b"fix") + b" y" * 500
    assert index.search(body) == [(0, 1, 1000, 1000 + len(item))]


def test_long_documents_and_parts(monkeypatch):
    monkeypatch.setattr(leaks, "PART", 512)
    item = b"some passage that is planted into a long document near a border"
    index = leaks.Index([(1, item), (2, b"another one that does not occur at all in here")], 0.1)
    for at in range(300, 1200, 37):
        body = bytes(np.random.default_rng(at).choice(list(b"abc de"), 3000))
        assert [i for i, *_ in index.search(body[:at] + item + body[at:])] == [0]


def test_an_opening_that_all_items_share():
    rng = np.random.default_rng(8)
    opening = b"which of the following statements about the given subject is true x"
    items = [(i, opening + rng.choice(np.frombuffer(b"abcdefghij klmnop", np.uint8), 90).tobytes()) for i in range(1500)]
    index = leaks.Index(items, 0.1)
    index.search(opening)
    began = time.process_time()
    assert index.search(opening * 20) == []
    assert time.process_time() - began < 2.5
    body = opening * 10 + items[700][1][:100] + b"?" + items[700][1][101:] + opening * 10
    assert [(i, n) for i, n, *_ in index.search(body)] == [(700, 1)]


def test_repetitive_texts():
    index = leaks.Index([(1, b"a" * 60), (2, b"ab" * 40 + b"c"), (3, b"na na na na na na na na batman")], 0.1)
    assert [i for i, *_ in index.search(b"a" * 5000)] == [0]
    assert [i for i, *_ in index.search(b"ab" * 3000 + b"c")] == [1]
    assert [(i, n) for i, n, *_ in index.search(b"na " * 900 + b"badman")] == [(2, 1)]
    assert index.search(b"na " * 900) == []


def test_cut_off_at_the_ends():
    item = b"a passage that is cut off at the very beginning or at the very end of a document"
    index = leaks.Index([(1, item)], 0.1)
    assert [n for _, n, *_ in index.search(item[5:] + b" and more")] == [5]
    assert [n for _, n, *_ in index.search(b"some and " + item[:-6])] == [6]
    assert index.search(item[9:]) == []


def test_the_query_finds_edited_passages(spark, tmp_path):
    from loomline.llm.queries import op9_leaks

    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bodies = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = [(d, bodies[d][:300] + " " + edited(rng, leaks.canonical(items[d % 40][1]).decode(), rng.randint(0, 14)) + " " + bodies[d][300:600]) for d in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in op9_leaks(spark, str(tmp_path)).collect()}
    index = leaks.Index([(i, leaks.canonical(t)) for i, t in items], leaks.ERRORS)
    want = {}
    for d, text in docs:
        own = d % 40
        for k in {own, (own + 1) % 40}:
            n = distance(index.items[k][1], leaks.canonical(text))
            if n <= index.edits[k]:
                want[d, items[k][0]] = n
    assert {k: n for k, n in got.items() if k in want or k[1] == items[k[0] % 40][0]} == want
    assert sum(n > 0 for n in want.values()) > 20


def test_clean_where_columns_clash(spark):
    docs = spark.createDataFrame([(1, "clean words here", 1), (2, "x the passage of a benchmark y", 2)], "doc_id long, text string, leaked int")
    bench = spark.createDataFrame([(1, "the passage of a benchmark")], "item_id long, text string")
    kept = leaks.clean(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "clean words here", 1)]


def test_odd_rows(spark):
    item = "A passage of the benchmark, which documents must not hold."
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 2), (None, f"x {item}", 3), (4, f"{item} {item}", 4), (4, "clean", 5), (5, "w " * 60_000 + item.upper(), 6), (6, item[:30], 7)], "doc_id long, text string, edits int"
    )
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "abc"), (5, item), (6, "z" * 90)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.edits) for r in leaks.find(docs, bench, block_chars=64).collect()))
    assert got == [(0, 1, 0), (0, 5, 0), (4, 1, 0), (4, 5, 0), (5, 1, 0), (5, 5, 0)]
    kept = leaks.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.edits for r in kept.collect()) == [1, 2, 5, 7]
    assert leaks.find(docs.limit(0), bench).count() == 0 and leaks.find(docs, bench.limit(0)).count() == 0


def test_short_items_keep_the_stated_budget():
    """Items of 8 to 39 characters, against cell by cell; 10 per cent of 12 characters is one edit."""
    rng = random.Random(11)
    letters = "abcdefghijklmnop"
    items = [(n, "".join(rng.choice(letters) for _ in range(n)).encode()) for n in range(8, 40)]
    found = leaks.indexes(items, 0.1)
    assert {x.q for x in found} == {5, 6, 7, 8}
    hits = 0
    for trial in range(160):
        n, raw = items[trial % len(items)]
        body = (edited(rng, "x y z " * 9, 3) + edited(rng, raw.decode(), rng.randint(0, n // 10 + 1)) + " z y x" * 9).encode()
        got = {index.items[i][0]: e for index in found for i, e, _, _ in index.search(body)}
        for size, item in items:
            d = distance(item, body)
            assert got.get(size) == (d if d <= int(0.1 * size) else None), (trial, size, d)
            hits += d <= int(0.1 * size)
    assert hits > 80


def test_items_of_a_word_or_two(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "category"), (3, "A CAT!"), (4, None), (5, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Cat"), (2, "a"), (3, "?"), (4, None), (5, "a, b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in leaks.find(docs, items).collect()}
    assert got == {(1, 1, 0), (3, 1, 0), (3, 2, 0), (5, 2, 0), (5, 5, 0)}
