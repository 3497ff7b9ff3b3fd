"""Collocations against a plain version, paths against a walk, odd rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, percent=50, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 4):
                    if i + k <= len(words):
                        counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [n for q, n in f.items() if len(q) > len(p) and n >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= percent * a for n in longer):
                continue
            score, _, cut_l, cut_r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), cut_l, cut_r))
        for rank, (score, a, p, cut_l, cut_r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, cut_l, cut_r, totals[lang], -score))
    return sorted(out)


def test_equal_to_a_plain_version(spark):
    rng = random.Random(3)
    words = ["a", "B", "über", "x y", "c", "0", "D'e", "-"]
    rows = [(("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(200)))), rng.choice(["en", "de", None, "a\tb%"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("a a a a a " * 30, "en"), ("...", "fr"), ("w" * 5000, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    got = phrases.collocations(df.repartition(3))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain(rows)
    few = phrases.collocations(df, least=5, top=7)
    assert sorted(map(tuple, few.select(COLUMNS).collect())) == plain(rows, least=5, top=7)


def test_counts_do_not_depend_on_batches(spark, monkeypatch):
    rows = [(f"one two three four {i % 7} one two", "en") for i in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string")
    whole = sorted(map(tuple, phrases.graph(df)[0].collect()))
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 20)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 300)
    assert sorted(map(tuple, phrases.graph(df.repartition(5))[0].collect())) == whole
    assert ("en", "one two", 2, 400) in whole and ("en", "three four", 2, 200) in whole


def test_longer_grams(spark):
    found, totals = phrases.graph(spark.createDataFrame([("a b c d e. b c d e",)] * 10, "text string").withColumn("lang", F.lit("x")), longest=5)
    counts = {r.phrase: r.a for r in found.collect()}
    assert counts["a b c d e"] == 10 and counts["b c d e"] == 20 and counts["d e"] == 20 and counts["a"] == 10
    assert totals.first().n == 90


def test_large_counts_are_exact(spark):
    big = 10**12
    rows = [("x", "a", 1, big), ("x", "b", 1, big + 7), ("x", "a b", 2, big - 1)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, a long")).first()
    assert got.score == 1000000 * (big - 1) ** 2 // (big * (big + 7)) and (got.l, got.r) == (big, big + 7)


def test_unary_paths(spark):
    """A long path, a fork, a closed path and an edge on its own node."""
    w = [f"w{i:03}" for i in range(70)]
    edges = [" ".join(w[i : i + 3]) for i in range(68)]
    edges += ["r s t", "s t r", "t r s", "q q q", "f g h", "g h i", "g h j"]
    df = spark.createDataFrame([("x", e, 3, 10) for e in edges] + [("y", "w001 w002 w003", 3, 10)], "lang string, phrase string, k int, a long")
    got = {(r.lang, r.phrase): (r.path, r.path_at) for r in phrases.unary_paths(df).collect()}
    assert len(got) == len(edges) + 1
    assert all(got["x", e] == (edges[0], i) for i, e in enumerate(edges[:68]))
    assert [got["x", e] for e in ("r s t", "s t r", "t r s")] == [("r s t", 0), ("r s t", 1), ("r s t", 2)]
    assert got["x", "q q q"] == ("q q q", 0) and got["x", "g h i"] == ("g h i", 0) and got["x", "g h j"] == ("g h j", 0)
    assert got["y", "w001 w002 w003"] == ("w001 w002 w003", 0)


def test_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0
