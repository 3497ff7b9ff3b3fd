"""Ranked search against scoring everything, blocks against whole lists, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def parts(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counts = [(d, Counter(parts(t)), len(parts(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(parts(t))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c, n in counts:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if unnamed else d, -s) for rank, (s, unnamed, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Über", "naïve", "I/O", "x2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 300])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])) + rng.choices(words, weights, k=4))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 50])
def test_equal_to_scoring_everything(spark, k):
    docs, items = corpus(k, 900)
    docs += docs[:40] + [(None, docs[3][1]), (None, ""), (5, None), (7, "?!"), (8, "w1 " * 30000)]
    items += [(None, "w1 w250"), (3, "zzz w7"), (99, None), (98, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")).repartition(3)
    lists = search.index(df, block=16, shard_terms=9000)
    assert lists.where("term IS NULL").count() > 3 and lists.where("heads IS NOT NULL AND term IS NOT NULL").count() > 10
    got = search.search(lists, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), k, terms_at_once=60)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def test_blocks_are_left_compressed(spark):
    """A frequent term's blocks whose bound is too low for the best documents are never decompressed."""
    docs = [(i, "common " * (1 + (i % 997 == 0)) + "filler " * (i % 50)) for i in range(20_000)] + [(30_000 + i, "rare rarer rarest common") for i in range(60)]
    rows = search.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toPandas()
    rows["term"] = rows["term"].where(rows["term"].notna(), None)
    n_docs, n_terms = len(docs), sum(len(t.split()) for _, t in docs)
    shard = search.Shard(rows, n_docs, n_terms)
    best = shard.best({"rare": 9000, "rarer": 9000, "rarest": 9000, "common": 1}, 50)
    assert [d for d, _ in best] == list(range(30_000, 30_050))
    blocks = len(shard.blocks("common")[0])
    touched = sum(key[0] == "common" for key in shard.kept if key[0] != "heads")
    assert blocks > 150 and touched <= 2


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31 - 1, 5, 2**21])
    data, ends = search.varints(values)
    assert (search.unvarints(data) == values).all() and ends[-1] == len(data) and ends[2] == 3 and ends[3] == 5
    assert len(search.unvarints(np.zeros(0, np.uint8))) == 0


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert search.search(search.index(none), items).count() == 0
    assert search.search(search.index(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")), items).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert search.search(search.index(docs), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(search.index(docs), items).collect()] == [(1, 1, 1)]
