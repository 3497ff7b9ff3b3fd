"""Fingerprints against exact similarities and hashes, near duplicates against all pairs, odd rows."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import minhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n))


def test_estimates_are_near_the_truth():
    rng = random.Random(1)
    errors = []
    for _ in range(150):
        words = sentence(rng, 300).split()
        other = [w if rng.random() > 0.03 else "x" for w in words]
        one, two = " ".join(words), " ".join(other)
        errors.append(minhash.likeness(*(minhash.fingerprint(minhash.signature(t)) for t in (one, two))) - jaccard(shingles(one), shingles(two)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    alike = minhash.fingerprint(minhash.signature("a b c"))
    assert minhash.likeness(alike, minhash.fingerprint(minhash.signature("A  b\tc"))) == 1.0
    assert minhash.likeness(alike, minhash.fingerprint(minhash.signature(""))) < 0.1


def test_query(spark, sf_dir):
    from loomline.llm.queries import op11_fingerprints

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op11_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (doc_id, text), (next_id, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert abs(row.near_edited - jaccard(shingles(text), shingles(new))) < 0.25 and abs(row.near_next - jaccard(shingles(text), shingles(following))) < 0.25
        assert row.near_next == minhash.likeness(bytes.fromhex(row.fingerprint), bytes.fromhex(got[next_id].fingerprint))


def test_odd_rows(spark):
    rows = [(3, "c " * 40), (1, "a b"), (None, "n" * 9), (None, None), (2, ""), (3, "d e f g h"), (3, "d e f g h"), (9, "Ü" * 4001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = minhash.fingerprints(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 3].edited_sha256 == hashlib.sha256(b"a b").hexdigest() and by[2, 0].near_edited == 1.0
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 3) == 1  # the two equal ones follow one another
    assert minhash.fingerprints(df.limit(0)).count() == 0
    one = minhash.fingerprints(df.where("doc_id = 9")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(("Ü" * 4001).encode()).hexdigest())


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(7)
    docs = []
    for _ in range(12):
        words = sentence(rng, 120).split()
        for _ in range(8):
            docs.append(" ".join(words))
            for _ in range(rng.randrange(4)):  # chains of ever further copies
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    docs += [docs[0]] * 30 + ["", None, " \n", "one two", "One  two", "one three"]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    sets = {i: shingles(t) for i, t in zip(ids, docs, strict=True)}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").withColumn("component", F.lit(1))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.repartition(3)).collect()}
    assert got == {i: find(i) for i in ids}


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h i j k l m n"
    rows = [(None, text), (None, "z y x w v u t"), (5, text), (5, "q w e r t y u i o p"), (5, "q w e r t y u i o p"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (0, 0), (0, 5), (5, 5), (5, 5), (5, 5)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
