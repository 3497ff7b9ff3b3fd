import zlib
from collections import defaultdict

import numpy as np

from loomline.llm import sharding


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and 60 < (a != b).sum() < 180


def test_query(spark, sf_dir):
    from loomline.llm.queries import op6_sharding

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in docs], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    rows = op6_sharding(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        key = hashed[r.doc_id] % 2**64
        assert (r.shard, r.grown_shard) == (slow_jump(key, 16), slow_jump(key, 17))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_odd_rows(spark):
    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (1, "é"), (2, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, shard int, key string")
    got = sharding.assign(docs, 3, 2).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 2, 3, 100_001]
    assert len({r.shard for r in got if r.doc_id is None}) == len({r.shard for r in got if r.doc_id == 1}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(docs.limit(0)).count() == 0
