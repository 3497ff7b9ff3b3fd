import corpus_pipeline
from loomline.llm import leaks, mixing, shared, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == columns, name
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    prints = [r.fp for r in simhash.fingerprints(kept).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
    items = [leaks.canonical(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in leaks.canonical(r.text) for r in kept.collect() for i in items)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    # The token files keep the mixture's order.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.join(got.select("doc_id").distinct(), "doc_id")
    placed, names = mixing.in_place(kept)
    place = {r.doc_id: (r.mix_block, r.mix_order) for r in placed.select("doc_id", *names).collect()}
    seen, passes = set(), [[]]
    for r in rows:
        if r.doc_id in seen:
            passes.append([])
            seen = set()
        seen.add(r.doc_id)
        passes[-1].append(place[r.doc_id])
    assert passes[0] == sorted(passes[0]) and len(passes[0]) > 0.5 * len(rows)


def test_odd_tables(spark, tmp_path):
    """Null ids, null and repeated texts, and columns named like those the stages add; then no rows at all."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, rows[0][1] + " and more words of its own that nobody else has in this table", "en", None), (None, None, None, None), (rows[1][0], "another text under an id that is taken, with words enough to stay here", "en", "src0"), rows[2]]
    schema = "doc_id long, text string, lang string, source string, rejected int, leaked int, weight double, mix_order int"
    for name, data in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, 1, 2, 42.0, 3) for r in data], schema).write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = docs
        for title, stage in corpus_pipeline.STAGES[:4]:
            kept = shared.written(stage(spark, kept, folder), "stage")
            assert kept.columns == docs.columns, title
            assert {tuple(r) for r in kept.select("rejected", "leaked", "weight", "mix_order").collect()} <= {(1, 2, 42.0, 3)}, title
        last = corpus_pipeline.STAGES[4][1](spark, kept, folder)
        assert last.count() == kept.count() and (kept.count() > 0) == bool(data)
