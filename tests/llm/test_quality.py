import numpy as np
import pytest

from loomline.llm import quality


NONE = np.zeros(0, np.int64)


def patterns(votes):
    found, counts = np.unique(votes, axis=0, return_counts=True)
    return {tuple(map(int, p)): int(c) for p, c in zip(found, counts, strict=True)}


def test_em_finds_the_accuracies_that_made_the_votes():
    rng = np.random.default_rng(2)
    truth = rng.random(60_000) < 0.15
    on_bad, on_fine = [0.9, 0.7, 0.5, 0.3], [0.99, 0.95, 0.9, 0.97]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, -1, np.where(truth, rng.random(len(truth)) < a, rng.random(len(truth)) > b)) for a, b in zip(on_bad, on_fine, strict=True)], axis=1)
    share, bad, fine, posts = quality.em(patterns(votes))
    assert abs(share - 0.15) < 0.02 and np.abs(bad - on_bad).max() < 0.05 and np.abs(fine - on_fine).max() < 0.02
    # Ranked from votes alone, and so are the patterns: two weak votes weigh less than the best labeller's.
    assert list(np.argsort(-bad)) == [0, 1, 2, 3] and posts[1, 0, 0, 0] > posts[0, 0, 1, 0] and posts[0, 0, 0, 0] < 0.02
    best = np.array([posts[tuple(map(int, v))] > 0.5 for v in votes])
    assert (best == truth).mean() > 0.96
    assert quality.em({})[-1] == {}


def test_em_learns_that_a_labeller_is_worthless():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.2
    said = [np.where(rng.random(len(truth)) < 0.92, truth, ~truth) for _ in range(3)]
    _, bad, fine, posts = quality.em(patterns(np.stack([*said, rng.random(len(truth)) < 0.3], axis=1).astype(int)))
    assert np.abs(bad[:3] - 0.92).max() < 0.03 and np.abs(bad[3] + fine[3] - 1) < 0.05
    assert abs(posts[1, 1, 0, 1] - posts[1, 1, 0, 0]) < 0.05 and posts[0, 0, 0, 1] < 0.05


def test_fit_learns_a_telling_feature():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.2
    rows = [np.unique(np.concatenate([rng.integers(10, 5000, 40), [1] if bad else [2]])).astype(np.int32) for bad in y]
    w = quality.fit(rows, y.astype(float), 5000)
    odds = np.array([w[r].sum() + w[-1] for r in rows])
    assert ((odds > 0) == y).mean() > 0.99


@pytest.mark.parametrize(
    ("text", "junk"),
    [("the cat sat on the mat and it was good. " * 3, False), ("It is a line of plain words, as good as any, and nothing is wrong with it.", False), ("%$& " * 60, True), ("word " * 80, True), ("ALL OF THIS IS IN CAPITALS AND SO ON", True), ("a | b | c | d | e | f | g", True)],
)
def test_votes(text, junk):
    votes = quality.Batch([text]).votes(NONE)[0][0].tolist()
    assert (1 in votes) == junk and 0 in votes


def test_words_in_columns_equal_words_one_by_one():
    words = ["The", "idiot,", "don't", "|", "NASA's", "$5*", "Straße", "ÉTÉ", "日本", "x1y", "–", "😀a", "unbelievably", "\U00020000", "A", "•", "1st"]
    w = quality.Words(words)
    assert w.letters.tolist() == [sum(c.isalpha() for c in x) for x in words] and w.signs.tolist() == [sum(c in quality.SIGNS for c in x) for x in words]
    assert w.upper.tolist() == [len(x) > 1 and x.isupper() for x in words] and w.bar.tolist() == [len(x) == 1 and x in quality.BARS for x in words]
    stop, abuse, _ = quality.known_runs()
    assert [x for x, yes in zip(words, w.with_run(stop, only=True), strict=True) if yes] == ["The", "ÉTÉ", "😀a", "A"]
    assert [x for x, yes in zip(words, w.with_run(abuse), strict=True) if yes] == ["idiot,"]
    of = lambda x: sorted(quality.Words([x]).feature.tolist())
    for i, x in enumerate(words):
        assert sorted(w.feature[w.word == i].tolist()) == of(x), x
    assert of("Idiot!") == of("idiot") and len(of("unbelievably")) == 5 and len(set(of("unbelievably")) & set(of("unbelief"))) == 4
    assert len(quality.Words([]).feature) == 0


def test_features_of_a_batch():
    texts = ["the cat the CAT sat", "", "unbelievable cats", "cat"]
    batch = quality.Batch(texts)
    doc, feature = batch.features()
    for i, t in enumerate(texts):
        assert sorted(feature[doc == i]) == sorted(x for w in set(t.split()) for x in quality.Words([w]).feature)
    known = np.unique(feature)
    want = [sum(float(np.searchsorted(known, x)) for x in feature[doc == i]) for i in range(len(texts))]
    assert np.allclose(batch.scores(known, np.arange(len(known), dtype=float)[:, None])[:, 0], want)


def test_stop_words_count_to_the_end_of_a_long_text():
    names, prose = [f"Name{i}" for i in range(21_000)], ["the", "cat", "sat", "on", "a", "mat"] * 8_000
    at = quality.JUNK.index("stop_words")
    assert quality.Batch([" ".join(names + prose)]).votes(NONE)[0][0, at] == 0
    few = prose[:21_000] + [f"word{i}" for i in range(1_000_000)]
    assert quality.Batch([" ".join(few)]).votes(NONE)[0][0, at] == 1


def test_held_out_labels(spark):
    """Of the labelled documents a fifth is kept from training; the others' labels and all texts are used.

    Some documents labelled toxic have no word that others of their kind have, and in Spanish there are about 30 of them.
    """
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = quality.classify(docs, labels.where(~held)).withColumnRenamed("toxic", "p").join(labels.where(held), "doc_id").toPandas()
    junk, toxic = found["quality"] == 0, found["toxic"] == 1
    assert ((found["junk"] > 0.5) == junk).mean() > 0.99
    assert (found["p"] > 0.5)[toxic].mean() > 0.8
    assert (found["p"] > 0.5)[~toxic].mean() < 0.01


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "the cat and the dog are here"), (3, "%$&* " * 50), (3, "%$&* " * 50), (4, "the " + "w " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, junk int, rejected string")
    labels = spark.createDataFrame([(3, 0, 0), (3, 0, 1), (None, 1, 0), (9, None, None), (1, None, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, None, labels.limit(0)):
        got = quality.classify(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.junk <= 1 and 0 <= r.toxic <= 1 for r in got)
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0
