"""Quality and toxicity of documents: weak labels and a hashed linear scorer.

Heuristic labellers vote on every document: bad, fine, or nothing where their measure lies between. Their votes form
patterns, and how often each pattern occurs over all documents is all that expectation-maximisation needs: it estimates
how common bad documents are, how often each labeller is right on bad and on fine ones, and every pattern's posterior.
People's labels, where documents have them, vote as one more labeller whose accuracy is estimated like the others'.
Posteriors of a bounded sample, with and without people's labels, train a linear model over hashed words and word
beginnings, which then scores every document.

Words here are runs without white space. A batch of texts is worked on at once: each of its different words is looked at
once, all of them column by column, and a document's figures are sums over its words. A document's features are those of
its distinct words.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.pages import STOP_WORDS
from loomline.llm.shared import least_hashed, small_batches, written

#: Documents that the scorer and the telling features are fitted on at most: those with the least hash. Of labelled ones
#: up to the first share; of others a third as many as labelled ones, but at least the second share.
SAMPLE, LABELLED_SHARE, OTHERS_SHARE = 12_000, 0.75, 0.1
#: Bits of a feature's hash, and the lengths of word beginnings.
BITS, BEGINNINGS = 24, (4, 5, 6, 7)
#: What a vote on a text's shape counts as a feature, beside a word's one: a text has few of the former and many of the latter.
SHAPE_COUNTS = 16
#: A feature that fewer documents of the sample have gets no weight.
LEAST_DOCS = 8
#: A feature is telling if so many documents that people call toxic have it, and so large a share of all labelled ones that do.
TELLING_DOCS, TELLING_SHARE = 8, 0.9
#: What a document without a person's label counts in the labellers' estimated accuracies, beside one with.
UNLABELLED = 0.05
#: A document goes if its chance of being bad is above this.
CUT = 0.5

# English words of abuse.
ABUSE = frozenset(
    "idiot idiots moron morons scum clown pathetic worthless loser losers stupid trash disgusting dumb imbecile bastard bitch shit fuck fucking asshole retard whore slut".split()
)
BARS, SIGNS = "|/>-*•·", "%$&*#|=~^<>{}\\"
JUNK = ("symbols", "letters", "repetition", "variety", "capitals", "stop_words", "separators", "person")
TOXIC = ("abuse", "telling", "person")
#: Characters of texts that a batch has, or one longer text.
BATCH_CHARS = 1 << 20
LETTER, UPPER, LOWER, SIGN, BAR = (1 << i for i in range(5))
# An odd number and its inverse modulo 2 ** 64: powers of one undo those of the other.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


@lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """What each code point below 2 ** 16 is, and its lower case where that is one such code point; the last two stand
    for those beyond."""
    kinds, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        sign = chr(c)
        kinds[c] = LETTER * sign.isalpha() | UPPER * sign.isupper() | LOWER * sign.islower() | SIGN * (sign in SIGNS) | BAR * (sign in BARS)
        low = sign.lower()
        if len(low) == 1 and ord(low) < 1 << 16:
            lower[c] = ord(low)
    kinds[-1] = LETTER
    return kinds, lower


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are among known ones, which ascend, and which of these each is. Most keys aren't: their low bits tell."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = known.dtype.type((1 << 20) - 1)
    there = np.zeros(1 << 20, bool)
    there[known & low] = True
    maybe = np.flatnonzero(there[keys & low])
    at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
    sure = known[at] == keys[maybe]
    return maybe[sure], at[sure]


class Words:
    """Figures of different words without white space, as columns: marks of each, and the hashed features of each."""

    def __init__(self, words: list[str]):
        kinds, lower = code_points()
        n = self.n = len(words)
        signs = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        signs = np.where(signs < 1 << 16, signs, np.where(signs < 1 << 17, 0xFFFE, 0xFFFF))  # mostly signs, then only letters
        kind, low = kinds[signs], lower[signs].astype(np.uint64)
        ends = np.flatnonzero(signs == 10)[:n]
        size = np.diff(ends, prepend=-1) - 1
        starts = ends - size
        has = lambda what: np.add.reduceat((kind & what > 0).astype(np.int64), starts) if n else np.zeros(0, np.int64)
        self.letters, self.signs = has(LETTER), has(SIGN)
        self.long = size > 1
        self.upper = self.long & (has(UPPER) > 0) & (has(LOWER) == 0)
        self.bar = (size == 1) & (kind[starts] & BAR > 0)
        # Runs of letters within the words, and the hashes of their beginnings by sums that powers of STEP tell apart.
        letter = kind & LETTER > 0
        first = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        length = np.flatnonzero(letter & ~np.append(letter[1:], False)) - first + 1
        self.run_word = np.searchsorted(ends, first)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(signs), STEP, np.uint64))
            sums = np.append(np.uint64(0), np.cumsum((low + np.uint64(1)) * powers))
            undo = np.cumprod(np.full(len(signs), BACK, np.uint64))[first]
            of = lambda at, k: mixed((sums[first[at] + k] - sums[first[at]]) * undo[at])
            self.run_hash = of(slice(None), length)
            word, feature = [self.run_word], [self.run_hash]
            for k in BEGINNINGS:
                at = np.flatnonzero(length >= k)
                word.append(self.run_word[at])
                feature.append(mixed(of(at, k) + np.uint64(k)))
        self.word = np.concatenate(word)
        self.feature = (np.concatenate(feature) >> np.uint64(64 - BITS)).astype(np.int64)

    def with_run(self, hashes: np.ndarray, only: bool = False) -> np.ndarray:
        """Which words have one of these runs of letters, or, with only, no other."""
        found = np.bincount(self.run_word[places(self.run_hash, np.sort(hashes))[0]], minlength=self.n) > 0
        return found & (np.bincount(self.run_word, minlength=self.n) == 1) if only else found


@lru_cache(maxsize=1)
def known_runs() -> tuple[np.ndarray, np.ndarray, frozenset[int]]:
    """Hashes of stop words and of words of abuse, and the features of the latter."""
    abuse = Words(sorted(ABUSE))
    return Words(sorted(STOP_WORDS)).run_hash, abuse.run_hash, frozenset(abuse.feature.tolist())


def vote(value: np.ndarray, bad: float, fine: float, asked: np.ndarray | bool = True) -> np.ndarray:
    """1 from the bound of bad values on, 0 up to that of fine ones, -1 between and where not asked; either bound may be
    the greater."""
    if bad < fine:
        value, bad, fine = -value, -bad, -fine
    return np.where(asked, np.where(value >= bad, 1, np.where(value <= fine, 0, -1)), -1)


def shape_features(junk: np.ndarray) -> np.ndarray:
    """A feature for each vote on a text's shape, beyond those of words; -1 where there is none."""
    return np.where(junk >= 0, (1 << BITS) + 2 * np.arange(junk.shape[1]) + junk, -1)


class Batch:
    """Some texts, their words and what the labellers and the scorer want to know of them."""

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        self.size, self.n = np.array([len(t) for t in texts]), np.array([len(w) for w in split], np.int64)
        place: dict[str, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(self.n.sum()))
        self.ids, self.doc, self.words = ids, np.repeat(np.arange(len(texts)), self.n), Words(list(place))
        pairs = np.sort(self.doc * max(len(place), 1) + ids)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        self.pair_doc, self.pair_word = np.divmod(pairs, max(len(place), 1))

    def total(self, marks: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, marks[self.ids], len(self.n))

    def votes(self, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of votes for each text on whether it is junk, and on whether it is toxic: 1 yes, 0 no, -1 none."""
        w, n = self.words, np.maximum(self.n, 1)
        stop, abuse, _ = known_runs()
        distinct = np.bincount(self.pair_doc, minlength=len(n))
        same = (self.ids[1:] == self.ids[:-1]) & (self.doc[1:] == self.doc[:-1])
        longs, size = self.total(w.long), np.maximum(self.size, 1)
        junk = [
            vote(self.total(w.signs) / size, 0.05, 0.01, self.n > 0),
            vote(self.total(w.letters) / size, 0.6, 0.72),
            vote(np.bincount(self.doc[1:][same], minlength=len(n)) / n, 0.2, 0.05, self.n >= 5),
            # A text of n words has fewer distinct ones for its length the longer it is.
            vote(distinct / n**0.8, 0.5, 0.7, self.n >= 40),
            vote(self.total(w.upper) / np.maximum(longs, 1), 0.5, 0.1, longs > 0),
            vote(self.total(w.with_run(stop, only=True)) / n, 0.03, 0.08, self.n >= 30),
            vote(self.total(w.bar) / n, 0.2, 0.02, self.n > 0),
        ]
        # One telling word may be chance, several hardly are.
        tells = np.bincount(w.word[places(w.feature, telling)[0]], minlength=w.n) > 0
        toxic = [(self.total(w.with_run(abuse)) > 0).astype(int), vote(np.bincount(self.pair_doc, tells[self.pair_word], len(n)), 2, 0)]
        return np.stack(junk, axis=1), np.stack(toxic, axis=1)

    def scores(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each text the sums of the weights, a row for each feature, of its words' features; features ascend."""
        w, n = self.words, len(self.n)
        at, which = places(w.feature, features)
        found = np.zeros((n, weights.shape[1]))
        for k in range(weights.shape[1]):
            found[:, k] = np.bincount(self.pair_doc, np.bincount(w.word[at], weights[which, k], w.n)[self.pair_word], n)
        return found

    def features(self, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) for each feature of each distinct word of a text, those of `among`, ascending, only."""
        word, feature = self.words.word, self.words.feature
        if among is not None:
            has, _ = places(feature, among)
            word, feature = word[has], feature[has]
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=self.words.n)
        each = count[self.pair_word]
        at = np.repeat((np.cumsum(count) - count)[self.pair_word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return np.repeat(self.pair_doc, each), feature[order][at]


def in_batches(texts: list[str]) -> Iterator[tuple[int, int, Batch]]:
    start = total = 0
    for i, t in enumerate([*texts, ""]):
        if i > start and (i == len(texts) or total + len(t) > BATCH_CHARS):
            yield start, i, Batch(texts[start:i])
            start, total = i, 0
        total += len(t)


def em(
    counts: dict[tuple[int, ...], int], unlabelled: float = 1.0, rounds: int = 500, prior: float = 0.1, right: tuple[float, float] = (0.3, 0.99), smooth: float = 2.0
) -> tuple[float, np.ndarray, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns (1, 0, or -1 for no vote): the share of positives, the chance of each
    labeller's vote being right on positives and on negatives, and every pattern's posterior of being positive.

    Labellers err independently given the truth, and keep silent regardless of it. `prior` and `right` are where the
    search starts, so that positive is what votes of 1 mean; `smooth` votes as at the start are added to each estimate.
    Documents on which the last labeller, a person, is silent count `unlabelled` in the estimates: heuristics for different
    kinds of bad documents aren't independent, which the person's votes put right. Rounds end when nothing moves any more.
    """
    patterns = list(counts)
    if not patterns:
        return prior, np.zeros(0), np.zeros(0), {}
    votes = np.array(patterns, int).reshape(len(patterns), -1)
    weight = np.array([counts[p] for p in patterns], float) * np.where(votes[:, -1] == -1, unlabelled, 1.0)
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    share, on_bad, on_fine = prior, np.full(votes.shape[1], right[0]), np.full(votes.shape[1], right[1])
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + yes @ np.log(on_bad / (1 - on_fine)) + no @ np.log((1 - on_bad) / on_fine)
        before, post = post, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        bad, fine = weight * post, weight * (1 - post)
        share = (bad.sum() + smooth * prior) / (weight.sum() + smooth)
        on_bad = np.clip((bad @ yes + smooth * right[0]) / (bad @ (yes + no) + smooth), 1e-4, 1 - 1e-4)
        on_fine = np.clip((fine @ no + smooth * right[1]) / (fine @ (yes + no) + smooth), 1e-4, 1 - 1e-4)
        if np.abs(post - before).max() < 1e-9:
            break
    return float(share), on_bad, on_fine, dict(zip(patterns, post.tolist(), strict=True))


def fit(rows: list[np.ndarray], targets: np.ndarray, features: int, rounds: int = 20, l1: float = 1e-3, rate: float = 0.3, seed: int = 11) -> np.ndarray:
    """Weights of `features` features (the last is the intercept) of a logistic model, by AdaGrad in small batches with a
    penalty on absolute weights. A row lists its features, as often as they count."""
    own, total, rng = np.zeros(features), np.zeros(features), np.random.default_rng(seed)
    if not len(rows):
        return np.append(own, 0.0)
    sizes = np.array([len(r) for r in rows])
    flat, start = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)])
    base = float(np.clip(targets.mean(), 1e-4, 1 - 1e-4))
    level, level_total = np.log(base / (1 - base)), 0.0
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), 256):
            part = order[first : first + 256]
            at = np.concatenate([flat[start[i] : start[i + 1]] for i in part])
            of = np.repeat(np.arange(len(part)), sizes[part])
            margin = np.bincount(of, own[at], len(part)) + level
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - targets[part]
            slope = np.bincount(at, error[of], features) / len(part)
            used = np.flatnonzero(slope)
            total[used] += slope[used] ** 2
            step = rate / (np.sqrt(total[used]) + 1e-6)
            moved = own[used] - step * slope[used]
            own[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            level_total += error.mean() ** 2
            level -= rate * error.mean() / (np.sqrt(level_total) + 1e-6)
    return np.append(own, level)


class Model:
    """The telling features and the scorers' weights other than zero: ascending features, for each a row of two weights, of
    junk and of toxicity, and the two intercepts. All of bounded size."""

    def __init__(self, telling: np.ndarray, features: np.ndarray, weights: np.ndarray, level: np.ndarray):
        self.telling, self.features, self.weights, self.level = telling, features, weights, level

    def chances(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its chances of being junk and of being toxic."""
        found = np.zeros((len(texts), 2))
        for a, b, batch in in_batches(texts):
            shapes = shape_features(batch.votes(self.telling)[0])
            at, which = places(shapes.ravel(), self.features)
            odds = self.level + batch.scores(self.features, self.weights)
            np.add.at(odds, at // shapes.shape[1], SHAPE_COUNTS * self.weights[which])
            found[a:b] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return found


def patterns(votes: np.ndarray) -> list[str]:
    return [",".join(map(str, v)) for v in votes.tolist()]


def voted(docs: DataFrame, telling: np.ndarray) -> DataFrame:
    """(doc_id, junk, toxic): the heuristic labellers' votes on each document (doc_id, text), as text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a, b, batch in in_batches(list(rows["text"])):
                junk, toxic = batch.votes(telling)
                yield pd.DataFrame({"doc_id": rows["doc_id"].iloc[a:b], "junk": patterns(junk), "toxic": patterns(toxic)})

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, junk string, toxic string")


def persons(labels: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(doc_id, quality, toxic), one row a document; of several labels the least quality and most toxic count."""
    if labels is None:
        return spark.createDataFrame([], "doc_id long, quality int, toxic int")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))


def with_person(cast: DataFrame) -> DataFrame:
    """Votes with the person's as the last: 1 for junk and for toxic."""
    own = lambda c: F.coalesce(c.cast("string"), F.lit("-1"))
    return cast.withColumns({"junk": F.concat_ws(",", "junk", own(1 - F.col("quality"))), "toxic": F.concat_ws(",", "toxic", own(F.col("toxic_label")))})


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sampled(rows: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(text, quality, toxic) of at most `sample` different documents, labelled and others. Chosen on keys alone."""
    keys = written(rows.select(row_key().alias("key"), "doc_id").join(known, "doc_id", "left").drop("doc_id"), "quality-keys")
    has = F.coalesce(F.col("quality"), F.col("toxic")).isNotNull()
    both = keys.agg(F.count_if(has), F.count_if(~has)).first()
    labelled, others = both[0], both[1]
    want = min(labelled, int(sample * LABELLED_SHARE))
    more = int(max(want / 3, sample * OTHERS_SHARE)) if labelled else sample
    chosen = least_hashed(keys.where(has), ["key"], want, labelled).unionByName(least_hashed(keys.where(~has), ["key"], more, others))
    chosen = written(chosen, "sampled-keys")  # so few that they are broadcast
    return written(rows.withColumn("key", row_key()).drop("doc_id").join(F.broadcast(chosen), "key").dropDuplicates(["key"]).drop("key"), "sample")


def frequencies(picked: DataFrame) -> pd.DataFrame:
    """(feature, n, bad, labelled): documents of the sample that have a feature, those of them that people call toxic and
    those that people have labelled; features of at least LEAST_DOCS."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        for rows in batches:
            for a, b, batch in in_batches(list(rows["text"])):
                doc, feature = batch.features()
                shapes = shape_features(batch.votes(none)[0])
                doc = np.concatenate([doc, np.repeat(np.arange(len(shapes)), shapes.shape[1])[shapes.ravel() >= 0]])
                feature = np.concatenate([feature, shapes[shapes >= 0]])
                pairs = np.unique(doc << 32 | feature)
                doc, feature = pairs >> 32, pairs & ((1 << 32) - 1)
                toxic = rows["toxic"].iloc[a:b].to_numpy(float)
                ids, back, n = np.unique(feature, return_inverse=True, return_counts=True)
                yield pd.DataFrame({"feature": ids, "n": n, "bad": np.bincount(back, toxic[doc] == 1, len(ids)).astype(int), "labelled": np.bincount(back, toxic[doc] >= 0, len(ids)).astype(int)})

    counted = picked.select("text", "toxic").mapInPandas(each, "feature int, n long, bad long, labelled long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")]).where(F.col("n") >= LEAST_DOCS).toPandas()


def train(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> Model:
    """The model from all documents' votes and a bounded sample of documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = written(persons(labels, docs.sparkSession), "labels")
    picked = sampled(rows, known, sample)
    seen = frequencies(picked)
    often = np.sort(seen["feature"].to_numpy(np.int64))
    telling = set(seen["feature"][(seen["bad"] >= TELLING_DOCS) & (seen["bad"] >= TELLING_SHARE * seen["labelled"])].tolist())
    telling = np.array(sorted(telling - known_runs()[2]), np.int64)  # labellers should err independently
    # Votes are narrow; texts stay where they are. A pattern is one of three votes to the number of labellers, so that
    # their table is bounded.
    cast = voted(rows, telling).join(known.select("doc_id", "quality", F.col("toxic").alias("toxic_label")), "doc_id", "left")
    tables: list[dict[tuple[int, ...], int]] = [{}, {}]
    for r in with_person(cast).groupBy("junk", "toxic").count().collect():
        for table, votes in zip(tables, (r["junk"], r["toxic"]), strict=True):
            key = tuple(map(int, votes.split(",")))
            table[key] = table.get(key, 0) + r["count"]
    junk_post, toxic_post = em(tables[0], UNLABELLED)[-1], em(tables[1], UNLABELLED)[-1]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a, b, batch in in_batches(list(rows["text"])):
                junk, toxic = batch.votes(telling)
                doc, feature = batch.features(often)
                shapes = shape_features(junk)
                doc = np.concatenate([doc, np.repeat(np.arange(len(shapes)), shapes.shape[1] * SHAPE_COUNTS)])
                feature = np.concatenate([feature, np.repeat(shapes.ravel(), SHAPE_COUNTS)])
                has, _ = places(feature, often)
                order = np.lexsort((feature[has], doc[has]))
                cuts = np.searchsorted(doc[has][order], np.arange(1, b - a))
                at = np.split(np.searchsorted(often, feature[has][order]).astype(np.int32), cuts)
                person = lambda c, sign: [-1 if pd.isna(x) else sign(int(x)) for x in rows[c].iloc[a:b]]  # noqa: B023, E731
                junk = [junk_post[(*v, p)] for v, p in zip(junk.tolist(), person("quality", lambda x: 1 - x), strict=True)]
                toxic = [toxic_post[(*v, p)] for v, p in zip(toxic.tolist(), person("toxic", int), strict=True)]
                yield pd.DataFrame({"at": at, "junk": junk, "toxic": toxic})

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        at = [np.asarray(x, np.int32) for x in group["at"]]
        order = sorted(range(len(at)), key=lambda i: (len(at[i]), zlib.crc32(at[i])))  # whatever order rows come in
        found = [fit([at[i] for i in order], group[name].to_numpy(float)[order], len(often)) for name in ("junk", "toxic")]
        used = np.flatnonzero((found[0] != 0) | (found[1] != 0))
        return pd.DataFrame({"place": used, "junk": found[0][used], "toxic": found[1][used]})

    # One task fits: at most `sample` documents, each with features that LEAST_DOCS of them share.
    sets = picked.mapInPandas(featured, "at array<int>, junk double, toxic double").withColumn("fit", F.lit(0))
    weights = sets.groupBy("fit").applyInPandas(fitted, "place int, junk double, toxic double").toPandas().sort_values("place")
    last = (weights["place"] == len(often)).to_numpy(bool)
    values = weights[["junk", "toxic"]].to_numpy(float)
    level = values[last].sum(axis=0) if len(weights) else np.array([-5.0, -5.0])
    return Model(telling, often[weights["place"].to_numpy(int)[~last]], values[~last], level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, junk, toxic, keep) for each row of docs: the scorer's chances that it is junk or toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.chances(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "junk": found[:, 0], "toxic": found[:, 1]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(each, "doc_id long, junk double, toxic double").withColumn("keep", (F.col("junk") <= CUT) & (F.col("toxic") <= CUT))


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, junk, toxic, keep) for each row of docs (doc_id, text), by a model trained on them.

    Null and empty texts have no words and score as such. Without labels only heuristics vote. Rows that repeat score
    alike. An empty table gives an empty result; other columns are ignored.
    """
    return score(docs, train(docs, labels, sample))


def keep(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay, whatever their names."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series((shared.value.chances([t or "" for t in texts]) <= CUT).all(axis=1))

    return docs.where(kept(F.col("text")))
