"""Collocations by a weighted de Bruijn graph of words.

A node is a phrase of longest - 1 words, an edge a phrase of `longest` words between the two nodes that overlap in it.
Each place in a text gives one gram: the words from there on, `longest` of them or as many as its piece still has. Whole
grams are the edges, shorter ones the piece ends. A shorter phrase's count is the flow out of it, which is the edges that
begin with it, and the piece ends that do; both are sums, so each task derives them from the edges of its own texts and
Spark adds up what the tasks have. Counts travel packed by a hash of the phrase: a task sends a phrase once, however
often it occurs, so no phrase is hot. Frequent edges are chained into unary paths by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import components, shared_dir, small_batches, written

#: What ends a piece, what parts words, and the language of texts that have none.
PIECE_ENDS, BLANKS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
BLANKED = bytes.maketrans(PIECE_ENDS + BLANKS, b"." * len(PIECE_ENDS) + b" " * len(BLANKS))
#: A task counts so many words at a time; a bucket of phrases is that of so many bytes of text.
WORDS_AT_ONCE, BUCKET_BYTES = 2_000_000, 6_000_000
ID_BITS = 21


def word_list(text: str) -> list[bytes]:
    """The text's words, A-Z in lower case, with b"." where a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(BLANKED).replace(b".", b" . ").split()


class Numbered(dict):
    """Words by the order in which they were first seen, from 1; 0 ends a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def edges(ids: list[int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, a row of `longest` word numbers each with zeros after its end, and their numbers."""
    words = np.array([*ids, *[0] * longest], np.int64)
    n = len(words) - longest
    columns, going = [words[:n]], words[:n] > 0
    begins = going
    for k in range(1, longest):
        going = going & (words[k : k + n] > 0)
        columns.append(np.where(going, words[k : k + n], 0))
    if longest * ID_BITS < 64 and words.max(initial=0) < 1 << ID_BITS:
        key = np.zeros(n, np.int64)
        for column in columns:
            key = key << ID_BITS | column
        keys, times = np.unique(key[begins], return_counts=True)
        return np.stack([keys >> ID_BITS * (longest - 1 - k) & ((1 << ID_BITS) - 1) for k in range(longest)], axis=1), times
    return np.unique(np.stack(columns, axis=1)[begins], axis=0, return_counts=True)


def flows(grams: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of `length` words and their numbers: of ordered grams, those that begin with the phrase."""
    there = grams[:, length - 1] > 0
    grams, times = grams[there], times[there]
    if not len(grams):
        return grams, times
    first = np.flatnonzero(np.concatenate([[True], (grams[1:, :length] != grams[:-1, :length]).any(axis=1)]))
    out = grams[first].copy()
    out[:, length:] = 0
    return out, np.add.reduceat(times, first)


def packed(numbers: Numbered, of_lang: dict[str, list[int]], longest: int, buckets: int) -> Iterator[pd.DataFrame]:
    """(bucket, data): the counts of what a task has read, each bucket's phrases and their numbers compressed."""
    words = list(numbers)
    words[0] = b""
    marks = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    pack = zstandard.ZstdCompressor(level=1)
    for lang, ids in of_lang.items():
        begin = quote(lang, safe="").encode() + b"\t"
        grams, times = edges(ids, longest)
        levels = [flows(grams, times, k) for k in range(longest, 0, -1)]
        grams, times = np.concatenate([g for g, _ in levels]), np.concatenate([t for _, t in levels])
        mark = np.full(len(grams), xxhash.xxh64_intdigest(begin), np.uint64)
        for column in grams.T:
            mark = (mark ^ marks[column]) * np.uint64(0x9E3779B97F4A7C15)
            mark ^= mark >> np.uint64(29)
        bucket = ((mark >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        grams, times, bucket = grams[order], times[order], bucket[order]
        ends = [*np.flatnonzero(np.diff(bucket)).tolist(), len(bucket) - 1] if len(bucket) else []
        at, out = 0, []
        for end in ends:
            columns = [[words[i] for i in column] for column in grams[at : end + 1].T.tolist()]
            phrases = b"\n".join([begin + b" ".join(x).rstrip(b" ") for x in zip(*columns, strict=True)])
            out.append((int(bucket[at]), pack.compress(times[at : end + 1].astype("<i8").tobytes() + phrases), end + 1 - at))
            at = end + 1
        yield pd.DataFrame(out, columns=["bucket", "data", "phrases"])


def counted(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, data, phrases): packed counts of all phrases of 1 to `longest` words, in which a phrase has one bucket."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, of_lang, held = Numbered(), {}, 0
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                parts = word_list(text)
                ids = of_lang.setdefault(lang, [])
                ids += [numbers[w] for w in parts]
                ids.append(0)
                held += len(parts) + 1
                if held >= WORDS_AT_ONCE or len(numbers) >= 1 << (ID_BITS - 1):
                    yield from packed(numbers, of_lang, longest, buckets)
                    numbers, of_lang, held = Numbered(), {}, 0
        yield from packed(numbers, of_lang, longest, buckets)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).mapInPandas(each, "bucket int, data binary, phrases int")


def graph(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). phrases (lang, phrase, k, a): every phrase of k = 1 to `longest` words that occurs at least
    `least` times, a its number of occurrences within pieces, overlaps included. totals (lang, n): all word occurrences."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unpack, found = zstandard.ZstdDecompressor(), {}
        for data, n in zip(rows["data"], rows["phrases"], strict=True):
            whole = unpack.decompress(data)
            for phrase, times in zip(whole[8 * n :].split(b"\n"), np.frombuffer(whole[: 8 * n], "<i8").tolist(), strict=True):
                found[phrase] = found.get(phrase, 0) + times
        out, totals = [], {}
        for both, a in found.items():
            lang, phrase = both.split(b"\t")
            k = phrase.count(b" ") + 1
            if k == 1:
                totals[lang] = totals.get(lang, 0) + a
            if a >= least:
                out.append((lang, phrase, k, a))
        out += [(lang, None, 0, n) for lang, n in totals.items()]
        named = {x: unquote(x.decode()) for x in {row[0] for row in out}}
        text = [(named[lang], None if p is None else p.decode("utf-8", "surrogatepass"), k, a) for lang, p, k, a in out]
        return pd.DataFrame(text, columns=["lang", "phrase", "k", "a"])

    found = written(counted(docs, longest, buckets).groupBy("bucket").applyInPandas(merged, "lang string, phrase string, k int, a long"), "phrases")
    return found.where("k > 0"), found.where("k = 0").groupBy("lang").agg(F.sum("a").alias("n"))


def scored(phrases: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, phrase, k, a, l, r, score, cut) of the phrases of two words and more: of all cuts the one with the lowest
    floor(1000000 * a * a / (l * r)), ties to the smallest cut. Parts are at least as frequent as the whole, so all are
    there. Products are decimals of 38 digits."""
    parts = phrases.select("lang", "phrase", F.col("a").alias("of"))
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("right"))
    both = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("of").alias("l")), ["lang", "left"])
    both = both.join(parts.select("lang", F.col("phrase").alias("right"), F.col("of").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    top = (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    both = both.withColumn("top", top.cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    both = both.withColumn("score", F.expr("top div under").cast("long"))
    least = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    return least.select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score", "c.cut")


def covered(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """(lang, phrase): phrases of two words and more that lie inside a longer frequent phrase which accounts for at least
    `percent` per cent of their occurrences."""
    words = F.split("phrase", " ")
    inside = phrases.where("k > 2").select("lang", "k", "a", words.alias("w")).select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inside = inside.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(F.lit(100) * F.col("longer") >= F.lit(percent) * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path, path_at): of each language the first `top` phrases of 2 to `longest`
    words by score, then a, then phrase in byte order. path and path_at: the unary path of frequent edges on which a
    phrase of `longest` words lies, named by its first edge, and the place there; null for shorter ones.

    A null text has no words, a null language is "und", repeated rows count as often as they stand there. No table, text
    or frequent phrase gives no row. Columns of docs besides text and lang are ignored.
    """
    phrases, totals = graph(docs, longest, least)
    kept = scored(phrases, longest).join(covered(phrases, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = first.join(totals, "lang").join(unary_paths(phrases, longest), ["lang", "phrase"], "left")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "path", "path_at")


def unary_paths(phrases: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, phrase, path, path_at) of every edge, which is a phrase of `longest` words: edges follow one another in a
    path where the node between them has no other edge in or out. path is the first edge of the path and path_at the
    place in it, from 0; a path that closes on itself begins at its least edge."""
    shared_dir(phrases.sparkSession)
    words = F.split("phrase", " ")
    node = lambda at: F.concat("lang", F.lit("\t"), F.array_join(F.slice(words, at, longest - 1), " "))
    all_edges = phrases.where(F.col("k") == longest).select(F.concat("lang", F.lit("\t"), "phrase").alias("edge"), node(1).alias("from"), node(2).alias("to"))
    into = all_edges.groupBy("to").agg(F.count(F.lit(1)).alias("ins"), F.min("edge").alias("before")).where("ins = 1")
    out = all_edges.groupBy("from").agg(F.count(F.lit(1)).alias("outs"), F.min("edge").alias("edge")).where("outs = 1")
    links = written(out.join(into, F.col("from") == F.col("to")).where("edge <> before").select("edge", "before"), "unary-links")
    placed, open_ = _chained(links)
    if not open_.isEmpty():  # what closes on itself is cut before its least edge
        least = components(open_, "edge", "before").select(F.col("component").alias("edge")).distinct()
        placed = placed.unionByName(_chained(open_.join(least, "edge", "left_anti"))[0])
    found = all_edges.select("edge").join(placed, "edge", "left").select("edge", F.coalesce("path", "edge").alias("path"), F.coalesce("path_at", F.lit(0)).cast("long").alias("path_at"))
    after = lambda c: F.substring_index(c, "\t", -1)  # noqa: E731  words have no tab, languages may
    return found.select(F.expr("left(edge, length(edge) - length(substring_index(edge, '\t', -1)) - 1)").alias("lang"), after("edge").alias("phrase"), after("path").alias("path"), "path_at")


def _chained(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge, path, path_at) of all edges that have one before them, by pointer jumping: each round looks twice as far
    back. And the links (edge, before) whose way back never ends: once a round ends no way, none that is left does."""
    state = links.select("edge", F.col("before").alias("path"), F.lit(1).cast("long").alias("path_at"), F.lit(False).alias("done"))
    ended = state.join(links.select(F.col("edge").alias("path")), "path", "left_anti").select("edge", "path", "path_at", F.lit(True).alias("done"))
    state = state.join(ended.select("edge"), "edge", "left_anti").unionByName(ended).checkpoint()
    left = state.where("NOT done").count()
    while left:
        back = state.select(F.col("edge").alias("path"), F.col("path").alias("further"), F.col("path_at").alias("more"), F.col("done").alias("ends"))
        walked = state.where("NOT done").join(back, "path").select("edge", F.col("further").alias("path"), (F.col("path_at") + F.col("more")).alias("path_at"), F.col("ends").alias("done"))
        state = state.where("done").unionByName(walked).checkpoint()
        now = state.where("NOT done").count()
        if now == left:
            break
        left = now
    return state.where("done").select("edge", "path", "path_at"), links.join(state.where("NOT done").select("edge"), "edge", "left_semi")
