"""Ranked lexical search: compressed inverted lists in shards of documents, searched by Block-Max MaxScore.

Each task turns the documents it reads into shards of bounded size: a term's list is cut into blocks, which are compressed
one by one and keep their highest frequency and shortest document outside. No text is shuffled. A search sends the lists of
the queries' terms, and no others, to one group per shard. There the lists' bounds part essential lists from the rest:
documents that only the rest hold can't be among the best. For those found in essential lists the bounds of the blocks
they fall into, in the other lists, reject most before these blocks are decompressed. The shards' heaps are merged by
Spark. All bounds are upper bounds in the integers of the score itself, so the result is that of scoring everything.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import written

#: ASCII letters and digits and everything beyond ASCII make up terms.
LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Postings in a block, terms with repeats in a shard, rows in a batch.
BLOCK, SHARD_TERMS, ROWS = 128, 2_000_000, 50_000
#: Terms of queries searched for at once in a group, and bytes of distinct terms up to which they are broadcast.
QUERY_TERMS, BROADCAST_BYTES = 50_000, 8 << 20
INDEX = "shard long, term string, n long, max_tf long, min_n long, heads binary, data binary"


def term_list(text: str | None) -> list[bytes]:
    """The text's terms in order, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, the last of a value below 128, and where each value ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    rest, more = values.astype(np.int64), np.arange(len(values))
    at = ends - size
    while len(more):
        last = rest < 128
        out[at] = np.where(last, rest, rest & 127 | 128)
        rest, at = rest[~last] >> 7, at[~last] + 1
        more = more[~last]
    return out, ends


def unvarints(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins) if len(ends) else np.zeros(0, np.int64)


def shard_rows(shard: int, ids: array, lengths: list[int], doc_ids: list[int | None], words: list[bytes], block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents (a null term), then a row per term with its list."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("max_tf", pa.int64()), ("min_n", pa.int64()), ("heads", pa.binary()), ("data", pa.binary())])
    size = np.array(lengths, np.int64)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    row = [[shard], [None], [int((size > 0).sum())], [int(size.sum())], [len(size)], [size.astype("<i8").tobytes()], [named + nulls]]
    yield pa.record_batch([pa.array(x, field.type) for x, field in zip(row, schema, strict=True)], schema=schema)
    if not ids:
        return
    docs = len(size)
    key, tf = np.unique(np.frombuffer(ids, np.int32).astype(np.int64) * docs + np.repeat(np.arange(docs), size), return_counts=True)
    term, doc = key // docs, key % docs
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    of_list = np.repeat(starts, np.diff([*starts, len(term)]))
    opens = (np.arange(len(term)) - of_list) % block == 0
    gap = np.where(opens, doc, doc - np.concatenate([[0], doc[:-1]]))
    both = np.empty(2 * len(doc), np.int64)
    both[::2], both[1::2] = gap, tf
    coded, ends = varints(both)
    ends = ends[1::2]
    blocks = np.flatnonzero(opens)
    last = np.concatenate([blocks[1:], [len(doc)]]) - 1
    most, least = np.maximum.reduceat(tf, blocks), np.minimum.reduceat(size[doc], blocks)
    block_of = np.searchsorted(blocks, starts)
    list_most, list_least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(size[doc], starts)
    counts = np.diff([*starts, len(term)])
    ends_of = np.concatenate([[0], ends])
    body, block_end = coded.tobytes(), np.concatenate([block_of[1:], [len(blocks)]])
    heads: list[bytes | None] = [None] * len(starts)
    for i in np.flatnonzero(counts > block).tolist():
        a, b = int(block_of[i]), int(block_end[i])
        begin = ends_of[starts[i]]
        heads[i] = np.stack([doc[blocks[a:b]], doc[last[a:b]], most[a:b], least[a:b], ends[last[a:b]] - begin]).astype("<i4").tobytes()
    cut = ends_of[[*starts, len(term)]].tolist()
    names = [words[i] for i in term[starts].tolist()]
    for at in range(0, len(starts), ROWS):
        to = min(at + ROWS, len(starts))
        yield pa.record_batch(
            [
                pa.array(np.full(to - at, shard)), pa.array(names[at:to], pa.binary()).cast(pa.string()), pa.array(counts[at:to]), pa.array(list_most[at:to]), pa.array(list_least[at:to]),
                pa.array(heads[at:to], pa.binary()), pa.array([body[a:b] for a, b in zip(cut[at:to], cut[at + 1 : to + 1], strict=True)], pa.binary()),
            ],
            schema=schema,
        )


def index(docs: DataFrame, block: int = BLOCK, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The inverted lists of all documents, a table in the shared folder: a row per shard and term with the list's length n,
    its highest frequency, its shortest document, its blocks (first and last document, highest frequency, shortest
    document, where the block ends) and its compressed postings. A null term has the shard's documents.

    A null text has no terms. Rows without or with repeated ids are documents of their own. Further columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        shard = TaskContext.get().partitionId() << 24
        numbers, ids, lengths, doc_ids = Numbers(), array("i"), [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = term_list(text.as_py())
                ids.extend([numbers[w] for w in found])
                lengths.append(len(found))
                doc_ids.append(doc)
                if len(ids) >= shard_terms or len(lengths) >= shard_terms:
                    yield from shard_rows(shard, ids, lengths, doc_ids, list(numbers), block)
                    shard += 1
                    numbers, ids, lengths, doc_ids = Numbers(), array("i"), [], []
        if lengths:
            yield from shard_rows(shard, ids, lengths, doc_ids, list(numbers), block)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(narrow.mapInArrow(each, INDEX), "lexical-index")


class Shard:
    """One shard's lists, decompressed block by block when asked for."""

    def __init__(self, rows: pd.DataFrame, n_docs: int, n_terms: int):
        self.lists, self.kept = {}, {}
        for term, n, max_tf, min_n, heads, data in zip(rows["term"], rows["n"], rows["max_tf"], rows["min_n"], rows["heads"], rows["data"], strict=True):
            if term is None:
                self.size = np.frombuffer(heads, "<i8")
                self.ids, self.unnamed = np.frombuffer(data[: 8 * len(self.size)], "<i8"), np.frombuffer(data[8 * len(self.size) :], np.uint8)
            else:
                self.lists[term] = (int(n), int(max_tf), int(min_n), heads, data)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.m = self.norm(self.size)

    def norm(self, size):
        return 100 - 50 + (50 * size * self.n_docs) // self.n_terms

    @staticmethod
    def impact(tf, m):
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def bound(self, term: str) -> int:
        _, max_tf, min_n, _, _ = self.lists[term]
        return self.impact(max_tf, self.norm(min_n))

    def blocks(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """First and last document, bound and end of each block; None for a list of one block."""
        if self.lists[term][3] is None:
            return None
        if ("heads", term) not in self.kept:
            first, last, tf, size, end = np.frombuffer(self.lists[term][3], "<i4").reshape(5, -1).astype(np.int64)
            self.kept["heads", term] = first, last, self.impact(tf, self.norm(size)), end
        return self.kept["heads", term]

    def postings(self, term: str, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block, or of a whole list."""
        heads = self.blocks(term)
        if block is None and heads is not None:
            parts = [self.postings(term, b) for b in range(len(heads[0]))]
            return np.concatenate([d for d, _ in parts]), np.concatenate([x for _, x in parts])
        if (term, block) not in self.kept:
            data = self.lists[term][4]
            if heads is not None:
                data = data[int(heads[3][block - 1]) if block else 0 : int(heads[3][block])]
            values = unvarints(np.frombuffer(data, np.uint8))
            docs = np.cumsum(values[::2])
            self.kept[term, block] = docs, self.impact(values[1::2], self.m[docs])
        return self.kept[term, block]

    def best(self, weights: dict[str, int], k: int) -> list[tuple[int | None, int]]:
        """(doc_id, score) of the k best documents with a score above 0, ties by id."""
        there = sorted(((w * self.bound(t), t, w) for t, w in weights.items() if t in self.lists and w > 0), reverse=True)
        rest = np.cumsum([0, *[b for b, _, _ in reversed(there)]])[::-1]
        got = np.zeros(len(self.size), np.int64)
        least, at = 1, 0

        def kth(scores: np.ndarray) -> int:
            return max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else least

        while at < len(there) and rest[at] >= least:  # essential: a document only here may still be among the best
            _, term, w = there[at]
            docs, impacts = self.postings(term)
            got[docs] += w * impacts
            at += 1
            least = kth(got)
        open_ = np.flatnonzero((got > 0) & (got + rest[at] >= least))
        others = []
        for _, term, w in there[at:]:
            heads = self.blocks(term)
            if heads is None:
                others.append((term, w, None, np.full(len(open_), w * self.bound(term))))
                continue
            first, last, bounds, _ = heads
            block = np.minimum(np.searchsorted(last, open_), len(last) - 1)
            inside = (first[block] <= open_) & (open_ <= last[block])
            others.append((term, w, np.where(inside, block, -1), np.where(inside, w * bounds[block], 0)))
        bound = sum((x[3] for x in others), np.zeros(len(open_), np.int64))
        alive = got[open_] + bound >= least
        for term, w, block, own in others:
            bound = bound - own
            for b in [None] if block is None else np.unique(block[alive & (block >= 0)]).tolist():
                if not alive.any():
                    break
                docs, impacts = self.postings(term, b)
                mine = np.flatnonzero(alive if b is None else alive & (block == b))
                place = np.minimum(np.searchsorted(docs, open_[mine]), len(docs) - 1)
                hit = docs[place] == open_[mine]
                got[open_[mine[hit]]] += w * impacts[place[hit]]
            least = kth(got[open_])
            alive &= got[open_] + bound >= least
        found = open_[alive & (got[open_] > 0)]
        order = np.lexsort((self.ids[found], self.unnamed[found], -got[found]))[:k]
        return [(None if self.unnamed[d] else int(self.ids[d]), int(got[d])) for d in found[order]]


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id are one item."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, t.decode("utf-8", "surrogatepass")) for i, text in zip(batch["item"], batch["text"], strict=True) for t in set(term_list(text))]
            yield pd.DataFrame(rows, columns=["item", "term"])

    # Ids travel as text: pandas has no integers beside nulls.
    narrow = items.select(F.col("item_id").cast("long").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInPandas(each, "item string, term string").select(F.col("item").cast("long").alias("item_id"), "term").distinct()


def search(lists: DataFrame, items: DataFrame, k: int = 50, terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the index with the highest score above 0 for each item (item_id,
    text), equal scores by ascending doc_id, null ids last.

    Items without terms give no rows, an index without terms none at all; a null item_id is an item. A query is searched
    for in every shard; queries go in groups of some terms_at_once terms.
    """
    spark = lists.sparkSession
    n_docs, n_terms = lists.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("max_tf"), F.lit(0))).first()
    asked = written(query_terms(items), "query-terms")
    total, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    groups = -(-total // terms_at_once) or 1
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    few = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    df = lists.select("term", "n").join(few(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    weighed = asked.join(df, "term").withColumn("w", weight)
    packed = weighed.groupBy("part", "item_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    packed = written(packed.select("part", F.col("item_id").cast("string").alias("item"), F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "queries")
    documents = lists.where("term IS NULL").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    own = lists.join(few(asked.select("term", "part").distinct()), "term").select(*lists.columns, "part")
    each_shard = documents.select("shard", "part").join(few(packed) if size <= BROADCAST_BYTES // 8 else packed, "part").select(F.col("shard").alias("at"), F.col("part").alias("of"), "item", "terms", "weights")

    def found(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            shard = Shard(rows, n_docs, n_terms)
            for item, terms, weights in zip(queries["item"], queries["terms"], queries["weights"], strict=True):
                out += [(item, None if d is None else str(d), s) for d, s in shard.best(dict(zip(terms, (int(w) for w in weights), strict=True)), k)]
        return pd.DataFrame(out, columns=["item", "doc", "score"])

    if not n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    both = own.unionByName(documents).groupBy("shard", "part").cogroup(each_shard.groupBy("at", "of"))
    heaps = both.applyInPandas(found, "item string, doc string, score long").select(F.col("item").cast("long").alias("item_id"), F.col("doc").cast("long").alias("doc_id"), "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
