"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared in letters and digits of lower case, all else being one space. If an item of m characters occurs with
at most k edits, then at least m - q + 1 - k*q of its q-grams occur too, on diagonals (place in the document less place
in the item) at most k apart. A task slides over a whole document's q-grams at once, keeps those that the benchmark has,
counts each item's distinct ones in overlapping bands of diagonals, and verifies bands that reach the bound by a banded
alignment, those of a document together. The benchmark is a stated query set: it goes to the tasks in blocks of bounded
size, each against all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import free_name, written

Q = 8
ERRORS = 0.1
#: Characters of items that one block of the benchmark has at most (or a single longer item).
BLOCK_CHARS = 1 << 20
#: Places of a document looked up, postings counted, and cells of a row aligned at a time.
PART, POSTINGS, CELLS = 1 << 18, 1 << 20, 1 << 19
#: The length of the q-grams that are counted again before the alignment.
SHORT_Q = 4

KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
OTHER = re.compile(r"[^\w]|_")


def canonical(text: str | None) -> bytes:
    """Lower-case letters and digits in UTF-8, all else as single spaces."""
    if not text:
        return b""
    low = text.lower()
    if not low.isascii():
        low = OTHER.sub(" ", low)
    return b" ".join(low.encode("utf-8", "surrogatepass").translate(KEEP).split())


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """The q-grams of the bytes as integers, one for each place."""
    if len(raw) < q:
        return np.zeros(0, "<u8")
    if q == Q:
        return np.ndarray(len(raw) - Q + 1, "<u8", raw, strides=(1,))
    return np.ndarray(len(raw) - q + 1, "<u8", raw + bytes(Q - q), strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def gram_length(size: int, errors: float) -> int:
    """The longest q up to Q at which the lemma leaves an item of that size a q-gram to find it by; 0 for items that are
    shorter than Q and have no edits, which are searched for as they stand."""
    edits = int(errors * size)
    return 0 if size < Q and not edits else min(Q, max(1, size // (edits + 1)))


class Words:
    """Items too short for q-grams: they occur where a document has them as whole words."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items

    def search(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        padded = b" " + raw + b" "
        found = [(i, padded.find(b" " + item + b" "), len(item)) for i, (_, item) in enumerate(self.items)]
        return [(i, 0, at, at + size) for i, at, size in found if at >= 0]


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Index:
    """The q-grams of one block of items, with their postings by class of size: items of a class differ in length by a
    factor below two, so that an occurrence of any of them spans about as much of a document."""

    def __init__(self, items: list[tuple[int, bytes]], errors: float, q: int = Q):
        self.items, self.q = items, q
        self.sizes = np.array([len(raw) for _, raw in items], np.int64)
        self.edits = (errors * self.sizes).astype(np.int64)
        self.least = np.maximum(self.sizes - q + 1 - self.edits * q, 1)
        parts = [grams(raw, q) for _, raw in items]
        codes = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
        self.codes, code = np.unique(codes, return_inverse=True)
        kind = np.log2(np.maximum(self.sizes, 1)).astype(int)
        self.classes = []
        for k in np.unique(kind):
            own = np.flatnonzero(kind[item] == k)
            own = own[np.argsort(code[own], kind="stable")]
            count = np.bincount(code[own], minlength=len(self.codes)).astype(np.int32)
            reach = int((self.sizes + self.edits)[kind == k].max())
            self.classes.append((reach, np.cumsum(count) - count, count, item[own], place[own]))
        self.bits = max(16, int(len(self.codes)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[slots(self.codes, self.bits)] = True

    def bands(self, raw: bytes) -> np.ndarray:
        """Rows (item, least diagonal, greatest diagonal): where bands of diagonals reach the bound on distinct q-grams,
        bands that touch taken together."""
        none = np.zeros((0, 3), np.int64)
        codes = grams(raw, self.q)
        at = [np.flatnonzero(self.seen[slots(codes[start : start + PART], self.bits)]) + start for start in range(0, len(codes), PART)]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        if not len(at) or not len(self.codes):
            return none
        near = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[near] == codes[at]
        at, near = at[hit], near[hit]
        if len(at) < self.least.min():
            return none
        found = []
        for reach, first, count, item, place in self.classes:
            n = count[near]
            own = np.flatnonzero(n)
            if not len(own):
                continue
            where, code, n = at[own], near[own], n[own]
            # By parts of some POSTINGS that overlap by an occurrence's reach: each lies whole in one, and memory is bounded.
            ends, start = np.cumsum(n), 0
            while start < len(where):
                done = int(ends[start] - n[start])
                stop = max(int(np.searchsorted(ends, done + POSTINGS)), int(np.searchsorted(where, where[start] + 2 * reach)), start + 1)
                found.append(self._count(where[start:stop], n[start:stop], first[code[start:stop]], item, place))
                if stop >= len(where):
                    break
                start = max(int(np.searchsorted(where, where[stop - 1] - reach)), start + 1)
        rows = np.concatenate(found) if found else none
        if not len(rows):
            return none
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        # The greatest diagonal so far within the item tells whether the next band touches; items are set far apart for it.
        far = rows[:, 0] << 40
        most = np.maximum.accumulate(rows[:, 2] + far)
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:, 1] + far[1:] > most[:-1]
        edges = np.flatnonzero(new)
        return np.stack([rows[edges, 0], rows[edges, 1], np.maximum.reduceat(rows[:, 2], edges)], axis=1)

    def _count(self, at: np.ndarray, n: np.ndarray, first: np.ndarray, items: np.ndarray, places: np.ndarray) -> np.ndarray:
        post = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, place = items[post].astype(np.int64), places[post].astype(np.int64)
        diagonal = np.repeat(at, n) - place
        # Bands of twice the width, begun at each multiple of it: any run of diagonals as wide lies in one of them.
        low = int(diagonal.min())
        band = (diagonal - low) // (2 * self.edits[item] + 1) + 1
        span = int(band.max()) + 2
        keys = item * span + band
        every = np.sort(np.concatenate([keys, keys - 1]))
        edges = groups(every)
        count = np.diff(np.append(edges, len(every)))
        passed = every[edges[count >= self.least[every[edges] // span]]]
        if not len(passed):
            return np.zeros((0, 3), np.int64)
        # Of those that may pass, distinct places of the item count.
        both = []
        for k in (keys, keys - 1):
            spot = np.minimum(np.searchsorted(passed, k), len(passed) - 1)
            rows = np.flatnonzero(passed[spot] == k)
            both.append(np.stack([k[rows], place[rows], diagonal[rows]]))
        k, p, d = np.concatenate(both, axis=1)
        order = np.lexsort((p, k))
        k, p, d = k[order], p[order], d[order]
        edges, different = groups(k), np.zeros(len(k), np.int64)
        different[groups(k, p)] = 1
        i = k[edges] // span
        good = np.add.reduceat(different, edges) >= self.least[i]
        return np.stack([i, np.minimum.reduceat(d, edges), np.maximum.reduceat(d, edges)], axis=1)[good]

    def search(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(item place, edits, start, end): the best occurrence of each item that the text holds, the earliest of equals."""
        rows = self.bands(raw)
        best: dict[int, tuple[int, int, int]] = {}
        for i in np.unique(rows[:, 0]).tolist():
            at = raw.find(self.items[i][1])
            if at >= 0:
                best[i] = 0, at, at + len(self.items[i][1])
        rows = rows[[r not in best for r in rows[:, 0].tolist()]]
        rows = rows[self.edits[rows[:, 0]] > 0]
        if len(rows):
            text = np.frombuffer(raw, np.uint8).astype(np.int16)
            # Alike ones together, as many at a time as CELLS allow.
            wide = self.sizes[rows[:, 0]] + rows[:, 2] - rows[:, 1] + 2 * self.edits[rows[:, 0]]
            rows, wide = rows[np.argsort(wide, kind="stable")], np.sort(wide)
            start = 0
            while start < len(rows):
                stop = start + 1
                while stop < len(rows) and (stop + 1 - start) * int(wide[stop]) <= CELLS:
                    stop += 1
                for i, edits, a, b in self._aligned(text, rows[start:stop]):
                    if i not in best or (edits, a) < best[i][:2]:
                        best[i] = edits, a, b
                start = stop
        return [(i, *hit) for i, hit in sorted(best.items())]

    def _aligned(self, text: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best alignment of each (item, least, greatest diagonal) within its band, of those
        that keep to the item's budget; all of them row by row together."""
        item, edits = rows[:, 0], self.edits[rows[:, 0]]
        size, first = self.sizes[item], rows[:, 1] - edits
        width = rows[:, 2] + edits - first
        m, w = int(size.max()), int(width.max())
        pattern = np.full((len(rows), m), -2, np.int16)
        for r, i in enumerate(item.tolist()):
            pattern[r, : size[r]] = np.frombuffer(self.items[i][1], np.uint8)
        # Beyond the text's ends stand signs that match nothing: each costs what leaving out one of the item's does.
        padded = np.concatenate([np.full(m + w, -1, np.int16), text, np.full(2 * (m + w), -1, np.int16)])
        window = np.lib.stride_tricks.sliding_window_view(padded, m + w)[np.clip(first + m + w, 0, len(text) + m + w)]
        keep = self._shared(pattern, window, size, edits, w)
        if not keep.any():
            return []
        pattern, window, item, edits, size, first, width = (x[keep] for x in (pattern, window, item, edits, size, first, width))
        # A cell is the cost of the item's beginning that ends on that diagonal; it may start on any.
        span = np.arange(w + 1, dtype=np.int32)
        beyond = span > width[:, None]
        cost, begin = np.where(beyond, m, 0).astype(np.int32), np.broadcast_to(span, (len(item), w + 1)).copy()
        for j in range(m):
            across = cost + (window[:, j : j + w + 1] != pattern[:, j, None]) if j + w + 1 <= m + w else None
            up = np.concatenate([cost[:, 1:] + 1, np.full((len(item), 1), m + 1, np.int32)], axis=1)
            origin = np.where(across <= up, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1))
            inner = np.minimum(across, up)
            # A gap along the text costs one a place: the running minimum of cost less place gives the best of them.
            least = np.minimum.accumulate(inner - span, axis=1)
            source = np.maximum.accumulate(np.where(inner - span == least, span, 0), axis=1)
            new, start = least + span, np.take_along_axis(origin, source, axis=1)
            ended = (j >= size)[:, None]
            cost, begin = np.where(ended, cost, new), np.where(ended, begin, start)
        cost = np.where(beyond, m + 1, cost)
        end = cost.argmin(axis=1)
        each, n = np.arange(len(item)), len(text)
        edits_of, start = cost[each, end], begin[each, end]
        found = zip(item.tolist(), edits_of.tolist(), np.clip(first + start, 0, n).tolist(), np.clip(first + size + end, 0, n).tolist(), (edits_of <= edits).tolist(), strict=True)
        return [(i, e, a, b) for i, e, a, b, good in found if good]

    def _shared(self, pattern: np.ndarray, window: np.ndarray, size: np.ndarray, edits: np.ndarray, w: int) -> np.ndarray:
        """Which rows meet the lemma's bound for q-grams of SHORT_Q too, anywhere in the band: much the sharper one."""
        least = size - SHORT_Q + 1 - SHORT_Q * edits
        code = lambda x: sum(x[:, i : x.shape[1] - SHORT_Q + 1 + i].astype(np.int64) << (9 * i) for i in range(SHORT_Q))
        p, t = code(pattern + 2), code(window + 2)
        met = np.zeros(p.shape, bool)
        for d in range(w + 1):
            part = t[:, d : d + p.shape[1]]
            met[:, : part.shape[1]] |= p[:, : part.shape[1]] == part
        met &= np.arange(p.shape[1]) <= (size - SHORT_Q)[:, None]
        return met.sum(axis=1) >= least


def blocks(items: list[tuple[int, bytes]], most: int) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for i, raw in items:
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append((i, raw))
        size += len(raw)
    if held:
        yield held


def indexes(items: list[tuple[int, bytes]], errors: float) -> list[Index | Words]:
    """An index for each length of q-grams that the items need."""
    by_length: dict[int, list[tuple[int, bytes]]] = {}
    for item in items:
        by_length.setdefault(gram_length(len(item[1]), errors), []).append(item)
    return [Index(held, errors, q) if q else Words(held) for q, held in sorted(by_length.items())]


def find(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end, n_chars): each item that a document holds with at most errors * length edits,
    at its best place; places and lengths count bytes of the canonical texts.

    Whole documents are searched. Items of fewer than 40 characters are found by shorter q-grams than 8, those of fewer than
    8 that allow no edit as whole words. Null and empty items are in no document. Items with equal canonical texts are found each. Null texts hold
    nothing. Documents without an id give a null doc_id; rows that repeat give repeated rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = "doc_id long, item_id long, edits int, start long, end long, n_chars long"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # The query set in blocks, each a broadcast of bounded size; most benchmarks are one block.
    numbered = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL"), "benchmark")
    total = numbered.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // block_chars))
    found = None
    for part in range(parts):
        own = numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        items = [(r.item_id, raw) for r in own if (raw := canonical(r.text))]
        for held in blocks(items, block_chars):
            shared = spark.sparkContext.broadcast(indexes(held, errors))

            def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    rows = []
                    for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                        raw = canonical(text)
                        for index in shared.value:
                            for i, edits, start, end in index.search(raw):
                                rows.append((None if pd.isna(doc) else int(doc), index.items[i][0], edits, start, end, len(index.items[i][1])))
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end", "n_chars"]).astype({"doc_id": "Int64", "item_id": "Int64"})

            one = narrow.mapInPandas(each, out)
            found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], out)


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay. Rows without an id go by their text.

    Documents are told apart by id and text, so of rows that share an id only those that hold an item go.
    """
    row, own = F.xxhash64("doc_id", "text"), free_name(docs, "leaked")
    marked = docs.select(row.alias("doc_id"), "text")
    hit = written(find(marked, benchmark, errors).select(F.col("doc_id").alias(own)).distinct(), "leaked")
    return docs.join(hit, row == F.col(own), "left_anti")
