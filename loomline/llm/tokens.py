"""Token-id files: documents encoded, compressed one by one under a shared dictionary, and read back.

A file set is a folder of Parquet files whose rows are blocks of documents in ascending doc_id order: the documents'
compressed frames back to back, an index of their offsets, ids and lengths, and the hash of the dictionary that each
frame needs. Parquet is only the container, so any store that Spark writes will do and lost tasks are retried; a single
document is read by its block's offset index, without decompressing its neighbours. The dictionary itself lies beside.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import Recent, least_hashed, written

END_ID = 1
LEVEL = 3
#: A block closes at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 256, 4 << 20
#: The dictionary's size, the documents it is trained on (those with the least hash of their id) and the ids' bytes taken of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 64 << 10, 1024, 256 << 10
BLOCKS = (
    "shard int, block int, least_id long, greatest_id long, n_docs int, n_tokens long, dictionary long, width int, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"
)


# The vocabulary's pieces within Latin-1, lower case: contractions, letters, single digits, other signs.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
# Bytes that stand for themselves in the vocabulary; the others follow from 256 on, in order.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def _signs() -> dict[int, str]:
    """The vocabulary's signs for the UTF-8 bytes of each Latin-1 character."""
    others = iter(range(256, 512))
    sign = [chr(b if b in PRINTABLE else next(others)) for b in range(256)]
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


def _plain(text: str) -> bool:
    """Whether lower-casing and cutting the text here can't differ from what the vocabulary does."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text  # may begin a special token


# How a vocabulary file says that it lower-cases, drops white space and cuts as PIECE does.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_PATTERN = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def cuts_alike(described: dict) -> bool:
    """Whether a tokenizer, as its file describes it, works on pieces that can be cut here."""
    normalizer, before = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}, {}]
    split, signs = (steps[0], steps[1]) if len(steps) == 2 else ({}, {})
    return (
        normalizer.get("normalizers") == KNOWN_NORMALIZER
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", KNOWN_PATTERN, "Removed", True)
        and (signs.get("type"), signs.get("add_prefix_space"), signs.get("use_regex")) == ("ByteLevel", False, False)
        and described["model"].get("dropout") is None
    )


@lru_cache(maxsize=4)
def _whole(vocabulary: str) -> Callable[[str], bytes] | None:
    """For a vocabulary whose pieces aren't cut here: the library on whole texts."""
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        if cuts_alike(json.load(file)):
            return None
    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def _encoder(vocabulary: str) -> tuple[int, Recent, Recent]:
    """The vocabulary's size, and the ids lately asked for: of pieces, which the library's model gives, and of words, runs
    without space or line feed, which go to the library whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    model, signs = tokenizer.model, _signs()

    def of_piece(piece: str) -> bytes:
        found = model.tokenize(piece.translate(signs))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    pieces = Recent(of_piece)

    def of_word(word: str) -> bytes:
        if _plain(word):
            return b"".join(map(pieces.__getitem__, PIECE.findall(word.lower())))
        ids = tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    return tokenizer.get_vocab_size(with_added_tokens=True), pieces, Recent(of_word)


def encode(text: str, vocabulary: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit integers, as the tokenizers library gives them.

    The vocabulary's pre-tokeniser drops white space and joins nothing across it, and its model gives the same for a piece
    wherever it stands. So a text of Latin-1 is cut into pieces here, any other into words. A vocabulary of another kind
    gets whole texts.
    """
    if (whole := _whole(vocabulary)) is not None:
        return whole(text)
    _, pieces, words = _encoder(vocabulary)
    if _plain(text):
        return b"".join(map(pieces.__getitem__, PIECE.findall(text.lower())))
    return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))


def train_dictionary(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary of the ids of the sample_docs documents whose id has the least hash; empty if too few."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = "<u2" if _encoder(vocabulary)[0] <= 1 << 16 else "<u4"
        for batch in batches:
            yield pd.DataFrame({"ids": [np.frombuffer(encode(x, vocabulary), "<u4").astype(width).tobytes()[:SAMPLE_BYTES] for x in batch["text"]]})

    # Chosen on hashes alone; only the chosen texts move.
    keyed = docs.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    chosen = written(least_hashed(keyed.select("h", "t"), ["h", "t"], sample_docs, docs.count()), "dictionary-keys")
    sample = keyed.join(F.broadcast(chosen), ["h", "t"]).dropDuplicates(["h", "t"])
    found = sorted(bytes(r.ids) for r in sample.select("text").mapInPandas(each, "ids binary").collect() if r.ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def _hash(dictionary: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(dictionary)).astype(np.int64))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, sample_docs: int = SAMPLE_DOCS, order: list[str] | None = None) -> str:
    """Writes docs (doc_id, text) as a file set under path and returns path.

    A null or empty text is the end id alone. Documents come in the order of the columns named, by doc_id unless told
    otherwise: those without an id first, and rows that repeat an id in the order of their texts' hashes. Other columns
    are ignored; an empty table gives a set without blocks.
    """
    spark = docs.sparkSession
    keys = [F.col(c).alias(f"key_{i}") for i, c in enumerate(order or [])]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keys)
    dictionary = train_dictionary(narrow, vocabulary, sample_docs)
    spark.createDataFrame([(_hash(dictionary), bytearray(dictionary), end_id)], "dictionary long, bytes binary, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")
    by = [*(F.col(f"key_{i}") for i in range(len(keys))), F.col("doc_id"), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block = TaskContext.get().partitionId(), 0
        width = 2 if _encoder(vocabulary)[0] <= 1 << 16 and end_id < 1 << 16 else 4
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def close() -> pd.DataFrame:
            sizes, named = np.cumsum([0, *map(len, frames)]), [i for i in ids if i is not None]
            row = (shard, block, min(named, default=None), max(named, default=None), len(ids), sum(counts), _hash(dictionary), width, list(ids), list(counts), sizes.tolist(), b"".join(frames))
            for x in (ids, counts, frames):
                x.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"least_id": "Int64", "greatest_id": "Int64"})

        held = 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = encode(text, vocabulary) + end
                frame = packer.compress(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if width == 2 else raw)
                ids.append(None if pd.isna(i) else int(i))
                counts.append(len(raw) // 4)
                frames.append(frame)
                held += len(frame)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield close()
                    block, held = block + 1, 0
        if ids:
            yield close()

    ranged.mapInPandas(each, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def ids_of(frame: bytes, width: int, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(frame), "<u2" if width == 2 else "<u4").astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a file set, from the ids in its files."""
    dictionary = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker, own = _unpacker(dictionary), _hash(dictionary)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.dictionary != own:
                    raise ValueError(f"the frames of block {r.shard}/{r.block} need another dictionary")
                at, before = 0, 0
                rows = []
                for i in range(r.n_docs):
                    ids = ids_of(r.frames[at : r.offsets[i + 1]], r.width, unpacker)
                    at = r.offsets[i + 1]
                    rows.append((r.shard, r.block, None if pd.isna(r.doc_ids[i]) else int(r.doc_ids[i]), before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                found = pd.DataFrame(rows, columns=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])
                yield found.astype({"doc_id": "Int64"})

    documents = blocks.mapInPandas(each, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    totals = blocks.select("shard", "block", "n_tokens")
    # Shards are as many as the writing tasks were; only their totals are summed up in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_start")).join(shards, "shard")
    return documents.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """One document's ids: only blocks whose range of ids holds it are read, and only its frame is decompressed, found
    by the block's offset index."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("least_id") <= doc_id) & (F.col("greatest_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id)))
    at = F.array_position("doc_ids", F.lit(doc_id)).cast("int")
    start = F.element_at("offsets", at).cast("int")
    found = blocks.select(
        F.substring("frames", start + 1, F.element_at("offsets", at + 1).cast("int") - start).alias("frame"), "width"
    ).first()
    if found is None:
        raise KeyError(doc_id)
    return ids_of(bytes(found.frame), found.width, _unpacker(_dictionary(spark, path))).tolist()
