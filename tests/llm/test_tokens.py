import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import shared, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def slow(docs):
    t, start, out = Tokenizer.from_file(VOCABULARY), 0, {}
    for i, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    from loomline.llm.queries import op2_token_ids

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op2_token_ids(spark, sf_dir).collect()}
    assert got == slow(docs)


@pytest.mark.parametrize(
    "text",
    ["It's <|startoftext|>x<|endoftext|> we'll", "Été ́x", "a b\x1cc\x85d e", "ΟΔΟΣ ΣΑΣ", "  x  \n\n y\t z ", "日本語 テキスト 123.45", "naïve—café\n'S 'T"],
)
def test_words_give_what_the_library_gives_for_the_whole(text):
    want = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(text, VOCABULARY), "<u4").tolist() == want


@pytest.mark.parametrize("signs", ["".join(map(chr, range(256))), "ab SéÉ\u0301İßΣσς'’<|>\n\t\x1c\x85\xa0\u2003\u200b\u3000\ufeff日本1²½٣Ⅷªµº_-.!$€😀\u01c4ﬁ\u212a\u0300\x00"])
def test_random_strings_give_what_the_library_gives(signs):
    t, rng = Tokenizer.from_file(VOCABULARY), random.Random(5)
    parts = [*signs, "'s", "'LL", "<|startoftext|>", "<|ENDOFTEXT|>", "x" * 70, "the", " "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert np.frombuffer(tokens.encode(text, VOCABULARY), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_recent_forgets_and_makes_again(monkeypatch):
    monkeypatch.setattr(shared, "KEPT", 3)
    made = []
    recent = shared.Recent(lambda k: made.append(k) or len(k))
    assert [recent["x" * (i % 9)] for i in range(50)] == [i % 9 for i in range(50)] and len(recent) <= 3 and len(recent.older) <= 3
    assert recent["y" * 100] == 100 and "y" * 100 not in recent and len(made) > 9


def test_other_orders(spark):
    docs = spark.createDataFrame([(i, f"t {i}", -i % 7) for i in range(50)], "doc_id long, text string, k int")
    path = tokens.write(docs, shared.new_path(spark, "ids"), VOCABULARY, order=["k"])
    got = [r.doc_id for r in tokens.read(spark, path).orderBy("start").collect()]
    assert got == sorted(range(50), key=lambda i: (-i % 7, i))


def test_odd_rows_round_trip(spark):
    rows = [(3, None), (1, ""), (2, "word " * 60_000), (7, "a b"), (7, "a b"), (7, "c"), (None, "first")] + [(100 + i, f"t {i}") for i in range(600)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    path = tokens.write(docs, shared.new_path(spark, "ids"), VOCABULARY)
    got = tokens.read(spark, path).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(i for i, _ in rows if i is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert [r.n_tokens for r in got if r.doc_id in (1, 3)] == [1, 1]
    t = Tokenizer.from_file(VOCABULARY)
    assert tokens.read_document(spark, path, 317) == [*t.encode("t 217", add_special_tokens=False).ids, 1]
    empty = tokens.write(docs.limit(0), shared.new_path(spark, "ids"), VOCABULARY)
    assert tokens.read(spark, empty).count() == 0


OTHER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["", "It's  Two\n\nLines, 123 and  more ", "Été naïve 日本語 <|endoftext|>"])
def test_a_vocabulary_of_another_kind_gets_whole_texts(text):
    want = Tokenizer.from_file(OTHER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(text, OTHER), "<u4").tolist() == want


def test_only_the_known_cut_is_made_here(spark):
    assert tokens._whole(VOCABULARY) is None and tokens._whole(OTHER) is not None
    docs = [(1, "Some  text\nof two lines"), (2, None)]
    path = tokens.write(spark.createDataFrame(docs, "doc_id long, text string"), shared.new_path(spark, "other"), OTHER)
    want = [*Tokenizer.from_file(OTHER).encode(docs[0][1], add_special_tokens=False).ids, 1]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.read(spark, path).collect()}
    assert got == {1: (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), 2: (1, zlib.crc32(np.array([1], "<u4").tobytes()))}
