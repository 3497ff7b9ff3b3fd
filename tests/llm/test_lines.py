import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomline.llm import lines


def words(t):
    return t.count(" ") + t.count("\n") + 1


def runs(ls, long_line):
    """The shortest run of several lines from each line on that has long_line words; blank lines have none."""
    weights = [x.count(" ") + 1 if x.strip(" ") else 0 for x in ls]
    for i in range(len(ls)):
        n = next((n for n in range(1, min(long_line, len(ls) - i) + 1) if sum(weights[i : i + n]) >= long_line), 0)
        if n > 1:
            yield i + 1, n


def slow(rows, cuts, min_lines=2, min_words=10, long_line=50):
    """cuts: per row its chunks; of these and of runs the repeated ones but the first in order of (doc_id, text_hash, first) go."""
    seen, out = defaultdict(set), {}
    for i, text, h in rows:
        ls = (text or "").split("\n")
        for first, n in cuts[i, text]:
            body = "\n".join(ls[first - 1 : first - 1 + n])
            if words(body) >= long_line or (sum(bool(x.strip(" ")) for x in ls[first - 1 : first - 1 + n]) >= min_lines and words(body) >= min_words):
                seen[body].add((i, h, first, n, text))
        for first, n in runs(ls, long_line):
            seen["\n".join(ls[first - 1 : first - 1 + n])].add((i, h, first, n, text))
    gone = defaultdict(set)
    for places in seen.values():
        for i, _, first, n, text in sorted(places, key=lambda p: p[:3])[1:]:
            gone[i, text] |= set(range(first - 1, first - 1 + n))
    for i, text, _ in rows:
        ls = (text or "").split("\n")
        out[i, text] = text if not gone[i, text] else "\n".join(x for k, x in enumerate(ls) if k not in gone[i, text])
    return out


def cut_up(docs):
    rows = lines.with_chunks(lines.split(lines.keyed(docs)).join(docs.select("doc_id", "text"), "doc_id").where("text IS NOT NULL")).collect()
    return rows, {(r.doc_id, r.text): [(c["first"], c["n"]) for c in r.chunks] for r in rows}


def test_query_equals_brute_force(spark, sf_dir):
    from loomline.llm.queries import op8_line_dedup

    cut, cuts = cut_up(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for (_, text), found in cuts.items():
        assert [f for f, _ in found] == [1 + sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) == len((text or "").split("\n"))
    want = slow([(r.doc_id, r.text, r.text_hash) for r in cut], cuts)
    got = op8_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for (i, _), t in want.items()} and len(got) == len(want)
    assert any(r.n_removed_lines for r in got)


def test_passages_of_short_lines_go_whole(spark):
    """Passages of over 50 words in two to twelve lines, each in ten documents at other places between other lines."""
    rng, docs, passages = random.Random(1), [], []
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    for k, (n, per) in enumerate([(2, 26), (3, 18), (4, 15), (5, 12), (8, 10), (12, 5)] * 4):
        passages.append([line(per) for _ in range(n)])
        for j in range(10):
            docs.append((100 * k + j, "\n".join([line(9) for _ in range(rng.randint(0, 6))] + passages[-1] + [line(9) for _ in range(rng.randint(0, 6))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup(frame).collect()}
    own = dict(docs)
    for k, passage in enumerate(passages):
        assert got[100 * k].text == own[100 * k]
        for j in range(1, 10):
            r = got[100 * k + j]
            assert r.n_removed_lines == len(passage) and not set(passage) & set(r.text.split("\n")), (k, j)
    cut, cuts = cut_up(frame)
    assert {i: r.text for i, r in got.items()} == {i: t for (i, _), t in slow([(r.doc_id, r.text, r.text_hash) for r in cut], cuts).items()}


def test_lines_in_a_cycle_stay_once(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, "\n".join([a, b] * 30)), (2, "\n".join([b, a] * 30)), (3, "own")], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in lines.dedup(docs).collect()}
    assert set(got[1]) == {a, b} and len(got[1]) < 5 and got[3] == ["own"]


def test_equal_hashes_of_different_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{t} " * 60) for i, t in enumerate("abab")], "doc_id long, text string")
    real = lines.occurrences
    monkeypatch.setattr(lines, "occurrences", lambda *a, **k: real(*a, **k).withColumn("hash", F.lit(7).cast("long")))
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert [bool(got[i]) for i in range(4)] == [True, True, False, False]


def test_boundaries_survive_a_shift(spark):
    body = [f"line {i} with some words of its own {i * i}" for i in range(40)]
    texts = [(1, "\n".join(body)), (2, "\n".join(["inserted"] * 3 + body)), (3, "\n".join(body[:20] + ["in between"] + body[20:]))]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].text == texts[0][1]
    assert got[2].n_removed_lines >= 20 and got[3].n_removed_lines >= 20
    assert got[2].text.startswith("inserted")


@pytest.mark.parametrize("n", [51, 80])
def test_a_long_line_between_others_goes(spark, n):
    passage = " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(i, f"own start {i}\n{passage}\nown end {i}") for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert got == {0: f"own start 0\n{passage}\nown end 0"} | {i: f"own start {i}\nown end {i}" for i in range(1, 5)}


def test_odd_rows(spark):
    long = " ".join(["w"] * 60)
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (None, long), (None, long), (4, long), (4, f"{long}\n{long}"), (5, "\n".join(f"x{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, first int, hash string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed_lines) for r in lines.dedup(docs).collect()), key=lambda r: (r[0], r[1] or "", r[3]))
    assert got[:2] == [(0, long, 1, 0)] * 2
    assert (1, None, 0, 0) in got and (2, "", 1, 0) in got and (3, "\n\n\n", 4, 0) in got
    assert sorted(g[1:] for g in got if g[0] == 4) == [("", 1, 1), ("", 2, 2)]
    assert got[-1] == (5, rows[-1][1], 30_000, 0)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_a_passage_with_many_blank_lines(spark):
    """60 words in four lines, 30 blank ones between each two: more than 50 lines from the first word to the 50th."""
    passage = ("\n" * 31).join(" ".join(f"p{i}x{j}" for j in range(15)) for i in range(4))
    docs = [(i, f"own {i}\n{passage}\nend {i} of it") for i in range(3)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i in (1, 2):
        assert "p0x0" not in got[i] and "p3x14" not in got[i] and f"own {i}" in got[i] and f"end {i} of it" in got[i]
