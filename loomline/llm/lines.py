"""Removal of repeated line chunks, in DataFrame functions only.

A document's lines are cut into chunks where their content says so: after a line at which the rolling hash over the
hashes of the last lines has its low bits zero, and around a long line. Inserting or deleting lines shifts no boundary
beyond the next few lines, so what documents share falls into the same chunks. A passage's first and last lines may share
a chunk with what stands beside them; so that they go too, the shortest run of lines from each line on that has the words
of a long line is looked up as well. Chunks and runs whose hash occurs more than once are compared byte for byte with
their first occurrence; the lines of all others that equal it are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import written

#: Lines in the rolling hash; one line in DIVISOR ends a chunk; words that make a line a chunk of its own.
WINDOW, DIVISOR, LONG_LINE = 2, 2, 50
#: What a removed chunk has at least: so many lines that aren't blank and words, or the words of a long line.
MIN_LINES, MIN_WORDS = 2, 10
#: Tasks that the occurrences of one hash are dealt out to.
SALTS = 16


def moved(array: Column, by: int, empty: Column) -> Column:
    """The array with each element `by` places later (earlier if negative), of the same length."""
    n = F.size(array)
    fill = F.array_repeat(empty, F.least(n, F.lit(abs(by))))
    rest = F.greatest(n - abs(by), F.lit(0))
    return F.concat(fill, F.slice(array, 1, rest)) if by > 0 else F.concat(F.slice(array, 1 - by, rest), fill)


def count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def with_chunks(rows: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> DataFrame:
    """rows with chunks and runs for their array of lines: structs of first (from 1), n, full (lines that aren't blank),
    words and hash.

    Each step is a column of its own that the next refers to more than once, so that nothing is computed anew for each
    element or use.
    """
    marked = rows.withColumns(
        {
            "own": F.transform("lines", lambda x: F.xxhash64(x)),
            "spaces": F.transform("lines", lambda x: count(x, " ")),
            "blank": F.transform("lines", lambda x: F.trim(x) == ""),
        }
    )
    marked = marked.withColumn("hashes", F.transform("own", lambda x: F.pmod(x, F.lit(2147483647))))
    marked = marked.withColumn("weights", F.zip_with("spaces", "blank", lambda n, empty: F.when(empty, 0).otherwise(n + 1)))
    hashes = F.col("hashes")
    rolled = hashes
    for k in range(1, window):
        scaled = F.transform(moved(hashes, k, F.lit(0).cast("long")), lambda h: h * F.lit(31**k))  # noqa: B023
        rolled = F.zip_with(rolled, scaled, lambda total, h: total + h)
    long = F.transform("spaces", lambda n: n >= long_line - 1)
    by_length = F.zip_with(long, moved(long, -1, F.lit(True)), lambda own, after: own | after)
    ends_here = F.zip_with(rolled, by_length, lambda x, y: (F.pmod(F.xxhash64(x), F.lit(divisor)) == 0) | y)
    places = F.transform(ends_here, lambda x, i: F.when(x, i + 1))  # the last line always ends one
    ended = marked.withColumn("ends", F.filter(places, lambda i: i.isNotNull()))
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))

    ended = ended.withColumn("starts", starts)

    def chunk(s: Column, e: Column) -> Column:
        full = F.size(F.filter(F.slice("blank", s, e - s + 1), lambda x: ~x))
        words = F.aggregate(F.slice("spaces", s, e - s + 1), F.lit(0), lambda total, x: total + x + 1)
        return F.struct(s.alias("first"), (e - s + 1).alias("n"), full.alias("full"), words.alias("words"), F.xxhash64(F.slice("own", s, e - s + 1)).alias("hash"))

    def reach(i: Column) -> Column:
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        more = lambda r, x: F.when(r["words"] >= long_line, r).otherwise(F.struct((r["words"] + x).alias("words"), (r["n"] + 1).alias("n")))
        return F.struct(i.alias("first"), F.aggregate(F.slice("weights", i, long_line), none, more).alias("run"))

    several = F.when(F.size("lines") > 1, F.sequence(F.lit(1), F.size("lines"))).otherwise(F.array().cast("array<int>"))
    ended = ended.withColumn("reaches", F.filter(F.transform(several, reach), lambda r: (r["run"]["words"] >= long_line) & (r["run"]["n"] > 1)))
    run = lambda r: F.struct(r["first"].alias("first"), r["run"]["n"].alias("n"), r["run"]["n"].alias("full"), r["run"]["words"].alias("words"), F.xxhash64(F.slice("own", r["first"], r["run"]["n"])).alias("hash"))
    # A run with so many blank lines that those before see no end of it: the lines that count are looked at alone.
    solid = F.filter(F.transform("weights", lambda w, i: F.struct((i + 1).alias("at"), w.alias("w"))), lambda x: x["w"] > 0)
    ended = ended.withColumn("solid", F.when(F.size("lines") > long_line, solid).otherwise(F.array().cast("array<struct<at:int,w:int>>")))

    def far(x: Column, j: Column) -> Column:
        none = F.struct(F.lit(0).alias("words"), x["at"].alias("end"))
        more = lambda r, y: F.when(r["words"] >= long_line, r).otherwise(F.struct((r["words"] + y["w"]).alias("words"), y["at"].alias("end")))
        return F.struct(x["at"].alias("first"), F.aggregate(F.slice("solid", j + 1, long_line), none, more).alias("run"))

    wide = F.filter(F.transform("solid", far), lambda r: (r["run"]["words"] >= long_line) & (r["run"]["end"] - r["first"] >= long_line))
    ended = ended.withColumn("far", F.transform(wide, lambda r: F.struct(r["first"].alias("first"), F.struct(r["run"]["words"].alias("words"), (r["run"]["end"] - r["first"] + 1).alias("n")).alias("run"))))
    cut = ended.withColumns({"chunks": F.zip_with("starts", "ends", chunk), "runs": F.transform(F.concat("reaches", "far"), run)})
    return cut.drop("own", "hashes", "spaces", "weights", "blank", "ends", "starts", "reaches", "solid", "far")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def split(rows: DataFrame) -> DataFrame:
    """rows with their text's lines instead of it; a text without a newline has one line, a null text null."""
    return rows.withColumn("lines", F.split("text", "\n")).drop("text")


def occurrences(rows: DataFrame, min_lines: int, min_words: int, long_line: int = LONG_LINE, **cut: int) -> DataFrame:
    """(doc_id, text_hash, first, n, hash) of each chunk or run long enough to be removed; words are told by spaces."""
    cuts = with_chunks(split(rows.where("text IS NOT NULL")), long_line=long_line, **cut)
    # An outer explode: no filter on the chunks is then derived and computed below, a second and third time.
    each = cuts.select("doc_id", "text_hash", F.explode_outer(F.concat("chunks", "runs")).alias("c")).select("doc_id", "text_hash", "c.*")
    each = each.where((F.col("words") >= long_line) | ((F.col("full") >= min_lines) & (F.col("words") >= min_words)))
    return each.select("doc_id", "text_hash", "first", "n", "hash")


def on_document(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """rows joined with arrays of marks by document: id, which may be null, and text hash."""
    m = marks.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "id_hash")
    return rows.join(m, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("id_hash")), how).drop("id", "id_hash")


def repeats(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, **cut: int) -> DataFrame:
    """(doc_id, text_hash, gone): stretches of lines (first, n) of each document that lie in chunks or runs which repeat an
    earlier one: all but the occurrence with the least (doc_id, text_hash, first), whose bytes they equal. Each line that
    goes thus equals one at an earlier place, so some place keeps it."""
    found = written(occurrences(rows, min_lines, min_words, **cut), "chunks")
    place = F.struct("doc_id", "text_hash", "first")
    spot = F.xxhash64("doc_id", "text_hash", "first")
    # Rows equal in id and text have equal places. Narrow figures tell which hashes repeat; only their places move.
    hot = written(found.groupBy("hash").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("hash"), "repeated-hashes")
    again = written(found.join(hot, "hash", "left_semi"), "repeated-chunks")
    origins = written(again.groupBy("hash").agg(F.min(place).alias("origin")), "origins")
    # The occurrences of a hot hash meet copies of its origin in SALTS tasks.
    salted = origins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = again.withColumn("salt", F.pmod(spot, F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    marked = written(met.select("doc_id", "text_hash", "first", "n", "hash", (place == F.col("origin")).alias("is_origin")).distinct(), "marked-chunks")
    # Only now do bytes move, and only those of chunks whose hash repeats: grouped by hash and bytes, those of one chunk
    # meet in one row a task before any of them is sent.
    listed = marked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "n", "hash")).alias("marks"))
    body = lambda m: F.struct(m["first"].alias("first"), m["n"].alias("n"), m["hash"].alias("hash"), F.array_join(F.slice("lines", m["first"], m["n"]), "\n").alias("body"))
    bodies = split(on_document(rows, listed, "inner")).select("doc_id", "text_hash", F.explode_outer(F.transform("marks", body)).alias("m")).select("doc_id", "text_hash", "m.*")
    clashing = written(bodies.select("hash", "body").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("hash"), "clashing-hashes")
    copies = marked.where(~F.col("is_origin"))
    if not clashing.isEmpty():  # different bytes under one hash: each has its own first occurrence
        own = bodies.join(clashing, "hash", "left_semi")
        firsts = own.groupBy("hash", "body").agg(F.min(place).alias("origin"))
        apart = own.join(firsts, ["hash", "body"]).where(place != F.col("origin"))
        columns = ["doc_id", "text_hash", "first", "n"]
        copies = copies.join(clashing, "hash", "left_anti").select(*columns).unionByName(apart.select(*columns))
    # Stretches that touch or overlap become one.
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("first", "n")
    reached = F.max(F.col("first") + F.col("n")).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    told = copies.select("doc_id", "text_hash", "first", "n").withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    numbered = told.withColumn("stretch", F.sum("new").over(ahead))
    joined = numbered.groupBy("doc_id", "text_hash", "stretch").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("n")).alias("until"))
    return joined.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", (F.col("until") - F.col("first")).alias("n")))).alias("gone"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, **cut: int) -> DataFrame:
    """(doc_id, text, n_lines, n_removed_lines, n_removed_chunks) for each row of docs (doc_id, text).

    text lacks the lines of chunks and runs that repeat an earlier one, and is unchanged where none does; of each line
    that goes an earlier occurrence stays. n_removed_chunks counts stretches of lines. A null text stays null, with no lines; an empty one has one line. Rows equal in id and text are the same
    document and don't repeat each other, but a chunk that a document repeats within itself goes like any other. A document
    all of whose lines go has the empty text. An empty table gives an empty result; other columns are ignored.
    """
    rows = keyed(docs)
    both = split(on_document(rows, repeats(rows, min_lines, min_words, **cut), "left"))
    # What stays lies between the removed chunks: from behind each to the next, the first from line 1.
    froms = F.concat(F.array(F.lit(1)), F.transform("gone", lambda g: g["first"] + g["n"]))
    untils = F.concat(F.transform("gone", lambda g: g["first"] - 1), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(froms, untils, lambda a, b: F.slice("lines", a, b - a + 1)))
    none, same = F.lit(0).cast("long"), F.col("gone").isNull()
    return both.select(
        "doc_id",
        F.array_join(F.when(same, F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.when(F.col("lines").isNull(), none).otherwise(F.size("lines").cast("long")).alias("n_lines"),
        F.when(same, none).otherwise(F.aggregate("gone", none, lambda s, g: s + g["n"])).alias("n_removed_lines"),
        F.when(same, none).otherwise(F.size("gone").cast("long")).alias("n_removed_chunks"),
    )
