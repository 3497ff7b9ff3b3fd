"""Features of sessions: term weights, tool weights, structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators.iterate import settled

VOCABULARY_SHARE = 0.8
WEIGHTS = {"text": 0.5, "tool": 0.25, "struct": 0.25}


def session_texts(turns: DataFrame, files: DataFrame | None = None, branches: DataFrame | None = None) -> DataFrame:
    """(session_id, text): every prompt, assistant text, edited path and branch by itself; a session's tokens are those
    of its parts, since none crosses a space."""
    parts = turns.select("session_id", F.col("user_prompt").alias("text")).unionByName(turns.select("session_id", F.explode("texts").alias("text")))
    if files is not None:
        parts = parts.unionByName(files.select("session_id", F.col("file_path").alias("text")))
    if branches is not None:
        parts = parts.unionByName(branches.select("session_id", F.col("git_branch").alias("text")))
    return parts.where(F.col("text") != "")


#: Texts whose terms a task holds at once.
TEXTS = 256


def counted_terms(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, n) of each text: the words of its paths, then all words cut at hyphens, underscores and camel-case steps,
    reduced to letters and digits, without stop words and noise. Tasks count the terms text by text, so that a row is a
    distinct term of a text and not one of its words, and take a word apart when they first meet it."""
    rows = texts.select(*keys, F.col(text).alias("counted"))
    schema = rows.select(*keys, F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = T.term_counter()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [count(x) if x else {} for x in part.column("counted").to_pylist()]
                own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                terms, n = [t for x in found for t in x], [v for x in found for v in x.values()]
                kept = [part.column(k).take(own) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=[*keys, "term", "n"])

    return rows.mapInArrow(each, schema)


def terms(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys and term of every token of the texts."""
    return counted_terms(texts, keys, text).select(*keys, F.explode(F.array_repeat("term", F.col("n").cast("int"))).alias("term"))


def term_counts(texts: DataFrame, key: str, text: str = "text", look: bool = False) -> DataFrame:
    """(key, term, n). look: for stored texts, whose keys are cheap to read; if none is repeated, nothing needs adding up."""
    if look and texts.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty():
        return counted_terms(texts, [key], text)
    return counted_terms(texts, [key], text).groupBy(key, "term").agg(F.sum("n").alias("n"))


def document_frequency(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(counts: DataFrame, key: str) -> DataFrame:
    """(term, df, idf) of the terms in at least two documents and at most max(2, floor(0.8 n)) of the n with any term."""
    n = counts.select(key).distinct().agg(F.count(F.lit(1)).alias("docs"))
    df = document_frequency(counts, key).crossJoin(F.broadcast(n))
    most = F.greatest(F.lit(2), F.floor(F.col("docs") * VOCABULARY_SHARE))
    return df.where((F.col("df") >= 2) & (F.col("df") <= most)).select("term", "df", F.log(F.col("docs") / F.col("df")).alias("idf"))


def unit(weights: DataFrame, key: str) -> DataFrame:
    """Weights over their document's length; a document of length zero keeps zeros."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weights.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(0.0))


def tfidf(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): ln(1 + count) ln(n / df), of unit length. The counts, which three steps read, are worked out
    once; a task holds its share of the vocabulary, so that counts needn't be sorted to meet it."""
    if not hasattr(counts, "settled_at"):
        counts = settled(counts)
    joined = counts.join(vocabulary(counts, key).hint("shuffle_hash"), "term")
    return unit(joined.select(key, "term", (F.log1p("n") * F.col("idf")).alias("weight")), key)


def tool_idf(breakdown: DataFrame) -> DataFrame:
    """(tool_name, idf) with 1 for a tool that all sessions use."""
    n = breakdown.select("session_id").distinct().agg(F.count(F.lit(1)).alias("docs"))
    df = breakdown.groupBy("tool_name").agg(F.countDistinct("session_id").alias("df")).crossJoin(F.broadcast(n))
    idf = F.log(F.col("docs") / F.col("df"))
    return df.select("tool_name", F.when(idf == 0, 1.0).otherwise(idf).alias("idf"))


def tool_vectors(breakdown: DataFrame) -> DataFrame:
    joined = breakdown.groupBy("session_id", "tool_name").agg(F.sum("n_calls").alias("n")).join(tool_idf(breakdown), "tool_name")
    return unit(joined.select("session_id", "tool_name", (F.log1p("n") * F.col("idf")).alias("weight")), "session_id")


def structure(sessions: DataFrame, breakdown: DataFrame) -> DataFrame:
    """(session_id, d0 ... d6) of unit length: shares of user turns, assistant turns and turns with tools, of subagents,
    ln(1 + tools a turn), shares of edits and of reads; zeros for a session without turns.

    sessions has turn_count, assistant_turns, tool_turns, subagent_count.
    """
    n = lambda *names: F.sum(F.when(F.col("tool_name").isin(*names), F.col("n_calls")).otherwise(0))
    sums = breakdown.groupBy("session_id").agg(F.sum("n_calls").alias("total"), n("Edit", "Write").alias("edits"), n("Read", "Grep", "Glob").alias("reads"))
    rows = sessions.select("session_id", "turn_count", "assistant_turns", "tool_turns", "subagent_count").join(sums, "session_id", "left").fillna(0)
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    both = F.greatest(F.col("turn_count") + F.col("assistant_turns"), F.lit(1))
    dims = [
        F.col("turn_count") / both, F.col("assistant_turns") / both, over("tool_turns", "turn_count"), over("subagent_count", "turn_count"),
        F.log1p(over("total", "turn_count")), over("edits", "total"), over("reads", "total"),
    ]
    rows = rows.select("session_id", "turn_count", *[d.cast("double").alias(f"d{i}") for i, d in enumerate(dims)])
    length = F.sqrt(sum((F.col(f"d{i}") * F.col(f"d{i}") for i in range(7)), F.lit(0.0)))
    return rows.select("session_id", *[F.when((F.col("turn_count") > 0) & (length > 0), F.col(f"d{i}") / length).otherwise(0.0).alias(f"d{i}") for i in range(7)])


def keywords(prompts: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, term, n, place) of each session's most frequent tokens."""
    counts = term_counts(prompts.select("session_id", F.col("user_prompt").alias("text")), "session_id")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def candidate_prompts(turns: DataFrame) -> DataFrame:
    """A session's prompts in plan mode if it has any such turn, else all; blank ones left out."""
    planned = F.max(F.coalesce(F.col("is_plan"), F.lit(False))).over(Window.partitionBy("session_id"))
    blank = F.col("user_prompt").rlike(f"^{T.SPACE}*$")
    return turns.withColumn("any_plan", planned).where((~F.col("any_plan") | F.col("is_plan")) & F.col("user_prompt").isNotNull() & ~blank).drop("any_plan")


def representative_prompts(prompts: DataFrame, most: int = 300) -> DataFrame:
    """(session_id, turn_index, score, prompt): the prompt that is most like the session's others, early ones favoured:
    the sum of Jaccard similarities over one plus its place; the earliest of equals."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index")) - 1
    rows = prompts.select("session_id", "turn_index", "user_prompt").withColumn("i", place)
    words = counted_terms(rows, ["session_id", "i"], "user_prompt").select("session_id", "i", "term").distinct()
    sizes = words.groupBy("session_id", "i").agg(F.count(F.lit(1)).alias("size"))
    shared = words.join(words.withColumnRenamed("i", "j"), ["session_id", "term"]).where("i <> j").groupBy("session_id", "i", "j").agg(F.count(F.lit(1)).alias("both"))
    other = sizes.select("session_id", F.col("i").alias("j"), F.col("size").alias("other"))
    scored = shared.join(sizes, ["session_id", "i"]).join(other, ["session_id", "j"]).groupBy("session_id", "i").agg(F.sum(F.col("both") / (F.col("size") + F.col("other") - F.col("both"))).alias("sum"))
    ranked = rows.join(scored, ["session_id", "i"], "left").withColumn("score", F.round(F.coalesce("sum", F.lit(0.0)) / (F.col("i") + 1), 9))
    best = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "i"))
    return ranked.withColumn("nth", best).where("nth = 1").select("session_id", "turn_index", "score", F.left("user_prompt", F.lit(most)).alias("prompt"))


def directory_scope(files: DataFrame) -> DataFrame:
    """The directory that a session's files share."""
    return files.groupBy("session_id").agg(T.common_prefix(F.collect_set("file_path")).alias("scope"))


def summaries(sessions: DataFrame, breakdown: DataFrame, turns: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, work_type, keywords, prompt, scope)."""
    from loomline.operators.overview import work_types

    prompts = candidate_prompts(turns)
    words = keywords(prompts).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("keywords"))
    best = representative_prompts(prompts).select("session_id", "prompt")
    return work_types(sessions, breakdown).join(words, "session_id", "left").join(best, "session_id", "left").join(directory_scope(files), "session_id", "left")


def combined(terms: DataFrame, tools: DataFrame, shape: DataFrame) -> DataFrame:
    """(session_id, feature, value): the three unit vectors side by side, scaled by the roots of their weights."""
    root = {k: w**0.5 for k, w in WEIGHTS.items()}
    dims = shape.select("session_id", F.explode(F.map_from_arrays(F.array(*[F.lit(f"s:{i}") for i in range(7)]), F.array(*[F.col(f"d{i}") for i in range(7)]))).alias("feature", "value"))
    return (
        terms.select("session_id", F.concat(F.lit("t:"), "term").alias("feature"), (F.col("weight") * root["text"]).alias("value"))
        .unionByName(tools.select("session_id", F.concat(F.lit("c:"), "tool_name").alias("feature"), (F.col("weight") * root["tool"]).alias("value")))
        .unionByName(dims.withColumn("value", F.col("value") * root["struct"]))
    )


def abstractions(calls: DataFrame) -> DataFrame:
    return calls.select("*", C.tool_category(F.col("tool_name")).alias("category"), C.target_pattern(F.col("tool_name"), F.col("input")).alias("target"))
