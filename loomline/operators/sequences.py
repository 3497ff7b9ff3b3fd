"""Frequent sequences of tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C

SHORTEST, LONGEST = 3, 7
ARROW = " → "
#: Calls that a task takes at a time.
CALLS = 50_000


def by_session(calls: DataFrame, rows: int = CALLS) -> DataFrame:
    """calls dealt by session to so many tasks that each has some `rows` of them, however many there are."""
    parts = max(-(-calls.count() // rows), calls.sparkSession.sparkContext.defaultParallelism)
    return calls.repartition(parts, "session_id")


def trigrams(calls: DataFrame, order: list[str], least: int = 2, most: int | None = 20) -> DataFrame:
    """Runs of three tools within a session that occur at least so often, the most frequent first."""
    nth = Window.partitionBy("session_id").orderBy(*order)
    rows = calls.select(F.col("tool_name").alias("a"), F.lead("tool_name", 1).over(nth).alias("b"), F.lead("tool_name", 2).over(nth).alias("c")).where("c IS NOT NULL")
    counts = rows.groupBy(F.concat_ws(ARROW, "a", "b", "c").alias("sequence")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "sequence").limit(most) if most is not None else counts


def steps(calls: DataFrame) -> DataFrame:
    """calls with the step that a call is in the abstract: its tool, and what it aims at."""
    target = C.target_pattern(F.col("tool_name"), F.col("input"))
    return calls.withColumn("step", F.concat_ws(":", "tool_name", target))


def ngrams(calls: DataFrame, order: list[str], shortest: int = SHORTEST, longest: int = LONGEST, least: int = 2) -> DataFrame:
    """(steps, length, n, n_sessions, n_projects) of the runs of steps that occur at least so often.

    A row looks no further than `longest` steps ahead, so no session is gathered whole.
    """
    ahead = Window.partitionBy("session_id").orderBy(*order).rowsBetween(0, longest - 1)
    rows = steps(by_session(calls)).select("session_id", "project", F.collect_list("step").over(ahead).alias("run"))
    sizes = F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: n <= F.size("run"))
    each = rows.select("session_id", "project", F.explode(sizes).alias("length"), "run").withColumn("steps", F.slice("run", 1, F.col("length")))
    # Counted first per session, where its calls are, and its first project marked, so that distinct sessions need no rows of
    # their own beyond.
    counted = each.groupBy("steps", "length", "session_id", "project").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("session_id", "steps", "length").orderBy("project"))
    once = counted.withColumn("once", ((nth == 1) & F.col("session_id").isNotNull()).cast("long"))
    within = once.groupBy("steps", "length", "project").agg(F.sum("n").alias("n"), F.sum("once").alias("n_sessions"))
    found = within.groupBy("steps", "length").agg(F.sum("n").alias("n"), F.sum("n_sessions").alias("n_sessions"), F.count("project").alias("n_projects"))
    return found.where(F.col("n") >= least)


def maximal(grams: DataFrame, share: float = 0.8) -> DataFrame:
    """Without patterns that stand, step by step, within a longer one that occurs at least `share` times as often."""
    inner = grams.select(F.col("n").alias("outer_n"), "steps", "length").withColumn("size", F.explode(F.sequence(F.lit(SHORTEST), F.greatest(F.col("length") - 1, F.lit(SHORTEST)))))
    inner = inner.where("size < length").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    parts = inner.select(F.slice("steps", F.col("at"), F.col("size")).alias("steps"), "outer_n").groupBy("steps").agg(F.max("outer_n").alias("outer_n"))
    covered = grams.join(parts, "steps").where(F.col("outer_n") >= share * F.col("n")).select("steps")
    return grams.join(covered, "steps", "left_anti")


def top_patterns(grams: DataFrame, most: int = 30) -> DataFrame:
    return grams.orderBy(F.desc("n"), F.desc("length"), "steps").limit(most)


def linked(calls: DataFrame, grams: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """(columns, steps) of the rows of calls at which one of the patterns begins."""
    ahead = Window.partitionBy("session_id").orderBy(*order).rowsBetween(0, LONGEST - 1)
    rows = steps(by_session(calls)).select(*columns, F.collect_list("step").over(ahead).alias("run"))
    sizes = F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: n <= F.size("run"))
    runs = rows.select(*columns, F.explode(sizes).alias("length"), "run").select(*columns, F.slice("run", 1, F.col("length")).alias("steps")).distinct()
    return runs.join(grams.select("steps"), "steps", "left_semi")


def topic_links(calls: DataFrame, grams: DataFrame, members: DataFrame, order: list[str]) -> DataFrame:
    """(topic_id, steps, place, ...): the patterns that occur in a session of the topic with all that is known of them, and
    their place by count, then length, then steps."""
    own = linked(calls, grams, order, "session_id").join(members, "session_id").select("topic_id", "steps").distinct()
    nth = Window.partitionBy("topic_id").orderBy(F.desc("n"), F.desc("length"), "steps")
    return own.join(grams, "steps").withColumn("place", F.row_number().over(nth))


def with_projects(calls: DataFrame, grams: DataFrame, order: list[str]) -> DataFrame:
    """The patterns with the projects of their sessions, in order."""
    found = linked(calls, grams, order, "session_id", "project").select("steps", "project").distinct()
    return grams.join(found.groupBy("steps").agg(F.array_sort(F.collect_set("project")).alias("projects")), "steps")
