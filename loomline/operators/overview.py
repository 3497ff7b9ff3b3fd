"""Facts of sessions and what they add up to across sessions.

calls: (session_id, project, tool_name, file_path, model, ts, event_id, ...) with a row per tool call.
sessions: (session_id, project, created_at, duration_minutes, permission_mode, turn_count, n_calls, ...).
Every list has a total order: counts descending, then names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators import selection

# The histogram's buckets in minutes.
BUCKETS = (("0-5m", 0, 5), ("5-15m", 5, 15), ("15-30m", 15, 30), ("30-60m", 30, 60), ("60-120m", 60, 120), ("120m+", 120, None))
EDITS = ("Edit", "Write")


def tool_breakdown(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n_calls"))


def models_used(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n_lines"))


def files_edited(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("tool_name").isin(*EDITS) & F.col("file_path").isNotNull()).select("session_id", "file_path").distinct()


def activity_span(calls: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    minutes = F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 60000000 + 0.5).cast("long")
    return calls.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active_at"), minutes.alias("duration_minutes"))


def heatmap(sessions: DataFrame) -> DataFrame:
    """Session starts by day of the week (0 Sunday) and hour, all 168 cells."""
    spark = sessions.sparkSession
    grid = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = sessions.groupBy((F.dayofweek("created_at") - 1).alias("day"), F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n_sessions"))


def heatmap_intensity(sessions: DataFrame) -> DataFrame:
    grid = heatmap(sessions)
    most = grid.agg(F.greatest(F.max("n_sessions"), F.lit(1)).alias("most"))
    return grid.crossJoin(most).select("day", "hour", F.floor(F.col("n_sessions") * 100 / F.col("most") + 0.5).cast("long").alias("percent"))


def project_distribution(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("duration_minutes").alias("minutes"))


def weekly_tool_trends(calls: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Calls by week of the session's start and tool; without starts, of the call."""
    rows = calls.join(starts.select("session_id", F.col("created_at").alias("at")), "session_id") if starts is not None else calls.withColumn("at", F.col("ts"))
    return rows.groupBy(C.week_label(F.col("at")).alias("week"), "tool_name").agg(F.count(F.lit(1)).alias("n_calls"))


def weekly_category_share(trends: DataFrame) -> DataFrame:
    """Each class's percent of a week's calls, rounded, all five classes a week."""
    spark = trends.sparkSession
    names = spark.createDataFrame([(c,) for c in ("Core", "Agent", "Plan", "MCP", "Other")], "category string")
    sums = trends.groupBy("week", C.trend_category(F.col("tool_name")).alias("category")).agg(F.sum("n_calls").alias("n"))
    grid = trends.select("week").distinct().crossJoin(F.broadcast(names))
    total = F.sum("n").over(Window.partitionBy("week"))
    joined = grid.join(sums, ["week", "category"], "left").fillna(0, ["n"])
    return joined.select("week", "category", F.coalesce(F.floor(F.try_divide(F.col("n") * 100, total) + 0.5), F.lit(0)).cast("long").alias("percent"))


def duration_histogram(sessions: DataFrame) -> DataFrame:
    spark = sessions.sparkSession
    buckets = spark.createDataFrame([(i, name) for i, (name, _, _) in enumerate(BUCKETS)], "place int, bucket string")
    m = F.col("duration_minutes")
    place = C.rules([(m < high, F.lit(i)) for i, (_, _, high) in enumerate(BUCKETS) if high is not None], F.lit(len(BUCKETS) - 1))
    counts = sessions.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counts, "place", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n_sessions"))


def top_files(calls: DataFrame, most: int = 50) -> DataFrame:
    """Files by the number of sessions that edit them."""
    return files_edited(calls).groupBy("file_path").agg(F.count(F.lit(1)).alias("edit_count")).orderBy(F.desc("edit_count"), "file_path").limit(most)


def model_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_lines"))


def plan_mode_usage(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project").agg(F.count_if(F.col("permission_mode") == "plan").alias("plan_sessions"), F.count(F.lit(1)).alias("n_sessions"))


def upper_median(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The value at place floor(n / 2) of the sorted rows, nulls aside; no row without any."""
    return selection.at_rank(rows, value, F.floor(F.col("n") / 2), by).withColumnRenamed("value", "median")


def long_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions of more than twice the median duration, if that isn't zero."""
    middle = upper_median(sessions, "duration_minutes").where("median > 0")
    return sessions.crossJoin(F.broadcast(middle)).where("duration_minutes > 2 * median").select("session_id", "project", "duration_minutes")


def hot_files(calls: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """Files with so many edits in one session."""
    counts = calls.where("tool_name = 'Edit' AND file_path IS NOT NULL").groupBy("session_id", "file_path").agg(F.count(F.lit(1)).alias("edits"))
    return counts.where(F.col("edits") >= least).orderBy(F.desc("edits"), "session_id", "file_path").limit(most)


def overview_cards(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("duration_minutes").alias("minutes"), F.sum("n_calls").alias("n_calls"), F.countDistinct("project").alias("n_projects"))


def session_tool_share(breakdown: DataFrame) -> DataFrame:
    total = F.sum("n_calls").over(Window.partitionBy("session_id"))
    return breakdown.select("session_id", "tool_name", "n_calls", F.floor(F.col("n_calls") * 100 / total + 0.5).cast("long").alias("percent"))


def work_types(sessions: DataFrame, breakdown: DataFrame) -> DataFrame:
    n = lambda *names: F.sum(F.when(F.col("tool_name").isin(*names), F.col("n_calls")).otherwise(0))
    sums = breakdown.groupBy("session_id").agg(F.sum("n_calls").alias("total"), n("Read", "Grep", "Glob").alias("reads"), n("Edit", "Write").alias("writes"), n("Bash").alias("shells"))
    rows = sessions.select("session_id", "permission_mode", "turn_count").join(sums, "session_id", "left").fillna(0)
    return rows.select("session_id", C.work_type(*[F.col(c) for c in ("total", "reads", "writes", "shells", "permission_mode", "turn_count")]).alias("work_type"))


def search(sessions: DataFrame, project: str | None = None, branch: str | None = None, from_day: str | None = None, to_day: str | None = None, prompt: str | None = None) -> DataFrame:
    """Sessions with turns that meet every given condition; texts match in any case, and to_day counts whole."""
    found = sessions.where("turn_count > 0")
    if project is not None:
        found = found.where(F.col("project") == project)
    if branch is not None:
        found = found.where(F.contains(F.lower("git_branch"), F.lit(branch.lower())))
    if from_day is not None:
        found = found.where(F.col("created_at") >= F.lit(from_day).cast("date"))
    if to_day is not None:
        found = found.where(F.col("created_at") < F.date_add(F.lit(to_day).cast("date"), 1))
    if prompt is not None:
        found = found.where(F.contains(F.lower("first_prompt"), F.lit(prompt.lower())))
    return found


def page(sessions: DataFrame, key: str = "created_at", number: int = 0, size: int = 20) -> DataFrame:
    """One page of the list by date, duration or calls, the largest first; a page beyond the last is the last."""
    last = max((sessions.count() - 1) // size, 0)
    return sessions.orderBy(F.desc(key), "session_id").offset(size * min(max(number, 0), last)).limit(size)


def session_index(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "session_id")


def project_index(sessions: DataFrame) -> DataFrame:
    """(project, n_sessions): the index's projects, those with most sessions first."""
    return sessions.groupBy("project").agg(F.count(F.lit(1)).alias("n_sessions")).orderBy(F.desc("n_sessions"), "project")


def session_files(files: DataFrame) -> DataFrame:
    """(session_id, files, n_files): each session's edited files in order."""
    return files.groupBy("session_id").agg(F.array_sort(F.collect_set("file_path")).alias("files")).withColumn("n_files", F.size("files"))


def session_details(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """A nested document per session: its facts and its calls in order."""
    nested = calls.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "tool_name", "input"))).alias("calls"))
    return sessions.join(nested, "session_id", "left")


def turn_summary(calls: DataFrame, turns: DataFrame | None = None, most: int = 80) -> DataFrame:
    """Per turn (session_id, turn_index): its number from 1, kind, distinct tools in order of name, number of calls and, with
    turns, the beginning of its prompt; turns without calls are standard ones then."""
    sums = calls.groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_set("tool_name")).alias("names"), F.count(F.lit(1)).alias("n_calls"))
    prompt = F.lit(None).cast("string")
    if turns is not None:
        sums = turns.select("session_id", "turn_index", "user_prompt").join(sums, ["session_id", "turn_index"], "left")
        sums = sums.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).fillna(0, ["n_calls"])
        prompt = T.cut(F.col("user_prompt"), most, "...")
    return sums.select("session_id", "turn_index", (F.col("turn_index") + 1).alias("number"), C.turn_kind(F.col("names")).alias("kind"), F.array_join("names", ", ").alias("tools"), "n_calls", prompt.alias("prompt"))


def subagent_summary(calls: DataFrame) -> DataFrame:
    """Per session and agent: its tools with counts, most frequent first, and the total."""
    counts = calls.groupBy("session_id", "agent_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tool_name")))
    listed = F.array_join(F.transform(ordered, lambda x: F.concat(x["tool_name"], F.lit(": "), -x["less"])), ", ")
    return counts.groupBy("session_id", "agent_id").agg(listed.alias("tools"), F.sum("n").alias("n_calls"))
