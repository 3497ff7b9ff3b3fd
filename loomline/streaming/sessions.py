"""Session facts kept up to date from a stream of tool calls.

An extension: the batch operators' per-session facts over a stream, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_facts(calls: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(user_id, window, n_calls, tools) of runs of a user's calls with no gap over `gap`; calls later than `late` are
    left out. calls: (user_id, ts, tool_name), ts a timestamp."""
    runs = calls.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("window"))
    return runs.agg(F.count(F.lit(1)).alias("n_calls"), F.array_sort(F.collect_set("tool_name")).alias("tools"))


def weekly_counts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """(week, tool_name, n_calls) by weeks that begin on Monday."""
    weeks = calls.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("week"), "tool_name")
    return weeks.agg(F.count(F.lit(1)).alias("n_calls"))
