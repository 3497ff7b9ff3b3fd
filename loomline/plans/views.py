"""Session-log tables drawn from the given tables: events play tool calls, conversations play log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The tool that each event type stands for, and the commands of shell calls.
TOOLS = {"view": "Read", "click": "Edit", "purchase": "Write", "error": "Bash"}
COMMANDS = ("git status", "npm run build", "pytest -q", "ls -la", "curl http://x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: a session is a user's week; order within it is (ts, event_id)."""
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    tool = F.lit("Agent")
    for event, name in reversed(TOOLS.items()):
        tool = F.when(F.col("event_type") == event, name).otherwise(tool)
    command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), k % 5 + 1)
    path = F.concat(F.lit("/src/m"), k % 7, F.lit("/f"), k, F.lit(".ts"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.concat_ws("-", "user_id", week).alias("session_id"), tool.alias("tool_name"), k.alias("k"), path.alias("file_path"), command.alias("command"),
        F.concat(F.lit("org/p"), F.col("user_id") % 20).alias("project"), F.concat(F.lit("b"), F.col("user_id") % 50).alias("git_branch"), F.concat(F.lit("model-"), F.col("event_id") % 3).alias("model"),
    )
    fields = [F.when(F.col("tool_name").isin("Read", "Edit", "Write"), F.col("file_path")).alias("file_path"), F.when(F.col("tool_name") == "Bash", F.col("command")).alias("command"), F.when(F.col("tool_name") == "Agent", F.lit("Explore")).alias("subagent_type")]
    return rows.withColumn("input", F.to_json(F.struct(*fields)))


def sessions(calls: DataFrame) -> DataFrame:
    """A row per session: project, branch, mode, span, minutes, calls and turns (a turn has three calls)."""
    minutes = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60000000 + 0.5)
    return calls.groupBy("session_id").agg(
        F.min("project").alias("project"), F.min("git_branch").alias("git_branch"), F.when(F.min("event_id") % 4 == 0, "plan").otherwise("default").alias("permission_mode"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_active_at"), minutes.cast("long").alias("duration_minutes"), F.count(F.lit(1)).alias("n_calls"),
        F.ceil(F.count(F.lit(1)) / 3).cast("long").alias("turn_count"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn_index, user_prompt, texts) from conversations: a user's message opens a turn, an assistant's
    belongs to it, a system's is left out."""
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn_index", F.sum((F.col("role") == "user").cast("int")).over(upto) - 1).where("turn_index >= 0")
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    return rows.groupBy("conv_id", "turn_index").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_prompt"), texts.alias("texts")).withColumnRenamed("conv_id", "session_id")


#: The same views in DuckDB, as the beginning of a query.
SQL = """WITH calls AS (
  SELECT *, CASE WHEN tool_name IN ('Read','Edit','Write') THEN path END AS target_path, CASE WHEN tool_name = 'Bash' THEN cmd END AS target_command FROM (
  SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS VARCHAR) AS session_id,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Write' WHEN 'error' THEN 'Bash' ELSE 'Agent' END AS tool_name,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    '/src/m' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) || '/f' || json_extract_string(props, '$.k') || '.ts' AS path,
    ['git status','npm run build','pytest -q','ls -la','curl http://x'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1] AS cmd,
    'org/p' || (user_id % 20) AS project, 'b' || (user_id % 50) AS git_branch, 'model-' || (event_id % 3) AS model
  FROM events)),
sess AS (
  SELECT session_id, min(project) AS project, min(git_branch) AS git_branch, CASE WHEN min(event_id) % 4 = 0 THEN 'plan' ELSE 'default' END AS permission_mode,
    min(ts) AS created_at, max(ts) AS last_active_at, CAST(floor(datediff('microsecond', min(ts), max(ts)) / 60000000.0 + 0.5) AS BIGINT) AS duration_minutes,
    count(*) AS n_calls, CAST(ceil(count(*) / 3.0) AS BIGINT) AS turn_count
  FROM calls GROUP BY session_id),
lines AS (
  SELECT conv_id AS session_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations WHERE role <> 'system'),
turns AS (
  SELECT session_id, CAST(turn_index AS BIGINT) AS turn_index, max(CASE WHEN role = 'user' THEN text END) AS user_prompt,
    list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS texts FROM lines WHERE turn_index >= 0 GROUP BY session_id, turn_index)
"""
