"""Conversation turns and tool calls from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import SPACE, cut

KEY = ["session_id", "agent_id"]
# Marks of lines that a command wrote.
COMMAND_MARKS = ("<command-name>", "<local-command-caveat>", "<local-command-stdout>")
THINKING, RESULT, WRITTEN, PROMPT = 5000, 2000, 500, 200


def has_tool_result(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))


def is_real_user(type_: str = "type", meta: str = "isMeta", text: str = "content_text", blocks: str = "blocks") -> Column:
    """A line with which a person opens a turn."""
    plain = ~F.col(text).rlike(f"^{SPACE}*$")
    for mark in COMMAND_MARKS:
        plain = plain & ~F.contains(text, F.lit(mark))
    content = F.when(F.col(text).isNotNull(), plain).when(F.col(blocks).isNotNull(), ~has_tool_result(F.col(blocks))).otherwise(False)
    return F.coalesce((F.col(type_) == "user") & ~F.coalesce(F.col(meta), F.lit(False)) & content, F.lit(False))


def is_tool_result(type_: str = "type", blocks: str = "blocks") -> Column:
    return F.coalesce((F.col(type_) == "user") & has_tool_result(F.col(blocks)), F.lit(False))


def user_prompt(text: str = "content_text", blocks: str = "blocks") -> Column:
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.col(text), F.array_join(texts, "\n"), F.lit(""))


def assigned(lines: DataFrame) -> DataFrame:
    """lines with is_real and turn_index, from 0; lines before the first real user message have -1."""
    upto = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("is_real", is_real_user()).withColumn("turn_index", (F.sum(F.col("is_real").cast("int")).over(upto) - 1).cast("int"))


def in_order(value: Column, *place: Column) -> Column:
    """An aggregated array of values in their order; nulls left out."""
    return F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*place, value.alias("v"))))), lambda x: x["v"])


def turns(lines: DataFrame) -> DataFrame:
    """(session_id, agent_id, turn_index, user_prompt, ts, thinking, texts, model)."""
    rows = assigned(lines).where("turn_index >= 0")
    opened = rows.where("is_real").select(*KEY, "turn_index", user_prompt().alias("user_prompt"), F.col("timestamp").alias("ts"))
    said = rows.where("type = 'assistant'")
    models = said.groupBy(*KEY, "turn_index").agg(F.min_by("message.model", F.when(F.col("message.model") != "", F.col("line_no"))).alias("model"))
    blocks = said.select(*KEY, "turn_index", "line_no", F.posexplode("blocks").alias("pos", "b"))
    place = (F.col("line_no"), F.col("pos"))
    content = blocks.groupBy(*KEY, "turn_index").agg(
        in_order(F.when((F.col("b.type") == "thinking") & (F.col("b.thinking") != ""), cut(F.col("b.thinking"), THINKING)), *place).alias("thinking"),
        in_order(F.when((F.col("b.type") == "text") & (F.col("b.text") != ""), F.col("b.text")), *place).alias("texts"),
    )
    none = F.array().cast("array<string>")
    joined = on_turn(on_turn(opened, content), models)
    return joined.select(*KEY, "turn_index", "user_prompt", "ts", F.coalesce("thinking", none).alias("thinking"), F.coalesce("texts", none).alias("texts"), "model")


def on_turn(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on session, agent (null: the session itself) and turn."""
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in (*KEY, "turn_index") else F.col(c) for c in right.columns])
    same = (F.col("session_id") == F.col("r_session_id")) & F.col("agent_id").eqNullSafe(F.col("r_agent_id")) & (F.col("turn_index") == F.col("r_turn_index"))
    return left.join(r, same, "left").drop("r_session_id", "r_agent_id", "r_turn_index")


def tool_calls(lines: DataFrame) -> DataFrame:
    """(session_id, agent_id, turn_index, call_pos, tool_use_id, tool_name, input, content_length, result).

    A result belongs to the first call with its id that stands before it in the same turn; the last result wins. A
    result's content that isn't text is JSON, and an absent one the two characters "".
    """
    rows = assigned(lines).where("turn_index >= 0")
    blocks = rows.select(*KEY, "turn_index", "line_no", "type", F.posexplode("blocks").alias("pos", "b"))
    nth = Window.partitionBy(*KEY, "turn_index").orderBy("line_no", "pos")
    written = F.get_json_object("b.input", "$.content")
    long = (F.col("b.name") == "Write") & (F.length(written) > WRITTEN)
    shorter = F.to_json(F.map_concat(F.map_filter(F.from_json("b.input", "MAP<STRING,STRING>"), lambda k, v: k != "content"), F.create_map(F.lit("content"), cut(written, WRITTEN))))
    calls = blocks.where("type = 'assistant' AND b.type = 'tool_use'").select(
        *KEY, "turn_index", "line_no", "pos", (F.row_number().over(nth) - 1).alias("call_pos"), F.col("b.id").alias("tool_use_id"),
        F.coalesce("b.name", F.lit("unknown")).alias("tool_name"), F.when(long, shorter).otherwise(F.col("b.input")).alias("input"), F.when(F.col("b.name") == "Write", F.length(written)).alias("content_length"),
    )
    results = blocks.where("type = 'user' AND b.type = 'tool_result'").select(
        *KEY, F.col("turn_index"), F.struct("line_no", "pos").alias("at"), F.col("b.tool_use_id").alias("for_id"), cut(F.coalesce("b.content", F.lit('""')), RESULT).alias("result")
    )
    of_id = Window.partitionBy(*KEY, "turn_index", "tool_use_id").orderBy("line_no", "pos")
    first = calls.withColumn("of_id", F.row_number().over(of_id)).where("of_id = 1 AND tool_use_id IS NOT NULL")
    matched = on_turn(first.select(*KEY, "turn_index", "call_pos", "tool_use_id", F.struct("line_no", "pos").alias("call_at")), results).where("for_id = tool_use_id AND at > call_at")
    last = matched.groupBy(*KEY, "turn_index", "call_pos").agg(F.max_by("result", "at").alias("result")).withColumnRenamed("call_pos", "r_pos")
    keys = [F.col(c).alias(f"k_{c}") for c in (*KEY, "turn_index")]
    last = last.select(*keys, "r_pos", "result")
    same = (F.col("session_id") == F.col("k_session_id")) & F.col("agent_id").eqNullSafe(F.col("k_agent_id")) & (F.col("turn_index") == F.col("k_turn_index")) & (F.col("call_pos") == F.col("r_pos"))
    return calls.join(last, same, "left").select(*KEY, "turn_index", "call_pos", "tool_use_id", "tool_name", "input", "content_length", "result")


def session_meta(lines: DataFrame) -> DataFrame:
    """A row per session from its own lines: first non-empty cwd, branch, version, slug and mode, span and minutes."""
    own = lines.where("agent_id IS NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("line_no"))).alias(c)
    found = own.groupBy("session_id", "project_dir").agg(
        *[first(c) for c in ("cwd", "gitBranch", "version", "slug", "permissionMode")], F.min(F.when(F.col("timestamp") != "", F.col("timestamp"))).alias("created_at"), F.max("timestamp").alias("last_active_at")
    )
    seconds = lambda c: F.unix_micros(F.try_to_timestamp(c)) / 1e6
    return found.withColumn("duration_minutes", F.coalesce(F.floor((seconds("last_active_at") - seconds("created_at")) / 60 + 0.5), F.lit(0)).cast("long"))


def first_prompts(found: DataFrame) -> DataFrame:
    return found.where("agent_id IS NULL").groupBy("session_id").agg(cut(F.min_by("user_prompt", "turn_index"), PROMPT).alias("first_prompt"))


def models_used(lines: DataFrame) -> DataFrame:
    own = lines.where("agent_id IS NULL AND type = 'assistant' AND message.model IS NOT NULL")
    return own.groupBy("session_id", F.col("message.model").alias("model")).agg(F.count(F.lit(1)).alias("n_lines"))


def linked_plans(meta: DataFrame, plans: DataFrame) -> DataFrame:
    return meta.join(plans, "slug", "left")
