"""Session logs: line-delimited JSON files of sessions and their subagents, plans and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.iterate import settled

LINE = """type STRING, isMeta BOOLEAN, isSidechain BOOLEAN, uuid STRING, parentUuid STRING, timestamp STRING, cwd STRING,
gitBranch STRING, version STRING, slug STRING, permissionMode STRING, sessionId STRING, agentId STRING,
message STRUCT<role STRING, model STRING, content STRING, usage STRUCT<input_tokens BIGINT, output_tokens BIGINT>>"""
BLOCKS = "ARRAY<STRUCT<type STRING, text STRING, thinking STRING, id STRING, name STRING, input STRING, tool_use_id STRING, content STRING>>"
FACETS = """session_id STRING, underlying_goal STRING, goal_categories MAP<STRING,INT>, outcome STRING,
claude_helpfulness STRING, session_type STRING, friction_counts MAP<STRING,INT>, friction_detail STRING,
primary_success STRING, brief_summary STRING"""
# Line types that count for nothing.
SKIPPED_TYPES = ("progress", "queue-operation")
HEAD_BYTES = 4096


#: Paths of sessions and of their subagents below the root.
MAIN, SUB = r"^([^/]+)/([^/]+)\.jsonl$", r"^([^/]+)/([^/]+)/subagents/(?:agent-)?([^/]+)\.jsonl$"
QUEUED = '"type":"queue-operation"'


def _named(read: DataFrame, root: str, *kept: str) -> DataFrame:
    """kept with project_dir, session_id and agent_id (null: the session itself) from each row's file_path."""
    base = root.rstrip("/").removeprefix("file://")
    rows = read.withColumn("rest", F.substring_index(F.regexp_replace("file_path", "^file:/+", "/"), f"{base}/", -1))
    is_main, is_sub = F.col("rest").rlike(MAIN), F.col("rest").rlike(SUB)
    part = lambda i: F.when(is_main, F.regexp_extract("rest", MAIN, i)).otherwise(F.regexp_extract("rest", SUB, i))
    return rows.where(is_main | is_sub).select("file_path", part(1).alias("project_dir"), part(2).alias("session_id"), F.when(is_sub, F.regexp_extract("rest", SUB, 3)).alias("agent_id"), *kept)


def discover(spark: SparkSession, root: str, seen: Observation | None = None) -> DataFrame:
    """(file_path, project_dir, session_id, agent_id, bytes): every session file <project>/<id>.jsonl under root, and the
    subagent files <project>/<id>/subagents/*.jsonl of sessions that have their own file. Only names and sizes are read.
    seen, if given, observes the sessions found and the bytes of all files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    found = _named(listed.select(F.col("_metadata.file_path").alias("file_path"), F.col("length").alias("bytes")), root, "bytes")
    if seen is not None:
        found = found.observe(seen, F.count_if(F.col("agent_id").isNull()).alias("found"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    found = settled(found)
    return found.join(found.where("agent_id IS NULL").select("project_dir", "session_id"), ["project_dir", "session_id"], "left_semi")


def scan(spark: SparkSession, root: str, bad: Observation | None = None) -> DataFrame:
    """(file_path, project_dir, session_id, agent_id, block, place, raw, malformed): a row for every line of every log,
    blank ones too, written once. Files are split as Spark splits them, so one of any size will do: block is where the
    split begins and place rises along it. bad, if given, observes lines that aren't blank, and malformed ones; the job
    that writes has one stage, so tasks that are run again count once."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    rows = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("raw"))
    blank = F.trim("raw") == ""
    rows = _named(rows, root, "block", "place", "raw").withColumn("malformed", ~blank & F.try_parse_json("raw").isNull())
    if bad is not None:
        rows = rows.observe(bad, F.count_if(~blank).alias("lines"), F.count_if("malformed").alias("malformed"))
    return settled(rows)


def driven(scanned: DataFrame) -> DataFrame:
    """(project_dir, session_id) of sessions whose file says within its first bytes that a queue drives it. Only lines that
    begin there are looked at: a line has a byte at least, so no more than so many lines of the first split."""
    head = scanned.where("agent_id IS NULL AND block = 0")
    first = head.groupBy("file_path").agg(F.min("place").alias("first"))
    near = head.join(first, "file_path").where(F.col("place") - F.col("first") < HEAD_BYTES).select("file_path", "project_dir", "session_id", "place", F.octet_length("raw").alias("size"), F.instr("raw", QUEUED).alias("at"), F.substring("raw", 1, HEAD_BYTES).alias("head"))
    before = F.coalesce(F.sum(F.col("size") + 1).over(Window.partitionBy("file_path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = before + F.octet_length(F.expr("left(head, at - 1)")) + len(QUEUED)
    hit = near.withColumn("ends", F.when((F.col("at") > 0) & (F.col("at") <= HEAD_BYTES), ends)).where(F.col("ends") <= HEAD_BYTES)
    return hit.select("project_dir", "session_id").distinct()


def interactive(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """The files found without those of sessions that a queue drives."""
    return found.join(driven(scanned), ["project_dir", "session_id"], "left_anti")


def numbered(scanned: DataFrame) -> DataFrame:
    """scanned with line_no, from 0 in each file: the lines of the splits before, and the place in its own."""
    splits = scanned.groupBy("file_path", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file_path", "block", (ahead - F.col("first")).alias("shift"))
    return scanned.join(splits, ["file_path", "block"]).withColumn("line_no", (F.col("place") + F.col("shift")).cast("int")).drop("shift")


def is_array(raw: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant")).startswith("ARRAY"), F.lit(False))


def lines(numbered: DataFrame) -> DataFrame:
    """One row per log line in its place: blank and malformed lines and skipped types gone.

    content_text is the message's content where it is a string, blocks where it is an array.
    """
    kept = numbered.where("NOT malformed AND trim(raw) <> ''").select("project_dir", "session_id", "agent_id", "line_no", "raw")
    parsed = kept.withColumn("j", F.from_json("raw", LINE)).where(~F.coalesce(F.col("j.type").isin(*SKIPPED_TYPES), F.lit(False)))
    array = is_array(F.col("raw"), "$.message.content")
    return parsed.select(
        "project_dir", "session_id", "agent_id", "line_no", "j.*",
        F.when(~array, F.col("j.message.content")).alias("content_text"),
        F.when(array, F.from_json("j.message.content", BLOCKS)).alias("blocks"),
    )


def read_lines(spark: SparkSession, root: str, only_interactive: bool = True, run: Run | None = None) -> DataFrame:
    """The lines of all logs under root; run counts what comes by."""
    found, scanned = discover(spark, root, run.seen if run else None), scan(spark, root, run.lines if run else None)
    kept = (interactive(scanned, found) if only_interactive else found).select("file_path", "agent_id")
    if run is not None:
        kept = settled(kept.observe(run.kept, F.count_if(F.col("agent_id").isNull()).alias("kept")))
    return lines(numbered(scanned).join(kept.select("file_path"), "file_path", "left_semi"))


class Run:
    """Counters of one run, observed on the way through it."""

    def __init__(self):
        self.seen, self.lines, self.kept, self.written = (Observation() for _ in range(4))
        self.wrote = False

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: sessions found, skipped and parsed, lines, malformed lines, bytes, and sessions written, null before any
        output. Nothing is read again: the jobs that read and wrote have counted."""
        seen, lines, kept = self.seen.get, self.lines.get, self.kept.get
        written = self.written.get["written"] if self.wrote else None
        row = (seen["found"], seen["found"] - kept["kept"], kept["kept"], lines["lines"], lines["malformed"], seen["bytes"], written)
        return spark.createDataFrame([row], "found long, skipped long, parsed long, lines long, malformed long, bytes long, written long")


def agent_types(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, agent_id, agent_type) from the .meta.json files beside subagent logs."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(root, wholetext=True)
    path, shape = F.col("_metadata.file_path"), r"/([^/]+)/subagents/(?:agent-)?([^/]+)\.meta\.json$"
    return read.select(
        F.regexp_extract(path, shape, 1).alias("session_id"),
        F.regexp_extract(path, shape, 2).alias("agent_id"),
        F.coalesce(F.get_json_object("value", "$.agentType"), F.lit("unknown")).alias("agent_type"),
    ).where("session_id != ''")


def plans(spark: SparkSession, root: str) -> DataFrame:
    """(slug, plan): the Markdown files under root by their names."""
    read = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("slug"), F.col("value").alias("plan"))


def facets(spark: SparkSession, root: str) -> DataFrame:
    """Labels of sessions, one JSON document a file; files that don't parse or name no session are left out, and of a
    session's files the last by path counts."""
    read = spark.read.schema(FACETS).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    named = read.where("session_id <> ''").withColumn("path", F.col("_metadata.file_path"))
    last = Window.partitionBy("session_id").orderBy(F.desc("path"))
    return named.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "path")
