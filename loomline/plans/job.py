"""The whole job over a folder of logs: read, rebuild sessions, add up, find topics, write everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import features, knowledge, output, overview, sequences, topics, turns
from loomline.operators.iterate import settled
from loomline.sources import logs

ORDER = ["turn_index", "call_pos"]


def session_tables(lines: DataFrame, plans: DataFrame | None = None, facets: DataFrame | None = None, agents: DataFrame | None = None) -> dict[str, DataFrame]:
    """sessions, calls, turns, breakdown and files of read lines, each settled.

    A session's project is the end of its working folder, else what its directory's name says; where labels give a brief
    summary, that is its first prompt. Own calls are those of the session itself, agents' calls have agent_id.
    """
    lines = settled(lines)
    said = settled(turns.turns(lines))
    found = turns.tool_calls(lines)
    meta = turns.session_meta(lines)
    project = F.coalesce(F.nullif(T.project_of_cwd(F.col("cwd")), F.lit("")), T.project_of_directory(F.col("project_dir")))
    counts = said.where("agent_id IS NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"))
    subagents = lines.where("agent_id IS NOT NULL").groupBy("session_id").agg(F.countDistinct("agent_id").alias("subagent_count"))
    own = found.where("agent_id IS NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"))
    talk = said.where("agent_id IS NULL").groupBy("session_id").agg(F.count_if(F.size("texts") > 0).alias("assistant_turns"))
    busy = found.where("agent_id IS NULL").groupBy("session_id").agg(F.countDistinct("turn_index").alias("tool_turns"))
    rows = meta.withColumn("project", project)
    for part in (counts, subagents, own, talk, busy, turns.first_prompts(said)):
        rows = rows.join(part, "session_id", "left")
    rows = rows.fillna(0, ["turn_count", "subagent_count", "n_calls", "assistant_turns", "tool_turns"])
    if plans is not None:
        rows = turns.linked_plans(rows, plans)
    if facets is not None:
        brief = facets.select("session_id", F.nullif("brief_summary", F.lit("")).alias("brief"))
        rows = rows.join(brief, "session_id", "left").withColumn("first_prompt", F.coalesce("brief", "first_prompt")).drop("brief")
    moment = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    rows = rows.withColumns({"created_at": moment(F.col("created_at")), "last_active_at": moment(F.col("last_active_at"))})
    rows = settled(rows.withColumnsRenamed({"gitBranch": "git_branch", "permissionMode": "permission_mode"}))
    named = found.join(rows.select("session_id", "project", F.col("created_at").alias("ts")), "session_id")
    if agents is not None:
        named = named.join(agents.select("session_id", "agent_id", "agent_type"), ["session_id", "agent_id"], "left")
    calls = settled(named.withColumn("file_path", F.get_json_object("input", "$.file_path")))
    direct = calls.where("agent_id IS NULL")
    return {"sessions": rows, "calls": calls, "turns": said, "breakdown": settled(overview.tool_breakdown(direct)), "files": settled(overview.files_edited(direct)), "models": settled(turns.models_used(lines))}


def details(found: dict[str, DataFrame]) -> DataFrame:
    """A nested document per session: its facts, its turns with their calls in order, and its subagents'."""
    call = F.struct("call_pos", "tool_use_id", "tool_name", "input", "content_length", "result")
    calls = found["calls"].groupBy("session_id", "agent_id", "turn_index").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    rows = turns.on_turn(found["turns"], calls)
    turn = F.struct("turn_index", "user_prompt", "ts", "thinking", "texts", "model", "calls")
    nested = rows.groupBy("session_id", "agent_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    main = nested.where("agent_id IS NULL").drop("agent_id")
    agents = nested.where("agent_id IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("agent_id", "turns"))).alias("subagents"))
    return found["sessions"].join(main, "session_id", "left").join(agents, "session_id", "left")


def overview_tables(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every aggregate over all sessions, by name."""
    sessions, calls, files = found["sessions"], found["calls"].where("agent_id IS NULL"), found["files"]
    trends = settled(overview.weekly_tool_trends(calls, sessions))
    grams = sequences.top_patterns(sequences.maximal(settled(sequences.ngrams(found["calls"].withColumn("own", F.col("agent_id").isNotNull()), ["own", "agent_id", *ORDER]))))
    return {
        "index": overview.session_index(sessions.drop("plan")), "projects": overview.project_index(sessions), "cards": overview.overview_cards(sessions),
        "heatmap": overview.heatmap(sessions), "heatmap_intensity": overview.heatmap_intensity(sessions), "project_distribution": overview.project_distribution(sessions),
        "weekly_tool_trends": trends, "weekly_category_share": overview.weekly_category_share(trends), "duration_histogram": overview.duration_histogram(sessions),
        "top_files": overview.top_files(calls), "model_usage": found["models"].groupBy("model").agg(F.sum("n_lines").alias("n_lines")),
        "plan_mode_usage": overview.plan_mode_usage(sessions), "long_sessions": overview.long_sessions(sessions), "hot_files": overview.hot_files(calls),
        "tool_trigrams": sequences.trigrams(calls, ORDER), "patterns": grams, "session_files": overview.session_files(files), "tool_share": overview.session_tool_share(found["breakdown"]),
        "turn_summary": overview.turn_summary(calls, found["turns"].where("agent_id IS NULL")), "subagents": overview.subagent_summary(found["calls"].where("agent_id IS NOT NULL")),
    }


def knowledge_tables(found: dict[str, DataFrame], facets: DataFrame | None = None, as_of: str | None = None) -> dict[str, DataFrame]:
    """The topics, their graph and what it holds, by name."""
    own = found["turns"].where("agent_id IS NULL")
    whole = overview.tool_breakdown(found["calls"])
    graph = knowledge.build(found["sessions"], whole, own, found["files"], facets=facets, as_of=as_of)
    return {"topics": graph.topics, "topic_members": graph.members, "topic_edges": graph.edges, "topic_communities": graph.communities, "topic_centrality": graph.centrality}


def analyze(spark: SparkSession, root: str, out: str, name: str, as_of: str | None = None, facets: DataFrame | None = None, plans: DataFrame | None = None, buckets: int = output.BUCKETS) -> DataFrame:
    """Reads the logs below root, writes the run called name below out and returns its counters as one row."""
    run = logs.Run()
    found = session_tables(logs.read_lines(spark, root, run=run), plans, facets, logs.agent_types(spark, root))
    output.write(spark, out, name, details(found), overview_tables(found) | knowledge_tables(found, facets, as_of), buckets, run=run)
    return run.summary(spark)
