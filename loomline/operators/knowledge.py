"""The joined job: from sessions to topics with their graph.

sessions: (session_id, project, git_branch, created_at, last_active_at, duration_minutes, n_calls, turn_count), breakdown:
(session_id, tool_name, n_calls), turns: (session_id, turn_index, user_prompt, texts), files: (session_id, file_path),
facets: labels of sessions as the reader has them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.operators import features, graph, topics, vectors
from loomline.operators.iterate import settled

#: Below so many sessions each is a topic of its own.
FEW = 5


@dataclass
class Knowledge:
    """Tables of the job: topics (topic_id, what they are about, prompts, signature, action, score), members (topic_id,
    session_id), edges with type and label, communities (node, community), centrality (node, degree, centrality,
    betweenness), weights (session_id, term, weight) and keywords (topic_id, place, term)."""

    topics: DataFrame
    members: DataFrame
    edges: DataFrame
    communities: DataFrame
    centrality: DataFrame
    weights: DataFrame
    keywords: DataFrame


def embedded(sessions: DataFrame, breakdown: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """(id, v): the n sessions' unit vectors over the latent dimensions of terms, tools and structure."""
    extra = {c: F.lit(0) for c in ("subagent_count",) if c not in sessions.columns} | {c: F.col("turn_count") for c in ("assistant_turns", "tool_turns") if c not in sessions.columns}
    values = features.combined(weights, features.tool_vectors(breakdown), features.structure(sessions.withColumns(extra), breakdown))
    found, _, _ = vectors.svd(values, n)
    v = found.groupBy(F.col("session_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    return settled(v.where(F.exists("v", lambda x: x != 0)))


def clustered(sessions: DataFrame, embedding: DataFrame, categories: DataFrame | None) -> DataFrame:
    """(id, cluster) of every session; those without a vector are clusters of their own."""
    merges = settled(vectors.dendrogram(embedding))
    labels = settled(vectors.cut(merges, embedding.select("id"), vectors.elbow(merges)))
    labels = settled(vectors.split_oversized(labels, embedding))
    if categories is not None:
        labels = vectors.merge_narrow(labels, embedding, categories)
    alone = sessions.select(F.col("session_id").alias("id")).join(embedding, "id", "left_anti")
    return labels.unionByName(alone.select("id", F.col("id").alias("cluster")))


def build(
    sessions: DataFrame, breakdown: DataFrame, turns: DataFrame, files: DataFrame, facets: DataFrame | None = None, as_of: str | None = None,
    communities: bool = True, betweenness: bool = True, least: float = 0.2,
) -> Knowledge:
    """The whole job. A session's document is its prompts, assistant texts, edited paths and branch; sessions without a
    token leave. None left gives empty tables, fewer than five a topic each. Topics are numbered by their least session:
    topic-001 and so on. as_of (else the last activity) is the day that recency is measured from. Without `communities`
    every topic is a community of its own; without `betweenness` that of all is 0."""
    if "texts" not in turns.columns:
        turns = turns.withColumn("texts", F.array().cast("array<string>"))
    counts = settled(features.term_counts(features.session_texts(turns, files, sessions.select("session_id", "git_branch")), "session_id"))
    known = counts.select("session_id").distinct()
    active = settled(sessions.join(known, "session_id", "left_semi"))
    ours = lambda df: settled(df.join(active.select("session_id"), "session_id", "left_semi"))
    breakdown, turns, files = ours(breakdown), ours(turns), ours(files)
    facets = ours(facets) if facets is not None else None
    weights, n = settled(features.tfidf(counts, "session_id")), active.count()
    embedding = embedded(active, breakdown, weights, n) if n > 1 else None
    if n < FEW:
        labels = active.select(F.col("session_id").alias("id"), F.col("session_id").alias("cluster"))
    else:
        categories = facets.select(F.col("session_id").alias("id"), F.explode(F.map_keys("goal_categories")).alias("raw")).select("id", C.goal_class(F.col("raw")).alias("category")).distinct() if facets is not None else None
        labels = clustered(active, embedding, categories)
    labels = settled(labels)
    members = settled(labels.join(numbered(labels), "cluster").select("topic_id", F.col("id").alias("session_id")))
    dims = embedding.select(F.col("id").alias("session_id"), F.posexplode("v").alias("dim", "value")) if embedding is not None else members.select("session_id", F.lit(0).alias("dim"), F.lit(0.0).alias("value"))
    meta = settled(topics.topic_meta(members, active))
    centres = settled(topics.centroids(members, weights))
    words = settled(topics.topic_keywords(centres))
    table = described(members, active, breakdown, turns, weights, meta, words, facets, as_of)
    edges = settled(topics.bounded_edges(members, dims, topics.file_overlap(members, files), topics.session_overlap(members, active), least))
    projects = members.join(active.select("session_id", F.col("project").alias("of")), "session_id").groupBy("topic_id").agg(F.collect_set("of").alias("projects")).join(meta.select("topic_id", "project"), "topic_id")
    typed = topics.edge_type(edges, projects)
    labelled = settled(topics.edge_label(typed, topics.shared_keywords(centres, edges), topics.shared_files(members, files)))
    nodes = settled(members.select(F.col("topic_id").alias("node")).distinct())
    groups = graph.communities(nodes, edges) if communities else nodes.select("node", F.col("node").alias("community"))
    between = graph.betweenness(nodes, edges) if betweenness else nodes.select("node", F.lit(0.0).alias("betweenness"))
    return Knowledge(settled(table), members, labelled, settled(groups), settled(graph.degree(nodes, edges).join(between, "node")), weights, words)


def described(members: DataFrame, sessions: DataFrame, breakdown: DataFrame, turns: DataFrame, weights: DataFrame, meta: DataFrame, words: DataFrame, facets: DataFrame | None, as_of: str | None) -> DataFrame:
    """The table of topics: meta with label, keywords, role, prompts, signature, action, suggested_prompt and overall."""
    goals, rollup = None, None
    if facets is not None:
        goals = members.join(facets.select("session_id", "underlying_goal"), "session_id").select("topic_id", "underlying_goal")
        rollup = settled(topics.facets_rollup(members, facets))
    # A cluster may hold sessions without a weight; their prompts count after those that are near the centre.
    prompts = settled(topics.topic_prompts(members, weights, turns.select("session_id", "turn_index", "user_prompt")))
    signature = settled(topics.tool_signature(members, breakdown))
    said = members.join(turns.select("session_id", F.col("user_prompt").alias("prompt")), "session_id").where("prompt IS NOT NULL").select("topic_id", "prompt")
    actions = meta.select("topic_id").join(topics.dominant_action(said), "topic_id", "left").fillna("work on", ["action"])
    day = as_of if as_of is not None else meta.agg(F.max("last_seen").cast("string")).first()[0] or "1970-01-01"
    tools = signature.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tool_name", "weight"))), lambda x: F.struct(x["tool_name"].alias("tool"), x["weight"].alias("weight"))).alias("signature"))
    parts = (
        topics.topic_label(words, meta, goals), topics.listed(words, ["topic_id"], "term", "keywords"), topics.dominant_role(members, sessions, breakdown), topics.listed(prompts, ["topic_id"], "prompt", "prompts"),
        tools, actions, topics.suggested_prompt(actions, words, signature).withColumnRenamed("prompt", "suggested_prompt"), topics.reusability(meta, day, rollup),
    )
    table = meta
    for part in parts:
        table = table.join(part, "topic_id", "left")
    return table


def numbered(labels: DataFrame) -> DataFrame:
    """(cluster, topic_id): clusters in the order of their least member, numbered on from range to range of them."""
    first = labels.groupBy("cluster").agg(F.min("id").alias("least"))
    ranged = settled(first.repartitionByRange("least").sortWithinPartitions("least").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one row a partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = labels.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("least")) + F.col("start")
    named = ranged.join(F.broadcast(offsets), "part").withColumn("place", place)
    return named.select("cluster", F.concat(F.lit("topic-"), F.lpad(F.col("place").cast("string"), F.greatest(F.lit(3), F.length(F.col("place").cast("string"))), F.lit("0"))).alias("topic_id"))
