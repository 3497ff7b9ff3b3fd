"""Topics: groups of sessions, their descriptions, the graph between them and their worth for reuse.

members: (topic_id, session_id). sessions and calls as in overview.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators import features
from loomline.operators.iterate import settled

# Verbs that name an action, in English and by Japanese patterns.
VERBS = """fix add implement create update refactor remove delete move rename test debug optimize migrate deploy configure setup
integrate build review investigate analyze check resolve extract convert""".split()
VERBS_JA = (
    ("修正", "fix"), ("追加", "add"), ("実装", "implement"), ("作成|作って", "create"), ("更新", "update"), ("リファクタ", "refactor"), ("削除", "remove"),
    ("テスト", "test"), ("デバッグ", "debug"), ("最適化", "optimize"), ("移行|マイグレ", "migrate"), ("設定|セットアップ", "configure"), ("統合", "integrate"),
    ("ビルド", "build"), ("レビュー", "review"), ("調査", "investigate"), ("確認|チェック", "check"), ("解決", "resolve"),
)
HOUR = 3600


def first_by(rows: DataFrame, by: list[str], *order: Column, most: int = 1) -> DataFrame:
    nth = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(nth)).where(F.col("place") <= most)


def listed(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """An array of a column in the order of place."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(name))


def centroids(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(topic_id, term, weight): the mean of the sessions' term weights."""
    size = members.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    sums = members.join(weights, "session_id").groupBy("topic_id", "term").agg(F.sum("weight").alias("total"))
    return sums.join(size, "topic_id").select("topic_id", "term", (F.col("total") / F.col("size")).alias("weight"))


def topic_keywords(centres: DataFrame, most: int = 5) -> DataFrame:
    """(topic_id, place, term, weight): each topic's heaviest terms; weights are compared at nine digits."""
    return first_by(centres.where("weight > 0").withColumn("weight", F.round("weight", 9)), ["topic_id"], F.desc("weight"), F.col("term"), most=most)


def topic_meta(members: DataFrame, sessions: DataFrame) -> DataFrame:
    rows = members.join(sessions, "session_id")
    sums = rows.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("duration_minutes").alias("total_duration_minutes"), F.sum("n_calls").alias("total_tool_calls"),
        F.min("created_at").alias("first_seen"), F.max("last_active_at").alias("last_seen"), F.countDistinct("project").alias("n_projects"),
    )
    counts = rows.groupBy("topic_id", "project").agg(F.count(F.lit(1)).alias("n"))
    main = first_by(counts, ["topic_id"], F.desc("n"), F.col("project")).select("topic_id", "project")
    return sums.join(main, "topic_id")


def topic_label(keywords: DataFrame, meta: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """The shortest goal of a topic's sessions, cut at 80, else its first three keywords; with the project's last segment."""
    words = listed(keywords.where("place <= 3"), ["topic_id"], "term", "words")
    rows = meta.join(words, "topic_id", "left")
    if goals is not None:
        shortest = goals.where("underlying_goal <> ''").groupBy("topic_id").agg(F.min(F.struct(F.length("underlying_goal").alias("n"), "underlying_goal"))["underlying_goal"].alias("goal"))
        rows = rows.join(shortest, "topic_id", "left")
    else:
        rows = rows.withColumn("goal", F.lit(None).cast("string"))
    goal = F.when(F.length("goal") > 80, F.concat(F.left("goal", F.lit(77)), F.lit("..."))).otherwise(F.col("goal"))
    base = F.coalesce(goal, F.array_join("words", ", "), F.lit(""))
    suffix = F.when(F.col("n_projects") > 1, F.concat("n_projects", F.lit(" projects"))).otherwise(F.element_at(F.split("project", "/"), -1))
    return rows.select("topic_id", F.concat(base, F.lit(" ("), suffix, F.lit(")")).alias("label"))


def topic_prompts(members: DataFrame, weights: DataFrame, prompts: DataFrame, most: int = 3) -> DataFrame:
    """(topic_id, place, prompt): prompts over 10 characters of the sessions nearest to the topic's centre, cut at 150."""
    centre = centroids(members, weights)
    length = centre.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = members.join(weights, "session_id").join(centre.withColumnRenamed("weight", "c"), ["topic_id", "term"]).groupBy("topic_id", "session_id").agg(F.sum(F.col("weight") * F.col("c")).alias("dot"))
    near = dot.join(length, "topic_id").select("topic_id", "session_id", F.round(F.try_divide("dot", "norm"), 9).alias("score"))
    rows = near.join(prompts, "session_id").where(F.length("user_prompt") > 10).withColumn("prompt", T.cut(F.col("user_prompt"), 150, "..."))
    once = first_by(rows, ["topic_id", "prompt"], F.desc("score"), F.col("session_id"), F.col("turn_index")).drop("place")
    return first_by(once, ["topic_id"], F.desc("score"), F.col("session_id"), F.col("turn_index"), most=most).select("topic_id", "place", "prompt", "score")


def tool_signature(members: DataFrame, breakdown: DataFrame, most: int = 5) -> DataFrame:
    """(topic_id, place, tool_name, weight): ln(1 + calls) idf at two digits."""
    sums = members.join(breakdown, "session_id").groupBy("topic_id", "tool_name").agg(F.sum("n_calls").alias("n"))
    weight = T.half_up(F.log1p("n") * F.col("idf"), 2)
    rows = sums.join(F.broadcast(features.tool_idf(breakdown)), "tool_name").withColumn("weight", weight)
    return first_by(rows, ["topic_id"], F.desc("weight"), F.col("tool_name"), most=most).select("topic_id", "place", "tool_name", "weight")


def dominant_action(prompts: DataFrame) -> DataFrame:
    """(topic_id, action): the verb that occurs most in a topic's prompts (topic_id, prompt), `work on` without any."""
    words = prompts.select("topic_id", F.explode(F.split(F.lower("prompt"), f"{T.SPACE}+")).alias("w")).select("topic_id", F.regexp_replace("w", "[^a-z]", "").alias("action")).where(F.col("action").isin(*VERBS))
    japanese = prompts.select("topic_id", F.explode(F.array_compact(F.array(*[F.when(F.col("prompt").rlike(p), v) for p, v in VERBS_JA]))).alias("action"))
    counts = words.unionByName(japanese).groupBy("topic_id", "action").agg(F.count(F.lit(1)).alias("n"))
    best = first_by(counts, ["topic_id"], F.desc("n"), F.col("action")).select("topic_id", "action")
    return prompts.select("topic_id").distinct().join(best, "topic_id", "left").fillna("work on", ["action"])


def suggested_prompt(actions: DataFrame, keywords: DataFrame, signature: DataFrame) -> DataFrame:
    words = listed(keywords.where("place <= 3"), ["topic_id"], "term", "words")
    tools = listed(signature.where("place <= 3"), ["topic_id"], "tool_name", "tools")
    rows = actions.join(words, "topic_id", "left").join(tools, "topic_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("topic_id", F.concat("action", F.lit(" "), F.array_join(F.coalesce("words", none), "/"), F.lit(" — tools: "), F.array_join(F.coalesce("tools", none), ", ")).alias("prompt"))


def dominant_role(members: DataFrame, sessions: DataFrame, breakdown: DataFrame) -> DataFrame:
    """subagent-delegated, tool-heavy or user-driven by the shares of agent calls and subagents, and of calls."""
    agents = breakdown.groupBy("session_id").agg(F.sum("n_calls").alias("calls"), F.sum(F.when(F.col("tool_name") == "Agent", F.col("n_calls")).otherwise(0)).alias("delegated"))
    extra = F.col("subagent_count") if "subagent_count" in sessions.columns else F.lit(0)
    rows = members.join(sessions.select("session_id", "turn_count", extra.alias("subagents")), "session_id").join(agents, "session_id", "left").fillna(0)
    sums = rows.groupBy("topic_id").agg(F.sum("turn_count").alias("u"), F.sum("calls").alias("c"), F.sum(F.col("delegated") + F.col("subagents")).alias("a"))
    total = F.greatest(F.col("u") + F.col("c") + F.col("a"), F.lit(1))
    return sums.select("topic_id", F.when(F.col("a") / total > 0.15, "subagent-delegated").when(F.col("c") / total > 0.6, "tool-heavy").otherwise("user-driven").alias("role"))


def file_overlap(members: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, shared, overlap) of topics that edit a file in common: Jaccard similarity of their edited files."""
    own = members.join(files, "session_id").select("topic_id", "file_path").distinct()
    sizes = own.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    pairs = own.select(F.col("topic_id").alias("src"), "file_path").join(own.select(F.col("topic_id").alias("dst"), "file_path"), "file_path").where("src < dst")
    shared = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    left, right = sizes.select(F.col("topic_id").alias("src"), F.col("size").alias("a")), sizes.select(F.col("topic_id").alias("dst"), F.col("size").alias("b"))
    return shared.join(left, "src").join(right, "dst").select("src", "dst", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("overlap"))


def session_overlap(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """(src, dst, overlap): 0.6 for topics with sessions on one project's branch, else 0.4 for sessions that begin within
    an hour of each other. Two starts in one hour of the day are that near; of two hours in a row, the last start of one
    topic in the first and the first start of the other in the second decide. So a topic has a row an hour, and work is
    those rows and the pairs of topics of an hour, however many sessions begin in it."""
    rows = members.join(sessions.select("session_id", "project", "git_branch", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")), "session_id")
    branches = rows.where("git_branch <> ''").select("topic_id", "project", "git_branch").distinct()
    same = branches.join(branches.withColumnRenamed("topic_id", "dst"), ["project", "git_branch"]).where("topic_id < dst").select(F.col("topic_id").alias("src"), "dst", F.lit(0.6).alias("overlap"))
    hours = rows.where("us IS NOT NULL").groupBy("topic_id", F.floor(F.col("us") / (HOUR * 1000000)).alias("hour")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    one = hours.select(F.col("topic_id").alias("src"), "hour", "last")
    within = one.join(hours.select(F.col("topic_id").alias("dst"), "hour"), "hour").where("src < dst").select("src", "dst")
    after = hours.select(F.col("topic_id").alias("dst"), (F.col("hour") - 1).alias("hour"), "first")
    across = one.join(after, "hour").where((F.col("src") != F.col("dst")) & (F.col("first") - F.col("last") < HOUR * 1000000))
    near = within.unionByName(across.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct().withColumn("overlap", F.lit(0.4))
    return same.unionByName(near).groupBy("src", "dst").agg(F.max("overlap").alias("overlap"))


def semantic(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, dst, cosine) of the topics' mean vectors; vectors: (session_id, dim, value)."""
    centre = members.join(vectors, "session_id").groupBy("topic_id", "dim").agg(F.avg("value").alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("topic_id")))
    centre = centre.withColumn("value", F.try_divide(F.col("value"), length)).where("value <> 0")
    pairs = centre.select(F.col("topic_id").alias("src"), "dim", "value").join(centre.select(F.col("topic_id").alias("dst"), "dim", F.col("value").alias("other")), "dim").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.sum(F.col("value") * F.col("other")).alias("cosine"))


def bounded_edges(members: DataFrame, vectors: DataFrame, files: DataFrame, overlap: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of edges() without a row for every pair of topics: vectors as in semantic, over few dimensions, files and
    overlap as the signals give them.

    Without a common file or a session overlap an edge needs a cosine of least / 0.4: blocked products find those and emit
    no others. For pairs that have either, the cosine is worked out by itself.
    """
    from loomline.operators.vectors import dot, pairs, unit_vectors

    centre = members.join(vectors, "session_id").groupBy("topic_id", "dim").agg(F.avg("value").alias("value"))
    dims = vectors.select("dim").distinct()  # latent dimensions or tools
    whole = centre.select("topic_id").distinct().crossJoin(F.broadcast(dims)).join(centre, ["topic_id", "dim"], "left").fillna(0.0, ["value"])
    arrays = whole.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    units = settled(unit_vectors(arrays, "topic_id", "v"))
    far = pairs(units, least=least / 0.4 - 1e-9).select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine")
    other = files.select("src", "dst").unionByName(overlap.select("src", "dst")).distinct()
    side = lambda c: units.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    known = other.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", dot(F.col("v_src"), F.col("v_dst")).alias("cosine"))
    return edges(known.unionByName(far.join(other, ["src", "dst"], "left_anti")), files, overlap, least)


def edges(semantic: DataFrame, files: DataFrame, overlap: DataFrame, least: float = 0.2) -> DataFrame:
    """(src, dst, strength, semantic, file_overlap, session_overlap) where 0.4, 0.3 and 0.3 of the signals make `least`."""
    joined = semantic.select("src", "dst", F.col("cosine").alias("semantic")).join(files.select("src", "dst", F.col("overlap").alias("file_overlap")), ["src", "dst"], "full")
    joined = joined.join(overlap.select("src", "dst", F.col("overlap").alias("session_overlap")), ["src", "dst"], "full").fillna(0.0)
    strength = F.col("semantic") * 0.4 + F.col("file_overlap") * 0.3 + F.col("session_overlap") * 0.3
    kept = joined.withColumn("exact", F.round(strength, 12)).where(F.col("exact") >= least)
    return kept.select("src", "dst", T.half_up(F.col("exact"), 2).alias("strength"), "semantic", "file_overlap", "session_overlap")


def edge_type(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """edges with type; projects: (topic_id, project, projects) with the main and the set of all."""
    side = lambda end, n: projects.select(F.col("topic_id").alias(end), F.col("project").alias(f"p{n}"), F.col("projects").alias(f"ps{n}"))
    rows = edges.join(side("src", 1), "src").join(side("dst", 2), "dst")
    a, b, c = F.col("semantic") * 0.4, F.col("file_overlap") * 0.3, F.col("session_overlap") * 0.3
    most = F.greatest(a, b, c)
    kind = F.when(~F.arrays_overlap("ps1", "ps2") & (F.col("p1") != F.col("p2")), "cross-project-bridge").when((most == b) & (F.col("file_overlap") > 0), "shared-module").when(most == c, "workflow-continuation").otherwise("semantic-similarity")
    return rows.withColumn("type", kind).drop("p1", "p2", "ps1", "ps2")


def shared_keywords(centres: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, place, term) of the terms with weight over 0.01 in both topics, by product."""
    heavy = centres.where("weight > 0.01")
    rows = pairs.select("src", "dst").join(heavy.select(F.col("topic_id").alias("src"), "term", F.col("weight").alias("a")), "src")
    rows = rows.join(heavy.select(F.col("topic_id").alias("dst"), "term", F.col("weight").alias("b")), ["dst", "term"]).withColumn("score", F.round(F.col("a") * F.col("b"), 12))
    return first_by(rows, ["src", "dst"], F.desc("score"), F.col("term"), most=most).select("src", "dst", "place", "term", "score")


def edge_label(typed: DataFrame, shared: DataFrame, files: DataFrame) -> DataFrame:
    """typed edges with a label: what their two topics share. shared: (src, dst, place, term); files: (src, dst,
    file_paths), the paths that both edit."""
    words = listed(shared, ["src", "dst"], "term", "words")
    rows = typed.join(words, ["src", "dst"], "left").join(files, ["src", "dst"], "left")
    terms = F.nullif(F.array_join("words", ", "), F.lit(""))
    folder = F.nullif(T.common_prefix(F.coalesce("file_paths", F.array().cast("array<string>")), directories=False), F.lit(""))
    ends = F.array_join(F.slice(F.split(F.get("file_paths", F.lit(0)), "/"), -2, 2), "/")
    label = (
        F.when(F.col("type") == "cross-project-bridge", F.concat(F.lit("cross-project: "), F.coalesce(terms, F.lit("related concepts"))))
        .when(F.col("type") == "shared-module", F.concat(F.lit("shared: "), F.coalesce(folder, ends, F.lit("files"))))
        .when(F.col("type") == "workflow-continuation", F.lit("workflow continuation"))
        .otherwise(F.concat(F.lit("related: "), F.coalesce(terms, F.lit("similar topics"))))
    )
    return rows.withColumn("label", label).drop("words", "file_paths")


def shared_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, file_paths): the paths that two topics both edit, in order."""
    own = members.join(files, "session_id").select("topic_id", "file_path").distinct()
    pairs = own.withColumnRenamed("topic_id", "src").join(own.withColumnRenamed("topic_id", "dst"), "file_path").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.array_sort(F.collect_set("file_path")).alias("file_paths"))


def facets_rollup(members: DataFrame, facets: DataFrame) -> DataFrame:
    """A row per topic with any labelled session: goals, classes, success, helpfulness, frictions and details."""
    rows = members.join(facets, "session_id", "left").withColumn("known", F.col("outcome").isNotNull() | F.col("claude_helpfulness").isNotNull() | F.col("underlying_goal").isNotNull())
    success = F.when(~F.col("known"), 0.5).when(F.col("outcome").isin("fully_achieved", "mostly_achieved"), 1.0).otherwise(0.0)
    sums = rows.groupBy("topic_id").agg(
        F.avg(success).alias("success_rate"), F.avg(F.when(F.col("known"), C.helpfulness(F.col("claude_helpfulness"))).otherwise(0.5)).alias("helpfulness"), F.max("known").alias("any_known"),
    ).where("any_known").drop("any_known")
    goals = rows.where("underlying_goal <> ''").groupBy("topic_id", "underlying_goal").agg(F.min("session_id").alias("at"))
    goals = listed(first_by(goals, ["topic_id"], F.col("at"), F.col("underlying_goal"), most=3), ["topic_id"], "underlying_goal", "goals")
    classes = rows.select("topic_id", F.explode(F.map_keys("goal_categories")).alias("raw")).groupBy("topic_id").agg(F.array_sort(F.collect_set(C.goal_class(F.col("raw")))).alias("categories"))
    counts = rows.select("topic_id", F.explode("friction_counts").alias("friction", "n")).groupBy("topic_id", "friction").agg(F.sum("n").alias("n"))
    frictions = listed(first_by(counts, ["topic_id"], F.desc("n"), F.col("friction"), most=5), ["topic_id"], "friction", "frictions")
    details = listed(first_by(rows.where("friction_detail <> ''"), ["topic_id"], F.col("session_id"), most=3), ["topic_id"], "friction_detail", "details")
    for part in (goals, classes, frictions, details):
        sums = sums.join(part, "topic_id", "left")
    return sums


def reusability(meta: DataFrame, as_of: str, rollup: DataFrame | None = None) -> DataFrame:
    """(topic_id, overall, frequency, time_cost, cross_project, recency): each signal over its largest, recency by as_of,
    which must not lie in a time zone other than the table's; with labels two more signals count."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 86400000000.0)
    rows = meta.withColumn("days", days).withColumn("mean_minutes", F.col("total_duration_minutes") / F.col("session_count"))
    most = rows.agg(F.max("session_count").alias("m_n"), F.max("n_projects").alias("m_p"), F.greatest(F.max("mean_minutes"), F.lit(1.0)).alias("m_t"), F.greatest(F.max("days"), F.lit(1.0)).alias("m_d"))
    rows = rows.crossJoin(F.broadcast(most))
    frequency, cost = F.col("session_count") / F.col("m_n"), F.col("mean_minutes") / F.col("m_t")
    cross = F.coalesce(F.try_divide(F.col("n_projects") - 1, F.col("m_p") - 1), F.lit(0.0))
    recency = F.coalesce(1 - F.col("days") / F.col("m_d"), F.lit(0.0))
    signals = {"frequency": frequency, "time_cost": cost, "cross_project": cross, "recency": recency}
    if rollup is not None:
        rows = rows.join(rollup.select("topic_id", "success_rate", "helpfulness"), "topic_id", "left").fillna(0.5, ["success_rate", "helpfulness"])
        overall = frequency * 0.30 + cost * 0.20 + cross * 0.20 + recency * 0.10 + F.col("success_rate") * 0.10 + F.col("helpfulness") * 0.10
    else:
        overall = frequency * 0.35 + cost * 0.25 + cross * 0.25 + recency * 0.15
    three = lambda c: T.half_up(F.round(c, 9), 3)
    return rows.select("topic_id", three(overall).alias("overall"), *[three(c).alias(k) for k, c in signals.items()])
