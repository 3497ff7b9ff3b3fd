"""Queries over topics and their graph: projects play topics of sessions, embeddings play their vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators import features, graph, knowledge, output, overview, report, sequences, topics, vectors
from loomline.operators.iterate import shared_dir
from loomline.plans import views
from loomline.plans.overview import BREAKDOWN, COVERED, EDITED, GRAMS, ORDER, document_terms, query, tokens_sql
from loomline.plans.views import SQL

AS_OF = "2024-12-31 00:00:00"
NEAR = 0.4
TOOL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORY.items())
MEMBERS = "members AS (SELECT project AS topic_id, session_id FROM sess)"
CENTRES = "tok AS (" + tokens_sql("doc_id", "text", "documents") + """), counts AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL), nd AS (SELECT count(DISTINCT doc_id) AS docs FROM counts), vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term), kept AS (SELECT term, df, ln(docs / CAST(df AS DOUBLE)) AS idf FROM vocab, nd WHERE df >= 2 AND df <= greatest(2, floor(docs * 0.8))),
w AS (SELECT doc_id, term, ln(1 + n) * idf AS w FROM counts JOIN kept USING (term)), u AS (SELECT doc_id, term, CASE WHEN l > 0 THEN w / l ELSE 0 END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM w)),
centres AS (SELECT source AS topic_id, term, sum(weight) / any_value(size) AS weight FROM u JOIN documents USING (doc_id) JOIN (SELECT source, count(*) AS size FROM documents GROUP BY 1) z USING (source) GROUP BY ALL)"""


def members_of(sessions):
    return sessions.select(F.col("project").alias("topic_id"), "session_id")


def parts(spark, sf):
    calls = views.calls(spark, sf)
    sessions = views.sessions(calls)
    return calls, sessions, members_of(sessions)


def source_members(spark, sf):
    return views.table(spark, sf, "documents").select(F.col("source").alias("topic_id"), F.col("doc_id").alias("session_id"))


def source_weights(spark, sf):
    return features.tfidf(document_terms(spark, sf), "doc_id").withColumnRenamed("doc_id", "session_id")


def source_keywords(spark, sf):
    return topics.topic_keywords(topics.centroids(source_members(spark, sf), source_weights(spark, sf)))


@query(f"WITH {CENTRES} SELECT topic_id, term, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS place, round(weight, 6) AS weight FROM centres WHERE weight > 0 QUALIFY place <= 5")
def topic_keywords(spark, sf):
    return source_keywords(spark, sf).withColumn("weight", F.round("weight", 6))


META = """meta AS (SELECT topic_id, count(*) AS session_count, CAST(sum(duration_minutes) AS BIGINT) AS total_duration_minutes, CAST(sum(n_calls) AS BIGINT) AS total_tool_calls, min(created_at) AS first_seen, max(last_active_at) AS last_seen, count(DISTINCT project) AS n_projects FROM (SELECT git_branch AS topic_id, * FROM sess) GROUP BY 1),
main AS (SELECT git_branch AS topic_id, project FROM sess GROUP BY git_branch, project QUALIFY row_number() OVER (PARTITION BY git_branch ORDER BY count(*) DESC, project) = 1)"""


def branch_meta(spark, sf):
    _, sessions, _ = parts(spark, sf)
    return topics.topic_meta(sessions.select(F.col("git_branch").alias("topic_id"), "session_id"), sessions)


@query(SQL + f", {META} SELECT * FROM meta JOIN main USING (topic_id)")
def topic_meta(spark, sf):
    return branch_meta(spark, sf)


@query(SQL + f", {BREAKDOWN}, {MEMBERS}, n AS (SELECT count(DISTINCT session_id) AS docs FROM breakdown), i AS (SELECT tool_name, CASE WHEN docs = count(*) THEN 1.0 ELSE ln(docs / CAST(count(*) AS DOUBLE)) END AS idf FROM breakdown, n GROUP BY tool_name, docs), s AS (SELECT topic_id, tool_name, sum(n_calls) AS n FROM members JOIN breakdown USING (session_id) GROUP BY ALL) SELECT topic_id, tool_name, floor(ln(1 + n) * idf * 100 + 0.5) / 100.0 AS weight, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY floor(ln(1 + n) * idf * 100 + 0.5) DESC, tool_name) AS INTEGER) AS place FROM s JOIN i USING (tool_name) QUALIFY place <= 5")
def tool_signature(spark, sf):
    calls, _, members = parts(spark, sf)
    return topics.tool_signature(members, overview.tool_breakdown(calls))


@query(SQL + f", {MEMBERS}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE tool_name = 'Agent') AS a FROM calls GROUP BY 1), s AS (SELECT topic_id, sum(turn_count) AS u, sum(n) AS c, sum(a) AS a FROM members JOIN sess USING (session_id) JOIN c USING (session_id) GROUP BY 1) SELECT topic_id, CASE WHEN a / CAST(u + c + a AS DOUBLE) > 0.15 THEN 'subagent-delegated' WHEN c / CAST(u + c + a AS DOUBLE) > 0.6 THEN 'tool-heavy' ELSE 'user-driven' END AS role FROM s")
def dominant_role(spark, sf):
    calls, sessions, members = parts(spark, sf)
    return topics.dominant_role(members, sessions, overview.tool_breakdown(calls))


@query(SQL + ", w AS (SELECT session_id % 10 AS topic_id, unnest(string_split_regex(lower(user_prompt), '\\s+')) AS x FROM turns), v AS (SELECT topic_id, regexp_replace(x, '[^a-z]', '', 'g') AS action FROM w), c AS (SELECT topic_id, action, count(*) AS n FROM v WHERE action IN (" + ", ".join(f"'{v}'" for v in topics.VERBS) + ") GROUP BY ALL), b AS (SELECT topic_id, action FROM c QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, action) = 1) SELECT t.topic_id, coalesce(action, 'work on') AS action FROM (SELECT DISTINCT session_id % 10 AS topic_id FROM turns) t LEFT JOIN b USING (topic_id)")
def dominant_action(spark, sf):
    return topics.dominant_action(views.prompts(spark, sf).select((F.col("session_id") % 10).alias("topic_id"), F.col("user_prompt").alias("prompt")))


OVERLAP = f"own AS (SELECT DISTINCT topic_id, file_path FROM members JOIN files USING (session_id)), sz AS (SELECT topic_id, count(*) AS n FROM own GROUP BY 1), fo AS (SELECT a.topic_id AS src, b.topic_id AS dst, count(*) AS shared, count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS overlap FROM own a JOIN own b ON a.file_path = b.file_path AND a.topic_id < b.topic_id JOIN sz x ON x.topic_id = a.topic_id JOIN sz y ON y.topic_id = b.topic_id GROUP BY 1, 2)"
SESSIONS = "so AS (SELECT a.git_branch AS src, b.git_branch AS dst, max(CASE WHEN a.project = b.project AND a.git_branch = b.git_branch THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS overlap FROM sess a JOIN sess b ON a.git_branch < b.git_branch AND abs(datediff('microsecond', a.created_at, b.created_at)) < 3600000000 GROUP BY ALL)"


@query(SQL + f", {EDITED}, {MEMBERS}, {OVERLAP} SELECT src, dst, shared, round(overlap, 6) AS overlap FROM fo")
def file_overlap(spark, sf):
    calls, _, members = parts(spark, sf)
    return topics.file_overlap(members, overview.files_edited(calls)).withColumn("overlap", F.round("overlap", 6))


@query(SQL + f", {SESSIONS} SELECT * FROM so")
def session_overlap(spark, sf):
    _, sessions, _ = parts(spark, sf)
    return topics.session_overlap(sessions.select(F.col("git_branch").alias("topic_id"), "session_id"), sessions)


# The project topics' vectors are their sessions' shares of calls by tool.
SIGNALS = f"""shares AS (SELECT topic_id, tool_name, sum(n_calls / CAST(t AS DOUBLE)) / any_value(z) AS x FROM breakdown JOIN (SELECT session_id, sum(n_calls) AS t FROM breakdown GROUP BY 1) q USING (session_id) JOIN members USING (session_id) JOIN (SELECT topic_id, count(*) AS z FROM members GROUP BY 1) p USING (topic_id) GROUP BY ALL),
len AS (SELECT topic_id, sqrt(sum(x * x)) AS l FROM shares GROUP BY 1), se AS (SELECT a.topic_id AS src, b.topic_id AS dst, sum(a.x * b.x) / any_value(u.l * v.l) AS cosine FROM shares a JOIN shares b ON a.tool_name = b.tool_name AND a.topic_id < b.topic_id JOIN len u ON u.topic_id = a.topic_id JOIN len v ON v.topic_id = b.topic_id GROUP BY 1, 2),
near AS (SELECT a.project AS src, b.project AS dst, 0.4::DOUBLE AS overlap FROM sess a JOIN sess b ON a.project < b.project AND abs(datediff('microsecond', a.created_at, b.created_at)) < 3600000000 GROUP BY ALL),
sig AS (SELECT src, dst, coalesce(cosine, 0) AS semantic, coalesce(fo.overlap, 0) AS file_overlap, coalesce(near.overlap, 0) AS session_overlap FROM se FULL JOIN fo USING (src, dst) FULL JOIN near USING (src, dst)),
edges AS (SELECT *, floor(round(semantic * 0.4 + file_overlap * 0.3 + session_overlap * 0.3, 12) * 100 + 0.5) / 100.0 AS strength FROM sig WHERE round(semantic * 0.4 + file_overlap * 0.3 + session_overlap * 0.3, 12) >= 0.2)"""
EDGES = SQL + f", {BREAKDOWN}, {EDITED}, {MEMBERS}, {OVERLAP}, {SIGNALS} "
ROUNDED = "src, dst, strength, round(semantic, 6) AS semantic, round(file_overlap, 6) AS file_overlap, session_overlap"


def shares(breakdown, members):
    """(session_id, dim, value) for every tool that any session uses, zeros included in the mean by their absence."""
    total = breakdown.groupBy("session_id").agg(F.sum("n_calls").alias("t"))
    own = breakdown.join(total, "session_id").select("session_id", F.col("tool_name").alias("dim"), (F.col("n_calls") / F.col("t")).alias("value"))
    tools = breakdown.select(F.col("tool_name").alias("dim")).distinct()
    return members.select("session_id").crossJoin(F.broadcast(tools)).join(own, ["session_id", "dim"], "left").fillna(0.0, ["value"])


def project_edges(spark, sf):
    calls, sessions, members = parts(spark, sf)
    breakdown = overview.tool_breakdown(calls)
    return topics.bounded_edges(members, shares(breakdown, members), topics.file_overlap(members, overview.files_edited(calls)), topics.session_overlap(members, sessions))


def rounded(edges):
    return edges.withColumns({"semantic": F.round("semantic", 6), "file_overlap": F.round("file_overlap", 6)})


@query(EDGES + f"SELECT {ROUNDED} FROM edges")
def edge_strength(spark, sf):
    return rounded(project_edges(spark, sf))


@query(EDGES + f"SELECT {ROUNDED}, CASE WHEN CAST(src[6:] AS INTEGER) % 2 <> CAST(dst[6:] AS INTEGER) % 2 THEN 'cross-project-bridge' WHEN greatest(semantic * 0.4, file_overlap * 0.3, session_overlap * 0.3) = file_overlap * 0.3 AND file_overlap > 0 THEN 'shared-module' WHEN greatest(semantic * 0.4, file_overlap * 0.3, session_overlap * 0.3) = session_overlap * 0.3 THEN 'workflow-continuation' ELSE 'semantic-similarity' END AS type FROM edges")
def edge_type(spark, sf):
    _, _, members = parts(spark, sf)
    half = (F.substring_index("topic_id", "p", -1).cast("int") % 2).cast("string")
    projects = members.select("topic_id").distinct().select("topic_id", half.alias("project"), F.array(half).alias("projects"))
    return rounded(topics.edge_type(project_edges(spark, sf), projects))


@query(f"WITH {CENTRES} SELECT a.topic_id AS src, b.topic_id AS dst, a.term, CAST(row_number() OVER (PARTITION BY a.topic_id, b.topic_id ORDER BY round(a.weight * b.weight, 12) DESC, a.term) AS INTEGER) AS place, round(a.weight * b.weight, 6) AS score FROM centres a JOIN centres b ON a.term = b.term AND a.topic_id < b.topic_id WHERE a.weight > 0.01 AND b.weight > 0.01 QUALIFY place <= 3")
def shared_keywords(spark, sf):
    centres = topics.centroids(source_members(spark, sf), source_weights(spark, sf))
    ids = centres.select("topic_id").distinct()
    pairs = ids.select(F.col("topic_id").alias("src")).crossJoin(ids.select(F.col("topic_id").alias("dst"))).where("src < dst")
    return topics.shared_keywords(centres, pairs).withColumn("score", F.round("score", 6))


SCORES = f"""f AS (SELECT *, greatest(0, datediff('microsecond', last_seen, TIMESTAMP '{AS_OF}') / 86400000000.0) AS days, total_duration_minutes / CAST(session_count AS DOUBLE) AS mm FROM meta), x AS (SELECT max(session_count) AS a, max(n_projects) AS b, greatest(max(mm), 1) AS c, greatest(max(days), 1) AS d FROM f),
g AS (SELECT topic_id, session_count / CAST(a AS DOUBLE) AS fr, mm / c AS tc, CASE WHEN b > 1 THEN (n_projects - 1) / CAST(b - 1 AS DOUBLE) ELSE 0 END AS cp, 1 - days / d AS re FROM f, x),
scores AS (SELECT topic_id, floor(round(CAST(fr * 0.35 + tc * 0.25 + cp * 0.25 + re * 0.15 AS DOUBLE), 9) * 1000 + 0.5) / 1000.0 AS overall, floor(round(CAST(fr AS DOUBLE), 9) * 1000 + 0.5) / 1000.0 AS frequency, floor(round(CAST(tc AS DOUBLE), 9) * 1000 + 0.5) / 1000.0 AS time_cost, floor(round(CAST(cp AS DOUBLE), 9) * 1000 + 0.5) / 1000.0 AS cross_project, floor(round(CAST(re AS DOUBLE), 9) * 1000 + 0.5) / 1000.0 AS recency FROM g)"""


@query(SQL + f", {META}, {SCORES} SELECT * FROM scores")
def reusability(spark, sf):
    return topics.reusability(branch_meta(spark, sf), AS_OF)


@query(SQL + f", {META}, {SCORES} SELECT topic_id, overall FROM scores ORDER BY overall DESC, topic_id")
def skill_candidates(spark, sf):
    return report.candidates(reusability(spark, sf))


@query(SQL + f", {META}, {SCORES} SELECT topic_id, overall FROM scores ORDER BY overall DESC, topic_id LIMIT 5")
def top_candidates(spark, sf):
    return report.top(reusability(spark, sf)).select("topic_id", "overall")


def facets_of(spark, sf):
    labels = views.table(spark, sf, "labels")
    return labels.select(
        F.col("doc_id").alias("session_id"), F.when(F.col("quality") == 1, "fully_achieved").otherwise("not_achieved").alias("outcome"), F.when(F.col("toxic") == 1, "unhelpful").otherwise("essential").alias("claude_helpfulness"),
        F.concat(F.lit("goal "), F.col("doc_id") % 7).alias("underlying_goal"), F.create_map(F.lit("fix_bug"), F.lit(1)).alias("goal_categories"),
        F.create_map(F.when(F.col("toxic") == 1, "tone").otherwise("speed"), F.lit(1) + F.col("quality")).alias("friction_counts"), F.lit("").alias("friction_detail"),
    )


@query("""WITH m AS (SELECT source AS topic_id, d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT topic_id, 'goal ' || (doc_id % 7) AS goal, min(doc_id) AS spot FROM m WHERE known GROUP BY topic_id, doc_id % 7 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY min(doc_id)) <= 3),
f AS (SELECT topic_id, CASE WHEN toxic = 1 THEN 'tone' ELSE 'speed' END AS friction, sum(1 + quality) AS n FROM m WHERE known GROUP BY ALL)
SELECT topic_id, round(avg(CASE WHEN NOT known THEN 0.5 ELSE quality END), 6) AS success_rate, round(avg(CASE WHEN NOT known THEN 0.5 WHEN toxic = 1 THEN 0 ELSE 1 END), 6) AS helpfulness,
(SELECT string_agg(goal, ', ' ORDER BY spot, goal) FROM g WHERE g.topic_id = m.topic_id) AS goals, (SELECT string_agg(friction, ', ' ORDER BY n DESC, friction) FROM f WHERE f.topic_id = m.topic_id) AS frictions FROM m GROUP BY topic_id HAVING bool_or(known)""")
def facets_rollup(spark, sf):
    found = topics.facets_rollup(source_members(spark, sf), facets_of(spark, sf))
    return found.select("topic_id", F.round("success_rate", 6).alias("success_rate"), F.round("helpfulness", 6).alias("helpfulness"), F.array_join("goals", ", ").alias("goals"), F.array_join("frictions", ", ").alias("frictions"))


VECTORS = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), unit AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS l FROM vec WHERE list_dot_product(v, v) > 0)"
SIMILAR = f"sim AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (a.l * b.l) AS cosine FROM unit a JOIN unit b ON a.id < b.id WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= {NEAR})"


def unit_embeddings(spark, sf):
    return vectors.unit_vectors(views.table(spark, sf, "embeddings"), "vec_id", "embedding")


@query(f"WITH {VECTORS}, {SIMILAR} SELECT a, b, round(cosine, 5) AS cosine FROM sim")
def cosine_pairs(spark, sf):
    return vectors.similar(unit_embeddings(spark, sf), NEAR).withColumn("cosine", F.round("cosine", 5))


@query(f"WITH {VECTORS}, e AS (SELECT label, unnest(v) / l AS x, unnest(range(64)) AS d FROM unit), c AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS l FROM c GROUP BY 1) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / any_value(u.l * w.l), 5) AS cosine FROM c a JOIN c b ON a.d = b.d AND a.label < b.label JOIN n u ON u.label = a.label JOIN n w ON w.label = b.label GROUP BY 1, 2")
def centroid_similarity(spark, sf):
    groups = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    return vectors.centroid_similarity(unit_embeddings(spark, sf), groups).withColumn("cosine", F.round("cosine", 5))


def embedding_graph(spark, sf):
    found = vectors.similar(unit_embeddings(spark, sf), NEAR)
    nodes = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))
    return nodes, found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("cosine", 9).alias("strength"))


@query(f"WITH {VECTORS}, {SIMILAR}, m AS (SELECT a AS node FROM sim UNION ALL SELECT b FROM sim), c AS (SELECT node, count(*) AS d FROM m GROUP BY 1) SELECT vec_id AS node, coalesce(d, 0) AS degree, floor(coalesce(d, 0) / CAST(count(*) OVER () - 1 AS DOUBLE) * 10000 + 0.5) / 10000.0 AS centrality FROM embeddings LEFT JOIN c ON node = vec_id")
def degree(spark, sf):
    return graph.degree(*embedding_graph(spark, sf))


@query(f"WITH {VECTORS}, {SIMILAR}, m AS (SELECT a AS node FROM sim UNION SELECT b FROM sim), n AS (SELECT count(*) AS n FROM embeddings) SELECT n AS n_nodes, (SELECT count(*) FROM sim) AS n_edges, n - (SELECT count(*) FROM m) AS n_isolated, floor(2.0 * (SELECT count(*) FROM sim) / (n * (n - 1)) * 10000 + 0.5) / 10000.0 AS density FROM n")
def graph_metrics(spark, sf):
    return graph.graph_metrics(*embedding_graph(spark, sf))


@query(f"WITH {VECTORS}, {SIMILAR}, e AS (SELECT a, b, round(cosine, 9) AS w FROM sim), m AS (SELECT a AS x, b AS y, w FROM e UNION ALL SELECT b, a, w FROM e), t AS (SELECT sum(w) AS m2 FROM m), r AS (SELECT p.label AS c, q.label AS d, w FROM m JOIN embeddings p ON p.vec_id = x JOIN embeddings q ON q.vec_id = y), s AS (SELECT c, sum(CASE WHEN c = d THEN w ELSE 0 END) AS i, sum(w) AS k FROM r GROUP BY 1) SELECT round(coalesce(sum(i / m2 - (k / m2) * (k / m2)), 0), 5) AS modularity FROM s, t")
def modularity(spark, sf):
    labels = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    return graph.modularity_of_vectors(unit_embeddings(spark, sf), labels, NEAR).select(F.round("modularity", 5).alias("modularity"))


@query()
def communities(spark, sf):
    nodes, edges = embedding_graph(spark, sf)
    return graph.communities(nodes, vectors.settled(edges))


# All shortest paths, from simple paths grown edge by edge; a node's share of those between two others.
BETWEEN = f"""WITH RECURSIVE {VECTORS}, {SIMILAR}, m AS (SELECT a AS x, b AS y FROM sim UNION SELECT b, a FROM sim), p AS (SELECT x AS s, y AS t, 1 AS d, [x, y] AS path FROM m UNION ALL SELECT s, y, d + 1, list_append(path, y) FROM p JOIN m ON p.t = m.x WHERE NOT list_contains(path, y)),
near AS (SELECT s, t, min(d) AS d FROM p GROUP BY 1, 2), sig AS (SELECT s, t, d, count(*) AS n FROM p JOIN near USING (s, t, d) GROUP BY ALL),
share AS (SELECT a.t AS node, sum(a.n * b.n / CAST(c.n AS DOUBLE)) AS x FROM sig a JOIN sig b ON a.t = b.s JOIN sig c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY 1), size AS (SELECT count(*) AS n FROM embeddings),
between AS (SELECT vec_id AS node, floor(round(coalesce(x, 0) / ((n - 1) * (n - 2)), 9) * 10000 + 0.5) / 10000.0 AS betweenness FROM embeddings LEFT JOIN share ON node = vec_id, size)"""


@query(BETWEEN + " SELECT * FROM between")
def betweenness(spark, sf):
    nodes, edges = embedding_graph(spark, sf)
    return graph.betweenness(nodes, vectors.settled(edges))


BRIDGES = "br AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY betweenness DESC, node) AS i, count(*) OVER () AS n FROM between WHERE betweenness > 0) WHERE i <= ceil(n / 10.0))"


@query(BETWEEN + f", {BRIDGES}, cs AS (SELECT label, count(*) AS community_size FROM embeddings GROUP BY 1), e AS (SELECT a, b, round(cosine, 9) AS s, CASE WHEN x.label = y.label THEN 'inner' ELSE 'outer' END AS type FROM sim JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b), n AS (SELECT a AS node, b AS other, 'out' AS direction, type, s FROM e UNION ALL SELECT b, a, 'in', type, s FROM e) SELECT node, other, direction, type, CAST(row_number() OVER (PARTITION BY node ORDER BY s DESC, other) AS INTEGER) AS place, round(s, 5) AS strength, 'c' || v.label AS community_label, community_size, node IN (SELECT node FROM br) AS is_bridge FROM n JOIN embeddings v ON v.vec_id = node JOIN cs ON cs.label = v.label QUALIFY place <= 10")
def graph_context(spark, sf):
    nodes, edges = embedding_graph(spark, sf)
    edges = vectors.settled(edges)
    labels = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"), F.concat(F.lit("c"), F.col("label")).alias("label"))
    side = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"{c}_of"))
    typed = edges.join(side("src"), "src").join(side("dst"), "dst").withColumn("type", F.when(F.col("src_of") == F.col("dst_of"), "inner").otherwise("outer"))
    bridge = graph.bridges(vectors.settled(graph.betweenness(nodes, edges)))
    return graph.context(typed, communities=labels, bridge=bridge).withColumn("strength", F.round("strength", 5))


@query()
def clusters(spark, sf):
    ids = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    merges = vectors.settled(vectors.dendrogram(unit_embeddings(spark, sf)))
    return vectors.cut(merges, ids, vectors.elbow(merges))


def session_matrix(spark, sf):
    """(session_id, feature, value); a session's texts are those of the conversation with its user's number."""
    calls, sessions, _ = parts(spark, sf)
    breakdown = overview.tool_breakdown(calls)
    rows = sessions.withColumns({"assistant_turns": F.col("turn_count"), "tool_turns": F.col("turn_count"), "subagent_count": F.lit(0)})
    talk = views.prompts(spark, sf).select(F.col("session_id").alias("conversation"), F.col("user_prompt").alias("text"))
    said = sessions.select("session_id", F.substring_index("session_id", "-", 1).cast("long").alias("conversation")).join(talk, "conversation").select("session_id", "text")
    terms = features.tfidf(features.term_counts(said, "session_id"), "session_id")
    return features.combined(terms, features.tool_vectors(breakdown), features.structure(rows, breakdown))


@query()
def svd_variance(spark, sf):
    """Latent dimensions of the sessions' terms, tools and structure, with their share of variance and heaviest features."""
    values = vectors.settled(session_matrix(spark, sf))
    _, dims, loadings = vectors.svd(values, values.select("session_id").distinct().count())
    return vectors.dimension_report(dims, loadings)


@query()
def svd_embeddings(spark, sf):
    """Each session's unit vector over the latent dimensions."""
    values = vectors.settled(session_matrix(spark, sf))
    embeddings, _, _ = vectors.svd(values, values.select("session_id").distinct().count())
    return embeddings


@query("WITH s AS (SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'Here it is.' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '--- ' || text ELSE text END AS said FROM documents), e AS (SELECT *, regexp_extract(said, '(?s)(?:^|\\n)(---.*)$', 1) AS found FROM s) SELECT doc_id, CASE WHEN starts_with(said, '---') OR found = '' THEN said ELSE found END AS document FROM e")
def strip_preamble(spark, sf):
    kind = F.length("text") % 3
    said = F.when(kind == 0, F.concat(F.lit("Here it is.\n---\n"), "text")).when(kind == 1, F.concat(F.lit("--- "), "text")).otherwise(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", T.strip_preamble(said).alias("document"))


def branch_links(spark, sf):
    calls, sessions, _ = parts(spark, sf)
    grams = vectors.settled(sequences.top_patterns(sequences.maximal(sequences.ngrams(calls, ORDER))))
    grams = vectors.settled(sequences.with_projects(calls, grams, ORDER))
    return sequences.topic_links(calls, grams, sessions.select(F.col("git_branch").alias("topic_id"), "session_id"), ORDER)


@query(SQL + f", {GRAMS}, {COVERED}, best AS (SELECT steps FROM maxi ORDER BY n DESC, length DESC, steps LIMIT 30) SELECT DISTINCT git_branch AS topic_id, array_to_string(e.steps, ' → ') AS sequence FROM every e JOIN best USING (steps) JOIN sess USING (session_id)")
def topic_sequences(spark, sf):
    return branch_links(spark, sf).select("topic_id", F.array_join("steps", sequences.ARROW).alias("sequence"))


LINKED = """best AS (SELECT * FROM maxi ORDER BY n DESC, length DESC, steps LIMIT 30), used AS (SELECT DISTINCT git_branch, sess.project, e.steps FROM every e JOIN best USING (steps) JOIN sess USING (session_id)),
ps AS (SELECT steps, list_sort(list(DISTINCT project)) AS projects FROM used GROUP BY steps),
linked AS (SELECT t.topic_id, b.steps, b.n, b.length, ps.projects, row_number() OVER (PARTITION BY t.topic_id ORDER BY b.n DESC, b.length DESC, b.steps) AS place FROM (SELECT DISTINCT git_branch AS topic_id, steps FROM used) t JOIN best b USING (steps) JOIN ps USING (steps))"""


@query(SQL + f""", {GRAMS}, {COVERED}, {LINKED}, one AS (SELECT * FROM linked WHERE place = 1 AND len(list_filter(steps, lambda s: starts_with(s, 'Bash:') AND s <> 'Bash:other')) > 0),
st AS (SELECT topic_id, n, projects, list_transform(steps, lambda s: {{'tool': string_split(s, ':')[1], 'category': CASE string_split(s, ':')[1] {TOOL_CASES} ELSE 'execute' END, 'target': nullif(regexp_replace(s, '^[^:]*:?', ''), '')}}) AS pattern FROM one)
SELECT topic_id, CAST(to_json({{'description': 'Seen ' || n || ' times in ' || len(projects) || ' project(s)', 'pattern': pattern, 'sessionCount': n, 'projects': projects}}) AS VARCHAR) AS hook FROM st""")
def hooks(spark, sf):
    return report.hooks(branch_links(spark, sf))


@query(SQL + f", {META}, {SCORES}, {GRAMS}, {COVERED}, {LINKED} SELECT topic_id, any_value(overall) AS overall, string_agg(array_to_string(steps, ' → '), '; ' ORDER BY place) AS sequences FROM scores LEFT JOIN linked USING (topic_id) GROUP BY topic_id")
def candidate_sequences(spark, sf):
    """The candidates with their patterns, the most frequent first."""
    return report.candidates(reusability(spark, sf), branch_links(spark, sf)).select("topic_id", "overall", F.array_join("sequences", "; ").alias("sequences"))


def drafted(spark, sf, links):
    """The skill documents, from tables of sessions, their tools and topics that are worked out once."""
    calls, sessions, _ = parts(spark, sf)
    sessions, breakdown = vectors.settled(sessions), vectors.settled(overview.tool_breakdown(calls))
    members = sessions.select(F.col("git_branch").alias("topic_id"), "session_id")
    meta = vectors.settled(topics.topic_meta(members, sessions))
    signature = topics.tool_signature(members, breakdown)
    said = views.prompts(spark, sf).select(F.concat(F.lit("b"), F.col("session_id") % 50).alias("topic_id"), "session_id", "turn_index", "user_prompt")
    words = topics.topic_keywords(topics.centroids(said.select("topic_id", "session_id").distinct(), features.tfidf(features.term_counts(said.withColumnRenamed("user_prompt", "text"), "session_id"), "session_id")))
    actions = meta.select("topic_id").join(topics.dominant_action(said.select("topic_id", F.col("user_prompt").alias("prompt"))), "topic_id", "left").fillna("work on", ["action"])
    roles = topics.dominant_role(members, sessions, breakdown)
    described = report.descriptions(meta, topics.suggested_prompt(actions, words, signature), signature, roles)
    examples = topics.first_by(said.withColumn("prompt", T.cut(F.col("user_prompt"), 150, "...")), ["topic_id"], F.col("session_id"), F.col("turn_index"), most=3)
    return report.skill_documents(meta, words, described, signature, examples.select("topic_id", "place", "prompt"), links, actions, roles)


@query()
def skill_documents(spark, sf):
    return drafted(spark, sf, branch_links(spark, sf))


@query(SQL + "SELECT session_id, project, created_at, n_calls FROM sess")
def session_index(spark, sf):
    return overview.session_index(parts(spark, sf)[1]).select("session_id", "project", "created_at", "n_calls")


@query(SQL + "SELECT session_id, string_agg(tool_name, ' ' ORDER BY ts, event_id) AS tools FROM calls GROUP BY 1")
def session_details(spark, sf):
    calls, sessions, _ = parts(spark, sf)
    nested = overview.session_details(sessions, calls)
    return nested.select("session_id", F.array_join(F.transform("calls", lambda c: c["tool_name"]), " ").alias("tools"))


@query(f"WITH {VECTORS}, {SIMILAR} SELECT vec_id AS node FROM embeddings WHERE vec_id NOT IN (SELECT a FROM sim UNION SELECT b FROM sim)")
def knowledge_silos(spark, sf):
    return graph.degree(*embedding_graph(spark, sf)).where("degree = 0").select("node")


@query(SQL + f", {META} SELECT topic_id, n_projects FROM meta WHERE n_projects > 1")
def cross_project_topics(spark, sf):
    return branch_meta(spark, sf).where("n_projects > 1").select("topic_id", "n_projects")


@query(EDGES + ", m AS (SELECT src AS node, dst AS other, strength FROM edges UNION ALL SELECT dst, src, strength FROM edges) SELECT node, other, strength, 'topic ' || other AS label FROM m")
def edge_neighbourhood(spark, sf):
    edges = project_edges(spark, sf).withColumn("type", F.lit("edge"))
    labels = parts(spark, sf)[2].select("topic_id").distinct().withColumn("label", F.concat(F.lit("topic "), "topic_id"))
    return graph.neighbourhood(edges, labels).select("node", "other", "strength", "label")


@query(f"WITH {CENTRES}, k AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term) AS place FROM centres WHERE weight > 0) SELECT topic_id, string_agg(term, ', ' ORDER BY place) || ' (' || topic_id || ')' AS label FROM k WHERE place <= 3 GROUP BY topic_id")
def topic_label(spark, sf):
    meta = source_members(spark, sf).select("topic_id").distinct().select("topic_id", F.col("topic_id").alias("project"), F.lit(1).alias("n_projects"))
    return topics.topic_label(source_keywords(spark, sf), meta)


PROMPTS = SQL + ", tok AS (" + tokens_sql("session_id", "user_prompt", "turns") + """), counts AS (SELECT session_id, term, count(*) AS n FROM tok GROUP BY ALL), nd AS (SELECT count(DISTINCT session_id) AS docs FROM counts), vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term), kept AS (SELECT term, ln(docs / CAST(df AS DOUBLE)) AS idf FROM vocab, nd WHERE df >= 2 AND df <= greatest(2, floor(docs * 0.8))),
w AS (SELECT session_id, term, ln(1 + n) * idf AS w FROM counts JOIN kept USING (term)), u AS (SELECT session_id, term, CASE WHEN l > 0 THEN w / l ELSE 0 END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY session_id)) AS l FROM w)),
mem AS (SELECT DISTINCT session_id % 10 AS topic_id, session_id FROM turns), sz AS (SELECT topic_id, count(*) AS size FROM mem GROUP BY 1), ce AS (SELECT topic_id, term, sum(weight) / any_value(size) AS c FROM mem JOIN u USING (session_id) JOIN sz USING (topic_id) GROUP BY ALL), nm AS (SELECT topic_id, sqrt(sum(c * c)) AS norm FROM ce GROUP BY 1),
sc AS (SELECT mem.topic_id, session_id, round(CASE WHEN any_value(norm) > 0 THEN sum(weight * c) / any_value(norm) END, 9) AS score FROM mem JOIN u USING (session_id) JOIN ce ON ce.topic_id = mem.topic_id AND ce.term = u.term JOIN nm ON nm.topic_id = mem.topic_id GROUP BY ALL),
said AS (SELECT topic_id, session_id, turn_index, score, CASE WHEN length(user_prompt) > 150 THEN left(user_prompt, 150) || '...' ELSE user_prompt END AS prompt FROM sc JOIN turns USING (session_id) WHERE length(user_prompt) > 10),
once AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY topic_id, prompt ORDER BY score DESC NULLS LAST, session_id, turn_index) = 1)"""


@query(PROMPTS + " SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, session_id, turn_index) AS INTEGER) AS place, prompt, round(score, 6) AS score FROM once QUALIFY place <= 3")
def topic_prompts(spark, sf):
    prompts = views.prompts(spark, sf)
    weights = features.tfidf(features.term_counts(prompts.withColumnRenamed("user_prompt", "text"), "session_id"), "session_id")
    members = prompts.select((F.col("session_id") % 10).alias("topic_id"), "session_id").distinct()
    return topics.topic_prompts(members, weights, prompts).withColumn("score", F.round("score", 6))


@query()
def prompt_set(spark, sf):
    """What a batch job over a language model gets: the drafted documents with their neighbours in the branch graph."""
    links = vectors.settled(branch_links(spark, sf))
    documents = vectors.settled(drafted(spark, sf, links))
    near = session_overlap(spark, sf).select("src", "dst", F.col("overlap").alias("strength"))
    nodes, near = vectors.settled(documents.select(F.col("topic_id").alias("node"))), vectors.settled(near)
    central = graph.degree(nodes, near).join(graph.betweenness(nodes, near), "node").select(F.col("node").alias("topic_id"), "betweenness", F.col("centrality").alias("degree"))
    return report.prompt_set(documents, graph.context(near), documents.select("topic_id", F.col("skill_name").alias("label")), links=links, central=central)


@query(BETWEEN + f", {BRIDGES} SELECT node, betweenness FROM between WHERE node IN (SELECT node FROM br)")
def bridge_nodes(spark, sf):
    nodes, edges = embedding_graph(spark, sf)
    return graph.bridges(vectors.settled(graph.betweenness(nodes, vectors.settled(edges))))


@query(BETWEEN + ", d AS (SELECT vec_id AS node, count(m.x) AS n FROM embeddings LEFT JOIN m ON x = vec_id GROUP BY 1), c AS (SELECT node, floor(d.n / CAST(size.n - 1 AS DOUBLE) * 10000 + 0.5) / 10000.0 AS degree FROM d, size) SELECT node, CASE WHEN betweenness > 0.2 THEN 'critical bridge' WHEN betweenness > 0.05 THEN 'bridge' WHEN degree > 0.5 THEN 'hub' WHEN degree = 0 THEN 'isolated' ELSE 'peripheral' END AS band FROM c JOIN between USING (node)")
def centrality_band(spark, sf):
    """Bands by an embedding's betweenness and degree."""
    nodes, edges = embedding_graph(spark, sf)
    edges = vectors.settled(edges)
    central = graph.degree(nodes, edges).join(graph.betweenness(nodes, edges), "node")
    return central.select("node", C.centrality_band(F.col("betweenness"), F.col("centrality")).alias("band"))


@query(f"WITH {VECTORS}, {SIMILAR}, seen AS (SELECT vec_id, label FROM embeddings WHERE label < 4) SELECT a AS src, b AS dst, CASE WHEN x.label = y.label THEN 'inner' ELSE 'outer' END AS type FROM sim JOIN seen x ON x.vec_id = a JOIN seen y ON y.vec_id = b WHERE x.label <> y.label")
def visible_edges(spark, sf):
    """Edges between different labels among those of the communities 0 to 3."""
    nodes, edges = embedding_graph(spark, sf)
    labels = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    side = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"{c}_of"))
    typed = edges.join(side("src"), "src").join(side("dst"), "dst").withColumn("type", F.when(F.col("src_of") == F.col("dst_of"), "inner").otherwise("outer"))
    return graph.subgraph(labels, typed, [0, 1, 2, 3], ["outer"])[1].select("src", "dst", "type")


@query(SQL + f", {META} SELECT topic_id AS node, project AS community, session_count, greatest(2, 2 * session_count) AS val FROM meta JOIN main USING (topic_id) WHERE project IN ('org/p0', 'org/p1', 'org/p2', 'org/p3')")
def visible_topics(spark, sf):
    """Branches as topics of the first four projects, with the size they are drawn at."""
    labels = branch_meta(spark, sf).select(F.col("topic_id").alias("node"), F.col("project").alias("community"), "session_count")
    edges = session_overlap(spark, sf).withColumn("type", F.lit("workflow-continuation"))
    return graph.subgraph(labels, edges, [f"org/p{i}" for i in range(4)])[0]


@query(f"WITH {CENTRES}, k AS (SELECT topic_id, term, weight FROM centres WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term) <= 5), c AS (SELECT DISTINCT source AS topic_id, length(source) AS community FROM documents), cs AS (SELECT community, term, sum(round(weight, 9)) AS x FROM k JOIN c USING (topic_id) GROUP BY community, term), cw AS (SELECT community, term, row_number() OVER (PARTITION BY community ORDER BY x DESC, term) AS place FROM cs) SELECT community, size, label, project FROM (SELECT community, count(*) AS size, min(topic_id) AS project FROM c GROUP BY 1) JOIN (SELECT community, string_agg(term, ', ' ORDER BY place) AS label FROM cw WHERE place <= 3 GROUP BY 1) USING (community)")
def community_table(spark, sf):
    """Sources as topics, with the length of their names as community."""
    sources = source_members(spark, sf).select("topic_id").distinct()
    labels = sources.select(F.col("topic_id").alias("node"), F.length("topic_id").alias("community"))
    return graph.community_table(labels, source_keywords(spark, sf), sources.select("topic_id", F.col("topic_id").alias("project")))


@query(SQL + "SELECT event_id, CASE tool_name WHEN 'Bash' THEN 'command=' || cmd WHEN 'Agent' THEN 'subagent_type=Explore' ELSE 'file_path=' || path END AS inputs FROM calls")
def input_scalars(spark, sf):
    return views.calls(spark, sf).select("event_id", F.array_join(F.transform(T.scalar_inputs(F.col("input")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ", ").alias("inputs"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS day, strftime(ts, '%b %d, %Y, %I:%M %p') AS moment, strftime(ts, '%H:%M:%S') AS clock FROM events")
def date_texts(spark, sf):
    return views.table(spark, sf, "events").select("event_id", T.date_text(F.col("ts")).alias("day"), T.date_time_text(F.col("ts")).alias("moment"), T.time_text(F.col("ts")).alias("clock"))


@query()
def elbow(spark, sf):
    """The cluster tree's merges and whether the elbow keeps them."""
    merges = vectors.settled(vectors.dendrogram(unit_embeddings(spark, sf)))
    return merges.withColumn("kept", F.col("height") <= vectors.elbow(merges))


@query()
def merged_clusters(spark, sf):
    """Clusters after the split of large ones and the merge of narrow ones that share a label."""
    rows = views.table(spark, sf, "embeddings")
    near = vectors.settled(unit_embeddings(spark, sf))
    split = vectors.split_oversized(vectors.settled(clusters(spark, sf)), near)
    return vectors.merge_narrow(vectors.settled(split), near, rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category")))


@query(SQL + "SELECT project, count(*) AS n_sessions FROM sess GROUP BY project")
def project_index(spark, sf):
    return overview.project_index(parts(spark, sf)[1])


@query(SQL + f", {EDITED} SELECT session_id, array_to_string(list_sort(list(file_path)), ' ') AS files, CAST(count(*) AS INTEGER) AS n_files FROM files GROUP BY session_id")
def session_files(spark, sf):
    found = overview.session_files(overview.files_edited(parts(spark, sf)[0]))
    return found.select("session_id", F.array_join("files", " ").alias("files"), "n_files")


OF_USERS = "c AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS turn_index FROM calls), k AS (SELECT user_id AS session_id, turn_index, list_sort(list(DISTINCT tool_name)) AS names, count(*) AS n_calls FROM c GROUP BY ALL)"


@query(SQL + f", {OF_USERS} SELECT t.session_id, t.turn_index, t.turn_index + 1 AS number, CASE WHEN list_contains(names, 'Agent') THEN 'agent' ELSE 'standard' END AS kind, coalesce(array_to_string(names, ', '), '') AS tools, coalesce(n_calls, 0) AS n_calls, CASE WHEN length(user_prompt) > 80 THEN left(user_prompt, 80) || '...' ELSE user_prompt END AS prompt FROM turns t LEFT JOIN k USING (session_id, turn_index)")
def turn_list(spark, sf):
    """The turns of conversations with their prompts, and the calls that the user of that number makes in them."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    calls = views.calls(spark, sf).select(F.col("user_id").alias("session_id"), "tool_name", F.floor((nth - 1) / 3).alias("turn_index"))
    return overview.turn_summary(calls, views.prompts(spark, sf))


@query(SQL + f", {BREAKDOWN} SELECT session_id, project, n_calls, (SELECT string_agg(tool_name || '=' || b.n_calls, ' ' ORDER BY tool_name) FROM breakdown b WHERE b.session_id = sess.session_id) AS tools FROM sess")
def written_details(spark, sf):
    """Nested session documents, written by bucket under a manifest and read back."""
    calls, sessions, _ = parts(spark, sf)
    tools = overview.tool_breakdown(calls).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tool_name", "n_calls"))).alias("tools"))
    root = f"{shared_dir(spark)}/output-{uuid.uuid4().hex}"
    output.write(spark, root, "run", sessions.join(tools, "session_id"), {"projects": overview.project_index(sessions)})
    named = F.transform("tools", lambda t: F.concat(t["tool_name"], F.lit("="), t["n_calls"]))
    return output.read_details(spark, root).select("session_id", "project", "n_calls", F.array_join(named, " ").alias("tools"))


def joined(spark, sf):
    """The joined job's inputs: events are calls, and a user's conversation is what the user's sessions say."""
    calls, sessions, _ = parts(spark, sf)
    talk = views.prompts(spark, sf).withColumnRenamed("session_id", "conversation")
    turns = sessions.select("session_id", F.substring_index("session_id", "-", 1).cast("long").alias("conversation")).join(talk, "conversation").drop("conversation")
    return sessions, overview.tool_breakdown(calls), turns, overview.files_edited(calls)


@query()
def knowledge_topics(spark, sf):
    """The joined job from sessions to described topics."""
    return knowledge.build(*joined(spark, sf), as_of=AS_OF, betweenness=False).topics
