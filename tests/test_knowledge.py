import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import knowledge, report, topics


def tables(spark, n):
    rows = [(f"s{i}", "org/a" if i % 2 else "org/b", "main", f"2024-01-0{1 + i} 10:00:00", f"2024-01-0{1 + i} 11:00:00", 60, 3, 2) for i in range(n)]
    sessions = spark.createDataFrame(rows, "session_id string, project string, git_branch string, created_at string, last_active_at string, duration_minutes long, n_calls long, turn_count long")
    sessions = sessions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_active_at")})
    calls = spark.createDataFrame([(f"s{i}", t, k) for i in range(n) for t, k in ((("Read", 2), ("Edit", 1)) if i % 2 else (("Bash", 3),))], "session_id string, tool_name string, n_calls long")
    said = spark.createDataFrame([(f"s{i}", 0, "please refactor the parser module" if i % 2 else "deploy the server with docker") for i in range(n)], "session_id string, turn_index long, user_prompt string")
    files = spark.createDataFrame([(f"s{i}", f"/src/p{i % 2}/f.ts") for i in range(n)], "session_id string, file_path string")
    return sessions, calls, said, files


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_sessions_are_topics_of_their_own(spark, n):
    found = knowledge.build(*tables(spark, n), communities=n > 1, betweenness=n > 1)
    assert sorted(r.topic_id for r in found.topics.collect()) == [f"topic-00{i + 1}" for i in range(n)]
    assert {r.topic_id: r.session_id for r in found.members.collect()} == {f"topic-00{i + 1}": f"s{i}" for i in range(n)}
    assert found.centrality.count() == n and found.communities.count() == n


def test_seven_sessions_of_two_kinds(spark):
    found = knowledge.build(*tables(spark, 7), communities=False, betweenness=False)
    groups = {}
    for r in found.members.collect():
        groups.setdefault(r.topic_id, set()).add(r.session_id)
    assert sorted(map(sorted, groups.values())) == [["s0", "s2", "s4", "s6"], ["s1", "s3", "s5"]]
    rows = {r.topic_id: r for r in found.topics.collect()}
    assert [rows[t].session_count for t in ("topic-001", "topic-002")] == [4, 3] and "refactor" in rows["topic-002"].keywords
    assert {r.betweenness for r in found.centrality.collect()} == {0.0}


def test_edge_labels(spark):
    edges = spark.createDataFrame([("a", "b", "shared-module"), ("a", "c", "cross-project-bridge"), ("b", "c", "workflow-continuation"), ("a", "d", "semantic-similarity")], "src string, dst string, type string")
    shared = spark.createDataFrame([("a", "c", 1, "parser"), ("a", "c", 2, "server")], "src string, dst string, place int, term string")
    files = spark.createDataFrame([("a", "b", ["/src/x/f.ts", "/src/x/g.ts"])], "src string, dst string, file_paths array<string>")
    got = {(r.src, r.dst): r.label for r in topics.edge_label(edges, shared, files).collect()}
    assert got == {("a", "b"): "shared: /src/x", ("a", "c"): "cross-project: parser, server", ("b", "c"): "workflow continuation", ("a", "d"): "related: similar topics"}


def test_scalar_inputs(spark):
    rows = [('{"a":1,"b":null,"c":{"x":1},"d":[1],"e":"t","f":true,"g":2,"h":3,"i":4}',), ("not json",), (None,), ("{}",)]
    got = [[(p["key"], p["value"]) for p in r.p] for r in spark.createDataFrame(rows, "raw string").select(T.scalar_inputs(F.col("raw")).alias("p")).collect()]
    assert got == [[("a", "1"), ("e", "t"), ("f", "true"), ("g", "2"), ("h", "3")], [], [], []]


def test_a_document_has_its_sections_and_the_prompt_its_context(spark):
    meta = spark.createDataFrame([("t", 3, 125, 40, 1, "org/app")], "topic_id string, session_count long, total_duration_minutes long, total_tool_calls long, n_projects long, project string")
    words = spark.createDataFrame([("t", 1, "parser"), ("t", 2, "token")], "topic_id string, place int, term string")
    tools = spark.createDataFrame([("t", 1, "Edit", 0.5)], "topic_id string, place int, tool_name string, weight double")
    actions, roles = spark.createDataFrame([("t", "fix")], "topic_id string, action string"), spark.createDataFrame([("t", "tool-heavy")], "topic_id string, role string")
    links = spark.createDataFrame([("t", ["Read", "Edit"], 1, 9), ("t", ["A", "B"], 2, 3)], "topic_id string, steps array<string>, place int, n long")
    said = spark.createDataFrame([("t", 1, "fix  the\nparser")], "topic_id string, place int, prompt string")
    described = report.descriptions(meta, topics.suggested_prompt(actions, words, tools), tools, roles)
    documents = report.skill_documents(meta, words, described, tools, said, links, actions, roles)
    text = documents.first()
    assert text.skill_name == "parser-token-app" and text.markdown.startswith("---\nname: parser-token-app\ndescription: fix parser/token; ")
    at = [text.markdown.index(f"## {x}\n") for x in ("Overview", "When to Use", "Workflow", "Tools", "Example Prompts", "Guidelines")]
    assert at == sorted(at) and "1. Read → Edit (9 times)\n2. A → B (3 times)" in text.markdown and "> fix the parser" in text.markdown and "2h 5m" in text.markdown
    near = spark.createDataFrame([("t", 1, "u", "out", 0.5)], "node string, place int, other string, direction string, strength double")
    central = spark.createDataFrame([("t", 0.3, 0.1)], "topic_id string, betweenness double, degree double")
    rollup = spark.createDataFrame([("t", 0.5, 1.0, ["g"], ["slow"])], "topic_id string, success_rate double, helpfulness double, goals array<string>, frictions array<string>")
    prompt = report.prompt_set(documents, near, spark.createDataFrame([("u", "other")], "topic_id string, label string"), rollup, links, central).first().prompt
    for part in ("- other (out, 0.5)", "- Read → Edit (9 times)", "critical bridge", "Success rate 0.50, helpfulness 1.00. Goals: g. Frictions: slow."):
        assert part in prompt, part
