"""The output job: written, read back, written again; the whole job over a folder of logs."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import output
from loomline.plans import job
from tests.test_logs import root  # noqa: F401  the folder of logs


def documents(spark, ids, mark="a"):
    return spark.createDataFrame([(f"s{i}", mark, [(i, "x")]) for i in ids], "session_id string, mark string, calls array<struct<n:int,t:string>>")


def test_a_second_run_leaves_no_stale_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    assert output.manifest(spark, out) is None
    with pytest.raises(FileNotFoundError):
        output.read_details(spark, out)
    output.write(spark, out, "one", documents(spark, range(40)), {"t": spark.range(3)}, buckets=8)
    assert sorted(map(tuple, output.read_details(spark, out).collect())) == sorted(map(tuple, documents(spark, range(40)).collect()))
    assert output.read_table(spark, out, "t").count() == 3
    output.write(spark, out, "two", documents(spark, [1, 2], "b"), {"t": spark.range(0)}, buckets=8)
    assert {(r.session_id, r.mark) for r in output.read_details(spark, out).collect()} == {("s1", "b"), ("s2", "b")}
    assert output.read_table(spark, out, "t").count() == 0
    output.write(spark, out, "two", documents(spark, [5], "c"), {}, buckets=8)  # repeated under its name
    assert {(r.session_id, r.mark) for r in output.read_details(spark, out).collect()} == {("s5", "c")}
    assert output.clear(spark, out) == ["one"] and output.read_details(spark, out).count() == 1
    output.write(spark, out, "none", documents(spark, []), {}, buckets=8)
    assert output.read_details(spark, out).count() == 0


def test_a_run_over_some_sessions_rewrites_their_buckets(spark, tmp_path):
    out = str(tmp_path)
    output.write(spark, out, "one", documents(spark, range(60)), {"t": spark.range(3)}, buckets=16)
    gone = spark.createDataFrame([("s7",), ("s8",)], "session_id string")
    now = documents(spark, [i for i in range(60) if i != 7], "b")
    found = output.write(spark, out, "two", now, {}, buckets=16, only=gone)
    rows = {r.session_id: r.mark for r in output.read_details(spark, out).collect()}
    assert set(rows) == {f"s{i}" for i in range(60) if i != 7} and rows["s8"] == "b" and "a" in rows.values()
    assert len({p.split("/")[0] for p in found["details"].values()}) == 2 and output.read_table(spark, out, "t").count() == 3
    assert output.clear(spark, out) == []
    with pytest.raises(ValueError):
        output.write(spark, out, "three", now, {}, buckets=4, only=gone)


def test_readers_see_the_set_before_until_the_manifest_is_there(spark, tmp_path):
    out = str(tmp_path)
    output.write(spark, out, "one", documents(spark, [1]), {"t": spark.range(1)})
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        output.write(spark, out, "two", documents(spark, [2]), {"t": broken})
    assert [r.session_id for r in output.read_details(spark, out).collect()] == ["s1"]


def test_the_whole_job(spark, root, tmp_path):  # noqa: F811
    plans = spark.createDataFrame([("plan-1", "# a plan")], "slug string, plan string")
    facets = spark.createDataFrame([("s1", "see to a file", {"fix_bug": 1}, "fully_achieved", "essential", None, None, "in brief")], "session_id string, underlying_goal string, goal_categories map<string,int>, outcome string, claude_helpfulness string, friction_counts map<string,int>, friction_detail string, brief_summary string")
    got = job.analyze(spark, root, str(tmp_path), "run-1", "2024-02-01", facets, plans, buckets=4).first()
    assert (got.found, got.skipped, got.parsed, got.malformed, got.written) == (2, 1, 1, 1, 1)
    row = output.read_details(spark, str(tmp_path)).first()
    assert (row.session_id, row.project, row.plan, row.first_prompt, row.turn_count, row.subagent_count) == ("s1", "org/repo", "# a plan", "in brief", 2, 1)
    assert [len(t.calls or []) for t in row.turns] == [2, 3] and row.turns[0].calls[0].result == '{"k":1}'
    assert [(a.agent_id, a.turns[0].calls[0].tool_name) for a in row.subagents] == [("a7", "Bash")]
    table = lambda name: output.read_table(spark, str(tmp_path), name).collect()
    assert [(r.project, r.n_sessions) for r in table("projects")] == [("org/repo", 1)]
    assert [(r.n_sessions, r.n_calls, r.minutes) for r in table("cards")] == [(1, 5, 46)]
    assert [(r.session_id, r.files) for r in table("session_files")] == [("s1", ["/src/a.ts", "/src/b.ts"])]
    assert sorted((r.turn_index, r.kind, r.prompt) for r in table("turn_summary")) == [(0, "standard", "[not an array"), (1, "standard", "a\nb")]
    topic = table("topics")[0]
    assert topic.topic_id == "topic-001" and topic.label.startswith("see to a file") and topic.session_count == 1 and topic.signature[0].tool
    assert json.loads((tmp_path / "_manifests" / "00000000.json").read_text())["run"] == "run-1"
