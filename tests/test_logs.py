import json
from pathlib import Path

import pytest

from loomline.operators import turns as T
from loomline.sources import logs


def line(kind, content=None, **more):
    row = {"type": kind, **more}
    if content is not None:
        row["message"] = {"role": kind, "content": content, **({"model": more.pop("model")} if "model" in more else {})}
        row.pop("model", None)
    return json.dumps(row)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    project = top / "-Users-foo-github-com-org-repo"
    (project / "s1" / "subagents").mkdir(parents=True)
    (project / "orphan" / "subagents").mkdir(parents=True)
    use = lambda i, name, **inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    s1 = [
        line("progress", timestamp="2020-01-01T00:00:00Z"),
        line("assistant", [{"type": "text", "text": "too early"}], timestamp="2024-01-01T10:00:00Z"),
        line("user", "[not an array", timestamp="2024-01-01T10:01:00Z", cwd="/home/me/org/repo", gitBranch="main", slug="plan-1"),
        line("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, use("t1", "Read", file_path="/a.ts"), use("t1", "Read", file_path="/b.ts")], model="sonnet"),
        line("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "first"}]),
        line("user", [{"type": "tool_result", "tool_use_id": "t1", "content": {"k": 1}}]),
        "{malformed",
        "",
        line("user", "<command-name>x</command-name>"),
        line("user", "meta", isMeta=True),
        line("user", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], cwd="/elsewhere"),
        line("assistant", "plain string"),
        line("assistant", [use("w", "Write", file_path="/src/b.ts", content="x" * 1000), use("e", "Edit", file_path="/src/a.ts"), {"type": "tool_use", "id": "n"}], model="opus"),
        line("user", [{"type": "tool_result", "tool_use_id": "w"}, {"type": "tool_result", "tool_use_id": "t1", "content": "late"}], timestamp="2024-01-01T10:45:00Z"),
        line("system", timestamp="2024-01-01T10:46:00Z"),
    ]
    (project / "s1.jsonl").write_text("\r\n".join(s1))
    (project / "s1" / "subagents" / "agent-a7.jsonl").write_text(line("user", "sub task") + "\n" + line("assistant", [use("z", "Bash", command="ls")], model="haiku"))
    (project / "s1" / "subagents" / "agent-a7.meta.json").write_text('{"agentType": "Explore"}')
    (project / "orphan" / "subagents" / "agent-b.jsonl").write_text(line("user", "lost"))
    (project / "s2.jsonl").write_text('{"type":"queue-operation"}\n' + line("user", "hi"))
    return str(top)


def test_files_and_lines(spark, root):
    found = logs.discover(spark, root)
    assert sorted((r.session_id, r.agent_id) for r in found.collect() if r.agent_id) == [("s1", "a7")]
    assert {r.session_id for r in logs.interactive(logs.scan(spark, root), found).collect()} == {"s1"}
    rows = logs.read_lines(spark, root).where("agent_id IS NULL").collect()
    assert len(rows) == 12 and min(r.line_no for r in rows) == 1
    assert logs.agent_types(spark, root).collect()[0].agent_type == "Explore"


def test_turns(spark, root):
    rows = {(r.agent_id, r.turn_index): r for r in T.turns(logs.read_lines(spark, root)).collect()}
    assert sorted(rows, key=str) == sorted([(None, 0), (None, 1), ("a7", 0)], key=str)
    first, second = rows[None, 0], rows[None, 1]
    assert (first.user_prompt, first.thinking, first.texts, first.model) == ("[not an array", ["hm"], ["yes"], "sonnet")
    assert (second.user_prompt, second.texts, second.model) == ("a\nb", [], "opus")


def test_tool_calls(spark, root):
    rows = {(r.agent_id, r.turn_index, r.call_pos): r for r in T.tool_calls(logs.read_lines(spark, root)).collect()}
    assert len(rows) == 6
    assert rows[None, 0, 0].result == '{"k":1}' and rows[None, 0, 1].result is None
    write = rows[None, 1, 0]
    assert write.result == '""' and write.content_length == 1000 and len(json.loads(write.input)["content"]) == 501
    assert rows[None, 1, 2].tool_name == "unknown" and rows["a7", 0, 0].tool_name == "Bash"


def test_session_meta(spark, root):
    lines = logs.read_lines(spark, root)
    row = T.session_meta(lines).collect()[0]
    assert (row.cwd, row.gitBranch, row.slug, row.permissionMode) == ("/home/me/org/repo", "main", "plan-1", None)
    assert (row.created_at, row.last_active_at, row.duration_minutes) == ("2024-01-01T10:00:00Z", "2024-01-01T10:46:00Z", 46)
    assert {(r.model, r.n_lines) for r in T.models_used(lines).collect()} == {("sonnet", 1), ("opus", 1)}
    assert T.first_prompts(T.turns(lines)).collect()[0].first_prompt == "[not an array"


def whole_lines(path):
    """Places and texts of a file's lines by reading it whole."""
    text = Path(path).read_bytes().decode()
    return {(i, t.removesuffix("\r")) for i, t in enumerate(text.split("\n")) if t.strip()}


@pytest.mark.parametrize("size", ["1k", "137b", "128m"])
def test_split_files_have_the_same_lines_and_numbers(spark, tmp_path, size):
    """A file many times as long as a split, with both line ends, blank and malformed lines, some across a border."""
    (tmp_path / "p").mkdir()
    rows = [line("user", f"prompt {i} " + "é" * (i * 7 % 90)) if i % 5 else ["", "{malformed " + "x" * 60, "   "][i % 3] for i in range(300)]
    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        (tmp_path / "p" / f"{name}.jsonl").write_bytes((end.join(rows) + end).encode())
    (tmp_path / "p" / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        run = logs.Run()
        scanned = logs.scan(spark, str(tmp_path), run.lines)
        if size != "128m":
            assert scanned.select("file_path", "block").distinct().count() > 20
        got = logs.numbered(scanned).where("trim(raw) <> ''").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("unix", "dos"):
        assert {(r.line_no, r.raw) for r in got if r.session_id == name} == {(i, t) for i, t in whole_lines(tmp_path / "p" / f"{name}.jsonl")}
    assert run.lines.get == {"lines": len(got), "malformed": sum("malformed" in r.raw for r in got)}


def test_the_head_of_a_file_counts_bytes(spark, tmp_path):
    (tmp_path / "p").mkdir()
    mark = '{"type":"queue-operation"}'
    for name, pad in (("in", 4096 - 1 - 25), ("out", 4096 - 25), ("wide", 2040)):
        (tmp_path / "p" / f"{name}.jsonl").write_text(("é" if name == "wide" else "x") * pad + "\n" + mark)
    (tmp_path / "p" / "many.jsonl").write_text("\n" * 4000 + mark)
    (tmp_path / "p" / "more.jsonl").write_text("\n" * 5000 + mark)
    got = logs.driven(logs.scan(spark, str(tmp_path))).collect()
    assert {r.session_id for r in got} == {"in", "many"}


def test_run_counters(spark, root):
    run = logs.Run()
    rows = logs.read_lines(spark, root, run=run).count()
    got = run.summary(spark).first()
    size = sum(p.stat().st_size for p in Path(root).rglob("*.jsonl"))
    assert (got.found, got.skipped, got.parsed, got.malformed, got.bytes, got.written) == (2, 1, 1, 1, size, None)
    assert got.lines == 19 and rows == 14


def test_plans_and_facets(spark, tmp_path):
    (tmp_path / "plan-1.md").write_text("# do\nthis")
    assert [tuple(r) for r in logs.plans(spark, str(tmp_path)).collect()] == [("plan-1", "# do\nthis")]
    meta = spark.createDataFrame([("s1", "plan-1"), ("s2", "none"), ("s3", None)], "session_id string, slug string")
    got = {r.session_id: r.plan for r in T.linked_plans(meta, logs.plans(spark, str(tmp_path))).collect()}
    assert got == {"s1": "# do\nthis", "s2": None, "s3": None}
    for name, text in (("a.json", '{"session_id": "s1", "outcome": "old"}'), ("b.json", '{"session_id": "s1",\n "outcome": "new", "goal_categories": {"fix": 2}}'), ("c.json", '{"outcome": "x"}'), ("d.json", "not json"), ("e.json", '{"session_id": ""}')):
        (tmp_path / name).write_text(text)
    rows = logs.facets(spark, str(tmp_path)).collect()
    assert [(r.session_id, r.outcome, r.goal_categories) for r in rows] == [("s1", "new", {"fix": 2})]
