import pytest
from pyspark.sql import functions as F

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators import features, report


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("fooBar XMLParser", ["foo", "bar", "xml", "parser"]),
        ("see /src/components/UserList.tsx now", ["src", "components", "user", "list", "src", "components", "user", "listtsx"]),
        ("a.ts kebab-case snake_case", ["ats", "kebab", "case", "snake", "case"]),
        ("the deadbeef 12345 http://x.y é été cafés", ["cafs"]),
        ("550e8400-e29b-41d4-a716-446655440000", []),
        ("データ処理 テスト", ["データ処理", "テスト"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    assert sorted(r.term for r in features.terms(rows, ["id"]).collect()) == sorted(want)


def test_counts_need_no_shuffle_where_no_key_repeats(spark):
    texts = spark.createDataFrame([(1, "parser ends\u0085 parser"), (2, "/src/parser.ts Parser"), (None, None)], "id long, text string")
    own = features.term_counts(texts, "id", look=True)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    want = [(1, "ends", 1), (1, "parser", 2), (2, "parser", 2), (2, "parserts", 1), (2, "src", 2)]
    assert sorted(map(tuple, own.collect())) == want
    both = features.term_counts(texts.unionByName(texts), "id", look=True)
    assert sorted(map(tuple, both.collect())) == [(i, term, 2 * n) for i, term, n in want]


def test_session_documents_and_summaries(spark):
    turns = spark.createDataFrame([("s", 0, "fix the parser", ["parser looks fine"], False), ("s", 1, "fix parser tests", [], False), ("e", 0, " ", [], None), ("p", 0, "look around", [], False), ("p", 1, "plan the parser", ["done"], True)], "session_id string, turn_index long, user_prompt string, texts array<string>, is_plan boolean")
    files = spark.createDataFrame([("s", "/src/parser/a.ts"), ("s", "/src/parser/b.ts")], "session_id string, file_path string")
    branches = spark.createDataFrame([("s", "feature-login"), ("e", ""), ("p", None)], "session_id string, git_branch string")
    counts = {(r.session_id, r.term): r.n for r in features.term_counts(features.session_texts(turns, files, branches), "session_id").collect()}
    # Prompts, the assistant's text, and each path both as path and as text.
    assert counts["s", "parser"] == 3 + 2 + 2 and counts["s", "login"] == 1 and counts["s", "tests"] == 1
    assert not [k for k in counts if k[0] == "e"]
    sessions = spark.createDataFrame([("s", "default", 2), ("e", "plan", 1), ("p", "default", 2)], "session_id string, permission_mode string, turn_count long")
    breakdown = spark.createDataFrame([("s", "Edit", 5), ("s", "Read", 1)], "session_id string, tool_name string, n_calls long")
    got = {r.session_id: r for r in features.summaries(sessions, breakdown, turns, files).collect()}
    assert got["s"].scope == "/src/parser" and got["s"].keywords == ["parser", "tests"] and got["s"].prompt == "fix the parser"
    assert got["e"].keywords is None and got["e"].scope is None and got["p"].keywords == ["parser", "plan"]


def test_skill_files_and_dry_run(spark, tmp_path):
    documents = spark.createDataFrame([("t1", "fix-parser", "---\nname: fix-parser\n---\nbody"), ("t2", "deploy", "one line")], "topic_id string, skill_name string, markdown string")
    report.write_skills(documents, str(tmp_path / "skills"))
    texts = {p.name.removeprefix("skill_name="): "".join(f.read_text() for f in p.glob("*.txt")) for p in (tmp_path / "skills").iterdir() if p.is_dir()}
    assert texts == {"fix-parser": "---\nname: fix-parser\n---\nbody\n", "deploy": "one line\n"}
    scores = spark.createDataFrame([("t1", 0.4), ("t2", 0.9), ("t3", 0.4)], "topic_id string, overall double")
    labels = spark.createDataFrame([(f"t{i}", f"label {i}") for i in (1, 2, 3)], "topic_id string, label string")
    words = spark.createDataFrame([("t2", 2, "b"), ("t2", 1, "a"), ("t1", 1, "c")], "topic_id string, place int, term string")
    meta = spark.createDataFrame([(f"t{i}", i) for i in (1, 2, 3)], "topic_id string, session_count long")
    rows = [tuple(r) for r in report.dry_run(scores, labels, words, meta, n=2).collect()]
    assert sorted(rows) == [("t1", 0.4, "label 1", "c", 1), ("t2", 0.9, "label 2", "a, b", 2)]
    assert report.top(scores, 0).count() == 1


@pytest.mark.parametrize(("name", "want"), [("-Users-foo-github-com-org-repo", "org/repo"), ("-Users-foo-bar-projects-myapp", "projects/myapp"), ("short", "short"), ("", "")])
def test_project_names(spark, name, want):
    assert one(spark, T.project_of_directory(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    ("paths", "want", "edge"),
    [([], "", ""), (["/a/b/c.ts"], "/a/b", "/a/b/c.ts"), (["/a/b/c.ts", "/a/b/d.ts"], "/a/b", "/a/b"), (["/a/x", "/b/y"], "", ""), (["x.ts", "x.ts/y"], "", ""), (["a/b", "a/b/c"], "a/b", "a/b")],
)
def test_common_prefix(spark, paths, want, edge):
    rows = spark.createDataFrame([(paths,)], "p array<string>")
    assert rows.select(T.common_prefix(F.col("p"))).first()[0] == want
    assert rows.select(T.common_prefix(F.col("p"), directories=False)).first()[0] == edge


def test_small_functions(spark):
    assert one(spark, T.cut(F.col("t"), 3), t="abcd") == "abc…" and one(spark, T.cut(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, T.duration_text(F.col("m")), m=65) == "1h 5m" and one(spark, T.duration_text(F.col("m")), m=59) == "59m"
    assert one(spark, T.strip_preamble(F.col("t")), t="Sure!\n---\nname: x") == "---\nname: x" and one(spark, T.strip_preamble(F.col("t")), t="no") == "no"
    assert one(spark, T.skill_name(F.array(F.lit("Data!"), F.lit("base"), F.lit("x"), F.lit("y")), F.col("p")), p="org/My-App") == "data-base-x-myapp"
    assert one(spark, T.project_of_cwd(F.col("c")), c="/home/me/org/repo") == "org/repo" and one(spark, T.project_of_cwd(F.col("c")), c="/x") is None
    assert one(spark, T.half_up(F.col("v"), 2), v=0.125) == 0.13


@pytest.mark.parametrize(
    ("command", "want"),
    [("git push", "git"), ("npm test", "npm"), ("pytest -q", "test"), ("tsc", "build"), ("eslint .", "lint"), ("docker ps", "container"), ("curl x", "http"), ("mkdir a", "filesystem"), ("cat a", "read"), ("ls", "other")],
)
def test_shell_class(spark, command, want):
    assert one(spark, C.shell_class(F.col("c")), c=command) == want


@pytest.mark.parametrize(
    ("args", "want"),
    [((0, 0, 0, 0, "default", 9), "planning"), ((4, 4, 0, 0, "plan", 2), "planning"), ((10, 7, 0, 0, "default", 9), "investigation"), ((10, 2, 1, 4, "default", 9), "debugging"), ((10, 2, 4, 1, "default", 9), "implementation")],
)
def test_work_type(spark, args, want):
    names = ("total", "reads", "writes", "shells", "mode", "turns")
    assert one(spark, C.work_type(*[F.col(n) for n in names]), **dict(zip(names, args, strict=True))) == want


@pytest.mark.parametrize(
    ("tool", "inp", "want"),
    [
        ("Edit", '{"file_path":"/src/a/b/c.ts"}', "src/a/**/*.ts"), ("Read", '{"file":"/x"}', None), ("Grep", '{"pattern":"' + "p" * 40 + '"}', "grep:" + "p" * 30 + "..."),
        ("Glob", '{"pattern":"*.ts"}', "glob:*.ts"), ("Agent", '{"subagent_type":"Explore"}', "Explore"), ("Bash", "{}", None), ("Other", "{}", None), ("Read", '{"file_path":"x.ts"}', "x.ts"),
    ],
)
def test_target_pattern(spark, tool, inp, want):
    assert one(spark, C.target_pattern(F.col("t"), F.col("i")), t=tool, i=inp) == want


def test_goal_class(spark):
    pairs = {"feature_implementation": "feature", "bug_x": "bugfix", "code_cleanup": "refactoring", "readme_x": "documentation", "code_review": "review", "test_x": "testing", "ci_x": "ci", "create_pr": "git_ops", "npm_x": "setup", "x": "other"}
    rows = spark.createDataFrame(list(pairs.items()), "raw string, want string")
    assert rows.where(C.goal_class(F.col("raw")) != F.col("want")).count() == 0
