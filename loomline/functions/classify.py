"""Column functions that put tool calls, sessions and labels into classes by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shell command classes, the first pattern that a command matches.
SHELL = (
    ("git", r"^git\s"),
    ("npm", r"^npm\s|^npx\s|^yarn\s|^pnpm\s"),
    ("test", r"test|jest|vitest|mocha|pytest"),
    ("build", r"build|tsc|webpack|vite\s+build|esbuild"),
    ("lint", r"lint|eslint|prettier"),
    ("container", r"docker|kubectl|helm"),
    ("http", r"curl|wget|fetch"),
    ("filesystem", r"mkdir|rm\s|cp\s|mv\s|chmod|chown"),
    ("read", r"cat\s|head\s|tail\s|less\s|grep\s"),
)
# Goal classes by prefixes and whole names.
GOALS = (
    ("feature", ("feature", "ui_", "css_"), ()),
    ("bugfix", ("fix_", "bug_", "debug"), ()),
    ("refactoring", ("refactoring", "cleanup_"), ("code_cleanup",)),
    ("documentation", ("documentation", "readme_"), ()),
    ("review", ("code_review",), ()),
    ("testing", ("test_",), ()),
    ("ci", ("ci_",), ()),
    ("git_ops", ("git_", "pr_", "resolve_merge"), ("create_pr",)),
    ("setup", ("setup_", "configuration_", "dependency_", "npm_"), ()),
)
# What a helpfulness label is worth.
HELPFULNESS = {"essential": 1.0, "very_helpful": 0.8, "moderately_helpful": 0.5, "slightly_helpful": 0.25, "unhelpful": 0.0}
# Tools by class.
CATEGORY = {"Read": "read", "Grep": "search", "Glob": "search", "Edit": "write", "Write": "write", "Bash": "execute", "Agent": "delegate"}
TREND = {"Core": ("Read", "Write", "Edit", "Bash", "Grep", "Glob"), "Agent": ("Agent",), "Plan": ("EnterPlanMode", "ExitPlanMode", "AskUserQuestion", "TodoWrite")}
PLANNING_TOOLS = ("EnterPlanMode", "ExitPlanMode", "AskUserQuestion", "TodoWrite")
DISPLAY = {"shell": ("Bash",), "edit": ("Edit", "Write"), "read": ("Read",), "search": ("Grep", "Glob"), "agent": ("Agent",)}


def rules(pairs: list[tuple[Column, object]], default: object) -> Column:
    found = None
    for test, value in pairs:
        found = F.when(test, value) if found is None else found.when(test, value)
    return found.otherwise(default)


def shell_class(command: Column) -> Column:
    trimmed = F.trim(command)
    return rules([(trimmed.rlike(pattern), name) for name, pattern in SHELL], "other")


def goal_class(raw: Column) -> Column:
    def test(starts: tuple, names: tuple) -> Column:
        found = F.lit(False)
        for s in starts:
            found = found | raw.startswith(s)
        return found | raw.isin(*names) if names else found

    return rules([(test(starts, names), name) for name, starts, names in GOALS], "other")


def helpfulness(label: Column) -> Column:
    return rules([(label == k, F.lit(v)) for k, v in HELPFULNESS.items()], F.lit(0.5))


def tool_category(tool: Column) -> Column:
    return rules([(tool == k, v) for k, v in CATEGORY.items()], "execute")


def trend_category(tool: Column) -> Column:
    return rules([(tool.isin(*names), k) for k, names in TREND.items()] + [(tool.startswith("mcp__"), "MCP")], "Other")


def display_category(tool: Column) -> Column:
    return rules([(tool.isin(*names), k) for k, names in DISPLAY.items()], "other")


def turn_kind(tools: Column) -> Column:
    """agent, planning or standard, from an array of a turn's tools."""
    planning = F.arrays_overlap(tools, F.array(*[F.lit(t) for t in PLANNING_TOOLS]))
    return F.when(F.array_contains(tools, "Agent"), "agent").when(planning, "planning").otherwise("standard")


def path_pattern(path: Column) -> Column:
    """A path's first two directories and its extension, all between as wildcards."""
    parts = F.split(path, "/")
    directories = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    prefix = F.array_join(F.slice(directories, 1, 2), "/")
    extension = F.regexp_extract(path, r"\.[a-zA-Z0-9]+$", 0)
    pattern = F.concat(F.when(prefix != "", F.concat(prefix, F.lit("/"))).otherwise(""), F.lit("**/*"), extension)
    return F.when(F.size(parts) <= 1, path).otherwise(pattern)


def target_pattern(tool: Column, input_json: Column) -> Column:
    """What a tool call aims at, in the abstract; null for other tools or inputs without the field."""
    field = lambda name: F.get_json_object(input_json, f"$.{name}")
    pattern = field("pattern")
    return (
        F.when(tool.isin("Edit", "Write", "Read"), path_pattern(field("file_path")))
        .when(tool == "Bash", F.when(field("command").isNotNull(), shell_class(field("command"))))
        .when(tool == "Grep", F.concat(F.lit("grep:"), F.when(F.length(pattern) > 30, F.concat(F.left(pattern, F.lit(30)), F.lit("..."))).otherwise(pattern)))
        .when(tool == "Glob", F.concat(F.lit("glob:"), pattern))
        .when(tool == "Agent", field("subagent_type"))
    )


def work_type(total: Column, reads: Column, writes: Column, shells: Column, mode: Column, turns: Column) -> Column:
    """planning, investigation, debugging or implementation by the shares of a session's calls."""
    share = lambda n: F.coalesce(F.try_divide(n, total), F.lit(0.0))
    plan = F.coalesce((mode == "plan") & (turns < 5) & (writes == 0), F.lit(False))
    return F.when((total == 0) | plan, "planning").when(share(reads) >= 0.7, "investigation").when((share(shells) >= 0.4) & (writes > 0), "debugging").otherwise("implementation")


def centrality_band(betweenness: Column, degree: Column) -> Column:
    return F.when(betweenness > 0.2, "critical bridge").when(betweenness > 0.05, "bridge").when(degree > 0.5, "hub").when(degree == 0, "isolated").otherwise("peripheral")


def week_label(ts: Column) -> Column:
    """Year and week: weeks from January 4th, with its day of the week (Sunday 0) as offset, rounded up."""
    fourth = F.make_date(F.year(ts), F.lit(1), F.lit(4))
    days = F.timestamp_diff("MICROSECOND", fourth.cast("timestamp_ntz"), ts) / F.lit(86400000000.0)
    week = F.ceil((days + F.dayofweek(fourth)) / 7).cast("int")
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
