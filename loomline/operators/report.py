"""Candidates for reuse and the documents written about them, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators.sequences import ARROW
from loomline.operators.topics import listed

#: How a role shows, and what to keep in mind with it.
ROLES = {"subagent-delegated": "parts of the work go to subagents", "tool-heavy": "mostly calls of tools", "user-driven": "a dialogue with few calls"}
ADVICE = {
    "subagent-delegated": "Say what each subagent has to bring back before it starts.",
    "tool-heavy": "Look at each result before the next call; most of the work is done by tools.",
    "user-driven": "Ask when the aim is open; these sessions were led by questions.",
}


def candidates(scores: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(topic_id, overall, sequences): topics by score, with the linked patterns (topic_id, place, steps), the most frequent
    first."""
    ranked = scores.select("topic_id", "overall")
    if links is not None:
        ranked = ranked.join(listed(links.withColumn("sequence", F.array_join("steps", ARROW)), ["topic_id"], "sequence", "sequences"), "topic_id", "left")
    return ranked.orderBy(F.desc("overall"), "topic_id")


def top(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("overall"), "topic_id").limit(max(n, 1))


def by_role(role: Column, texts: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, text in texts.items():
        found = F.when(role == name, text).otherwise(found)
    return found


def scope(n_projects: Column, project: Column) -> Column:
    return F.when(n_projects > 1, F.concat(n_projects, F.lit(" projects"))).otherwise(project)


def descriptions(meta: DataFrame, prompts: DataFrame, signature: DataFrame, roles: DataFrame) -> DataFrame:
    """(topic_id, description): what a topic's sessions were about, how they went and how many there were."""
    tools = listed(signature.where("place <= 3"), ["topic_id"], "tool_name", "tools")
    rows = meta.join(prompts, "topic_id").join(tools, "topic_id", "left").join(roles, "topic_id")
    about = F.substring_index("prompt", " — ", 1)
    how = F.concat_ws(", with ", by_role(F.col("role"), ROLES), F.nullif(F.array_join("tools", ", "), F.lit("")))
    where = F.concat(F.lit("seen in "), scope(F.col("n_projects"), F.col("project")), F.lit(", "), "session_count", F.lit(" sessions, "), "total_duration_minutes", F.lit(" min"))
    return rows.select("topic_id", F.concat_ws("; ", about, how, where).alias("description"))


def skill_documents(meta: DataFrame, keywords: DataFrame, described: DataFrame, signature: DataFrame, prompts: DataFrame, links: DataFrame, actions: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """(topic_id, skill_name, markdown): a document per topic: front matter, an overview, when to use it, the workflow by its
    most frequent tool sequences with their counts, tools, prompts as examples, and guidelines. Sections without content are left out."""
    words = listed(keywords, ["topic_id"], "term", "words")
    lines = lambda rows, of: F.array_join(F.transform(rows, of), "\n")
    tools = signature.groupBy("topic_id").agg(lines(F.array_sort(F.collect_list(F.struct("place", "tool_name", "weight"))), lambda x: F.concat(F.lit("- "), x["tool_name"], F.lit(" ("), x["weight"], F.lit(")"))).alias("tools"))
    examples = prompts.groupBy("topic_id").agg(lines(F.array_sort(F.collect_list(F.struct("place", "prompt"))), lambda x: F.concat(F.lit("> "), F.regexp_replace(x["prompt"], r"\s+", " "))).alias("examples"))
    seen = links.where("place <= 5").withColumn("line", F.concat("place", F.lit(". "), F.array_join("steps", ARROW), F.lit(" ("), "n", F.lit(" times)")))
    runs = listed(seen, ["topic_id"], "line", "runs").withColumn("runs", F.array_join("runs", "\n"))
    rows = meta.join(words, "topic_id", "left").join(described, "topic_id")
    for part in (tools, examples, runs, actions, roles):
        if part is not None:
            rows = rows.join(part, "topic_id", "left")
    for column in ("action", "role"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    name = T.skill_name(F.coalesce("words", F.array().cast("array<string>")), F.col("project"))
    overview = F.concat("session_count", F.lit(" sessions in "), scope(F.col("n_projects"), F.col("project")), F.lit(" with "), "total_tool_calls", F.lit(" calls of tools, "), T.duration_text(F.col("total_duration_minutes")), F.lit(" in all."))
    use = F.concat_ws("\n", F.concat(F.lit("- The task is to "), "action", F.lit(".")), F.concat(F.lit("- It has to do with "), F.nullif(F.array_join("words", ", "), F.lit("")), F.lit(".")))
    sections = (("Overview", overview), ("When to Use", F.nullif(use, F.lit(""))), ("Workflow", F.col("runs")), ("Tools", F.col("tools")), ("Example Prompts", F.col("examples")), ("Guidelines", F.concat(F.lit("- "), by_role(F.col("role"), ADVICE))))
    front = F.concat(F.lit("---\nname: "), "skill_name", F.lit("\ndescription: "), "description", F.lit("\n---\n"))
    return rows.withColumn("skill_name", name).select("topic_id", "skill_name", F.concat_ws("\n", front, *[F.concat(F.lit(f"## {title}\n\n"), c, F.lit("\n")) for title, c in sections]).alias("markdown"))


def hooks(links: DataFrame) -> DataFrame:
    """(topic_id, hook): where a topic's most frequent pattern has a classified shell step, the hook's definition as JSON:
    description, pattern by tool, category and target, number of occurrences, and projects. links: as topic_links gives
    them, with the projects of each pattern."""
    first = links.where("place = 1").where(F.exists("steps", lambda s: s.startswith("Bash:") & (s != "Bash:other")))
    step = F.expr("transform(steps, x -> struct(substring_index(x, ':', 1) AS tool, x AS step))")
    pattern = F.transform(step, lambda x: F.struct(x["tool"].alias("tool"), C.tool_category(x["tool"]).alias("category"), F.nullif(F.regexp_replace(x["step"], "^[^:]*:?", ""), F.lit("")).alias("target")))
    said = F.concat(F.lit("Seen "), "n", F.lit(" times in "), F.size("projects"), F.lit(" project(s)"))
    hook = F.struct(said.alias("description"), pattern.alias("pattern"), F.col("n").alias("sessionCount"), F.col("projects"))
    return first.select("topic_id", F.to_json(hook, {"ignoreNullFields": "false"}).alias("hook"))


def prompt_set(documents: DataFrame, context: DataFrame, labels: DataFrame, rollup: DataFrame | None = None, links: DataFrame | None = None, central: DataFrame | None = None) -> DataFrame:
    """(topic_id, prompt): what a batch job over a language model is given per candidate: the document drafted so far, five
    of its tool sequences, the topic's neighbours and its place in the graph (topic_id, betweenness, degree), and what its
    sessions' labels say."""
    near = context.join(labels.select(F.col("topic_id").alias("other"), "label"), "other", "left")
    lines = near.groupBy(F.col("node").alias("topic_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "direction", "strength"))), lambda x: F.concat(F.lit("- "), F.coalesce(x["label"], F.lit("?")), F.lit(" ("), x["direction"], F.lit(", "), x["strength"], F.lit(")"))), "\n").alias("near"))
    rows = documents.join(lines, "topic_id", "left")
    none = F.lit(None).cast("string")
    known, runs, place = none, none, none
    if rollup is not None:
        rows = rows.join(rollup.select("topic_id", "success_rate", "helpfulness", "goals", "frictions"), "topic_id", "left")
        listed_as = lambda name, c: F.concat(F.lit(name), F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("."))
        rates = F.when(F.col("success_rate").isNotNull(), F.format_string("Success rate %.2f, helpfulness %.2f.", "success_rate", "helpfulness"))
        known = F.nullif(F.concat_ws(" ", rates, listed_as("Goals: ", "goals"), listed_as("Frictions: ", "frictions")), F.lit(""))
    if links is not None:
        seen = links.where("place <= 5").withColumn("sequence", F.concat(F.array_join("steps", ARROW), F.lit(" ("), "n", F.lit(" times)")))
        rows = rows.join(listed(seen, ["topic_id"], "sequence", "sequences"), "topic_id", "left")
        runs = F.concat(F.lit("Tool sequences:\n"), F.array_join(F.transform("sequences", lambda x: F.concat(F.lit("- "), x)), "\n"))
    if central is not None:
        rows = rows.join(central, "topic_id", "left")
        place = F.concat(F.lit("Place in the graph: "), F.when(F.col("degree").isNotNull(), C.centrality_band(F.col("betweenness"), F.col("degree"))), F.lit("."))
    return rows.select("topic_id", F.concat_ws("\n\n", F.lit("Write a reusable skill document from this draft."), "markdown", runs, F.concat(F.lit("Neighbouring topics:\n"), "near"), place, known).alias("prompt"))


def dry_run(scores: DataFrame, labels: DataFrame, keywords: DataFrame, meta: DataFrame, n: int = 5) -> DataFrame:
    """(topic_id, overall, label, keywords, session_count) of the best candidates."""
    words = listed(keywords, ["topic_id"], "term", "words")
    rows = top(scores, n).select("topic_id", "overall").join(labels, "topic_id").join(words, "topic_id", "left").join(meta.select("topic_id", "session_count"), "topic_id")
    return rows.select("topic_id", "overall", "label", F.array_join("words", ", ").alias("keywords"), "session_count")


def write_skills(documents: DataFrame, path: str) -> None:
    """A folder per skill with its document."""
    documents.select("skill_name", "markdown").write.partitionBy("skill_name").option("lineSep", "\n").text(path)
