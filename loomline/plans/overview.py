"""Queries over sessions and what they add up to."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import classify as C
from loomline.functions import text as T
from loomline.operators import features, overview, sequences
from loomline.plans import views
from loomline.plans.views import SQL

QUERIES: dict = {}
ORACLES: dict = {}
ORDER = ["ts", "event_id"]
EDITED = "files AS (SELECT DISTINCT session_id, target_path AS file_path FROM calls WHERE tool_name IN ('Edit','Write'))"
BREAKDOWN = "breakdown AS (SELECT session_id, tool_name, count(*) AS n_calls FROM calls GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def calls_of(spark, sf):
    return views.calls(spark, sf)


def sessions_of(spark, sf):
    return views.sessions(views.calls(spark, sf))


@query(SQL + "SELECT session_id, tool_name, count(*) AS n_calls FROM calls GROUP BY ALL")
def tool_breakdown(spark, sf):
    return overview.tool_breakdown(calls_of(spark, sf))


@query(SQL + "SELECT session_id, model, count(*) AS n_lines FROM calls GROUP BY ALL")
def models_used(spark, sf):
    return overview.models_used(calls_of(spark, sf))


@query(SQL + "SELECT DISTINCT session_id, target_path AS file_path FROM calls WHERE tool_name IN ('Edit','Write')")
def files_edited(spark, sf):
    return overview.files_edited(calls_of(spark, sf))


@query(SQL + "SELECT session_id, turn_count, n_calls FROM sess")
def session_counts(spark, sf):
    return sessions_of(spark, sf).select("session_id", "turn_count", "n_calls")


@query(SQL + "SELECT session_id, created_at, last_active_at, duration_minutes FROM sess")
def activity_span(spark, sf):
    return overview.activity_span(calls_of(spark, sf))


GRID = "grid AS (SELECT CAST(i // 24 AS INTEGER) AS day, CAST(i % 24 AS INTEGER) AS hour FROM range(168) t(i)), cells AS (SELECT g.day, g.hour, count(s.session_id) AS n_sessions FROM grid g LEFT JOIN sess s ON dayofweek(created_at) = g.day AND hour(created_at) = g.hour GROUP BY ALL)"


@query(SQL + f", {GRID} SELECT * FROM cells")
def heatmap(spark, sf):
    return overview.heatmap(sessions_of(spark, sf))


@query(SQL + f", {GRID} SELECT day, hour, CAST(floor(n_sessions * 100 / CAST(greatest(max(n_sessions) OVER (), 1) AS DOUBLE) + 0.5) AS BIGINT) AS percent FROM cells")
def heatmap_intensity(spark, sf):
    return overview.heatmap_intensity(sessions_of(spark, sf))


@query(SQL + "SELECT project, count(*) AS n_sessions, CAST(sum(duration_minutes) AS BIGINT) AS minutes FROM sess GROUP BY project")
def project_distribution(spark, sf):
    return overview.project_distribution(sessions_of(spark, sf))


WEEK = "CAST(year({0}) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil((datediff('microsecond', CAST(make_date(year({0}),1,4) AS TIMESTAMP), {0})/86400000000.0 + dayofweek(make_date(year({0}),1,4)) + 1)/7) AS INTEGER) AS VARCHAR), 2, '0')"
TRENDS = "trends AS (SELECT " + WEEK.format("s.created_at") + " AS week, c.tool_name, count(*) AS n_calls FROM calls c JOIN sess s USING (session_id) GROUP BY ALL)"


@query(SQL + f", {TRENDS} SELECT * FROM trends")
def weekly_tool_trends(spark, sf):
    calls = calls_of(spark, sf)
    return overview.weekly_tool_trends(calls, views.sessions(calls))


@query(SQL + f""", {TRENDS}, grid AS (SELECT DISTINCT t.week, c.category FROM trends t, (VALUES ('Core'),('Agent'),('Plan'),('MCP'),('Other')) c(category)),
sums AS (SELECT week, CASE WHEN tool_name IN ('Read','Write','Edit','Bash','Grep','Glob') THEN 'Core' WHEN tool_name = 'Agent' THEN 'Agent' ELSE 'Other' END AS category, sum(n_calls) AS n FROM trends GROUP BY ALL)
SELECT g.week, g.category, CAST(floor(coalesce(n, 0) * 100 / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.week) AS DOUBLE) + 0.5) AS BIGINT) AS percent FROM grid g LEFT JOIN sums s ON s.week = g.week AND s.category = g.category""")
def weekly_category_share(spark, sf):
    return overview.weekly_category_share(weekly_tool_trends(spark, sf))


@query(SQL + """, b AS (SELECT * FROM (VALUES (0,'0-5m'),(1,'5-15m'),(2,'15-30m'),(3,'30-60m'),(4,'60-120m'),(5,'120m+')) v(place, bucket)),
n AS (SELECT CASE WHEN duration_minutes < 5 THEN 0 WHEN duration_minutes < 15 THEN 1 WHEN duration_minutes < 30 THEN 2 WHEN duration_minutes < 60 THEN 3 WHEN duration_minutes < 120 THEN 4 ELSE 5 END AS place, count(*) AS n FROM sess GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n_sessions FROM b LEFT JOIN n USING (place)""")
def duration_histogram(spark, sf):
    return overview.duration_histogram(sessions_of(spark, sf))


@query(SQL + f", {EDITED} SELECT file_path, count(*) AS edit_count FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_files(spark, sf):
    return overview.top_files(calls_of(spark, sf))


@query(SQL + "SELECT model, count(*) AS n_lines FROM calls GROUP BY 1")
def model_usage(spark, sf):
    return overview.model_usage(calls_of(spark, sf))


@query(SQL + "SELECT project, count(*) FILTER (WHERE permission_mode = 'plan') AS plan_sessions, count(*) AS n_sessions FROM sess GROUP BY 1")
def plan_mode_usage(spark, sf):
    return overview.plan_mode_usage(sessions_of(spark, sf))


MEDIAN = "SELECT list_sort(list(duration_minutes))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM sess"


@query(SQL + MEDIAN)
def upper_median(spark, sf):
    return overview.upper_median(sessions_of(spark, sf), "duration_minutes")


@query(SQL + f"SELECT session_id, project, duration_minutes FROM sess, ({MEDIAN}) m WHERE median > 0 AND duration_minutes > 2 * median")
def long_sessions(spark, sf):
    return overview.long_sessions(sessions_of(spark, sf))


@query(SQL + "SELECT session_id, target_path AS file_path, count(*) AS edits FROM calls WHERE tool_name = 'Edit' GROUP BY ALL HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def hot_files(spark, sf):
    return overview.hot_files(calls_of(spark, sf), least=2)


@query(SQL + "SELECT count(*) AS n_sessions, CAST(sum(duration_minutes) AS BIGINT) AS minutes, CAST(sum(n_calls) AS BIGINT) AS n_calls, count(DISTINCT project) AS n_projects FROM sess")
def overview_cards(spark, sf):
    return overview.overview_cards(sessions_of(spark, sf))


@query(SQL + f", {BREAKDOWN} SELECT session_id, tool_name, n_calls, CAST(floor(n_calls * 100 / CAST(sum(n_calls) OVER (PARTITION BY session_id) AS DOUBLE) + 0.5) AS BIGINT) AS percent FROM breakdown")
def session_tool_share(spark, sf):
    return overview.session_tool_share(tool_breakdown(spark, sf))


@query(SQL + """, c AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE tool_name IN ('Read','Grep','Glob')) AS r, count(*) FILTER (WHERE tool_name IN ('Edit','Write')) AS w, count(*) FILTER (WHERE tool_name = 'Bash') AS b FROM calls GROUP BY 1)
SELECT session_id, CASE WHEN permission_mode = 'plan' AND turn_count < 5 AND w = 0 THEN 'planning' WHEN r / CAST(total AS DOUBLE) >= 0.7 THEN 'investigation' WHEN b / CAST(total AS DOUBLE) >= 0.4 AND w > 0 THEN 'debugging' ELSE 'implementation' END AS work_type FROM sess JOIN c USING (session_id)""")
def work_type(spark, sf):
    calls = calls_of(spark, sf)
    return overview.work_types(views.sessions(calls), overview.tool_breakdown(calls))


SHELL = """CASE WHEN regexp_matches(cmd, '^git\\s') THEN 'git' WHEN regexp_matches(cmd, '^npm\\s|^npx\\s|^yarn\\s|^pnpm\\s') THEN 'npm' WHEN regexp_matches(cmd, 'test|jest|vitest|mocha|pytest') THEN 'test'
WHEN regexp_matches(cmd, 'build|tsc|webpack|vite\\s+build|esbuild') THEN 'build' WHEN regexp_matches(cmd, 'lint|eslint|prettier') THEN 'lint' WHEN regexp_matches(cmd, 'docker|kubectl|helm') THEN 'container' WHEN regexp_matches(cmd, 'curl|wget|fetch') THEN 'http' ELSE 'other' END"""
TARGET = f"CASE WHEN tool_name IN ('Read','Edit','Write') THEN 'src/m' || (k % 7) || '/**/*.ts' WHEN tool_name = 'Bash' THEN {SHELL} ELSE 'Explore' END"


@query(SQL + f"SELECT event_id, tool_name, CASE tool_name WHEN 'Read' THEN 'read' WHEN 'Edit' THEN 'write' WHEN 'Write' THEN 'write' WHEN 'Bash' THEN 'execute' ELSE 'delegate' END AS category, {TARGET} AS target FROM calls")
def tool_abstraction(spark, sf):
    return features.abstractions(calls_of(spark, sf)).select("event_id", "tool_name", "category", "target")


@query(SQL + f"SELECT event_id, {SHELL} AS shell_class FROM calls")
def bash_class(spark, sf):
    return calls_of(spark, sf).select("event_id", C.shell_class(F.col("command")).alias("shell_class"))


@query("SELECT page_id, CASE WHEN len(p) <= 1 THEN url ELSE (CASE WHEN len(d) > 0 THEN array_to_string(d[1:2], '/') || '/' ELSE '' END) || '**/*' || regexp_extract(url, '\\.[a-zA-Z0-9]+$', 0) END AS pattern FROM (SELECT page_id, url, string_split(url, '/') AS p, list_filter(string_split(url, '/')[1:-2], lambda x: x <> '') AS d FROM pages)")
def path_abstraction(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", C.path_pattern(F.col("url")).alias("pattern"))


# A label drawn from each text: a stem by its length, at times with the text's first characters behind it.
GOAL_STEMS = ("feature", "ui_", "bug_", "debug", "cleanup_", "code_cleanup", "readme_", "code_review", "test_", "ci_", "create_pr", "git_", "npm_", "pr", "misc")
GOAL_CASES = " ".join("WHEN " + " OR ".join([*(f"starts_with(raw, '{s}')" for s in starts), *(f"raw = '{n}'" for n in names)]) + f" THEN '{goal}'" for goal, starts, names in C.GOALS)


@query(f"WITH d AS (SELECT doc_id, {list(GOAL_STEMS)}[length(text) % {len(GOAL_STEMS)} + 1] || CASE WHEN length(text) % 3 = 0 THEN '' ELSE left(text, 2) END AS raw FROM documents) SELECT doc_id, raw, CASE {GOAL_CASES} ELSE 'other' END AS goal_class FROM d")
def goal_category(spark, sf):
    stem = F.element_at(F.array(*[F.lit(g) for g in GOAL_STEMS]), F.length("text") % len(GOAL_STEMS) + 1)
    raw = F.concat(stem, F.when(F.length("text") % 3 == 0, "").otherwise(F.left("text", F.lit(2))))
    return views.table(spark, sf, "documents").select("doc_id", raw.alias("raw")).withColumn("goal_class", C.goal_class(F.col("raw")))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE WHEN quality = 1 THEN 0.25::DOUBLE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM labels")
def helpfulness(spark, sf):
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "essential").when(F.col("quality") == 1, "slightly_helpful").when(F.col("toxic") == 1, "unhelpful").otherwise("unknown")
    return views.table(spark, sf, "labels").select("doc_id", C.helpfulness(label).alias("score"))


def turned(calls):
    nth = Window.partitionBy("session_id").orderBy(*ORDER)
    return calls.withColumn("turn_index", F.floor((F.row_number().over(nth) - 1) / 3).cast("int"))


TURNED = "turned AS (SELECT *, CAST((row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1) // 3 AS INTEGER) AS turn_index FROM calls)"


@query(SQL + f", {TURNED} SELECT session_id, turn_index, turn_index + 1 AS number, CASE WHEN bool_or(tool_name = 'Agent') THEN 'agent' ELSE 'standard' END AS kind, array_to_string(list_sort(list(DISTINCT tool_name)), ', ') AS tools, count(*) AS n_calls FROM turned GROUP BY session_id, turn_index")
def turn_kind(spark, sf):
    return overview.turn_summary(turned(calls_of(spark, sf))).drop("prompt")


@query(SQL + ", n AS (SELECT session_id, model AS agent_id, tool_name, count(*) AS n FROM calls GROUP BY ALL) SELECT session_id, agent_id, string_agg(tool_name || ': ' || n, ', ' ORDER BY n DESC, tool_name) AS tools, CAST(sum(n) AS BIGINT) AS n_calls FROM n GROUP BY ALL")
def subagent_summary(spark, sf):
    return overview.subagent_summary(calls_of(spark, sf).withColumn("agent_id", F.col("model")))


@query(SQL + "SELECT DISTINCT tool_name, CASE tool_name WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'edit' WHEN 'Write' THEN 'edit' WHEN 'Read' THEN 'read' ELSE 'agent' END AS display, CASE tool_name WHEN 'Agent' THEN 'Agent' ELSE 'Core' END AS trend FROM calls")
def tool_category(spark, sf):
    tool = F.col("tool_name")
    return calls_of(spark, sf).select("tool_name", C.display_category(tool).alias("display"), C.trend_category(tool).alias("trend")).distinct()


@query(SQL + "SELECT session_id, project, git_branch, created_at FROM sess WHERE turn_count > 0 AND project = 'org/p3' AND git_branch ILIKE '%b%' AND created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-03-01'")
def session_search(spark, sf):
    return overview.search(sessions_of(spark, sf), project="org/p3", branch="B", from_day="2024-01-08", to_day="2024-02-29").select("session_id", "project", "git_branch", "created_at")


@query(SQL + "SELECT session_id, n_calls, duration_minutes FROM sess ORDER BY n_calls DESC, session_id LIMIT 20 OFFSET 20")
def session_page(spark, sf):
    return overview.page(sessions_of(spark, sf), "n_calls", 1).select("session_id", "n_calls", "duration_minutes")


@query(SQL + "SELECT session_id, duration_minutes, CASE WHEN duration_minutes >= 60 THEN (duration_minutes // 60) || 'h ' || (duration_minutes % 60) || 'm' ELSE duration_minutes || 'm' END AS shown FROM sess")
def duration_texts(spark, sf):
    return sessions_of(spark, sf).select("session_id", "duration_minutes", T.duration_text(F.col("duration_minutes")).alias("shown"))


@query(SQL + "SELECT session_id, turn_index, user_prompt, coalesce(array_to_string(texts, chr(10)), '') AS texts FROM turns")
def turns(spark, sf):
    return views.prompts(spark, sf).select("session_id", "turn_index", "user_prompt", F.array_join("texts", "\n").alias("texts"))


@query(SQL + "SELECT session_id, turn_index, user_prompt FROM (SELECT *, max(CAST(session_id % 2 = 0 AND turn_index = 1 AS INTEGER)) OVER (PARTITION BY session_id) AS p FROM turns) WHERE (p = 0 OR (session_id % 2 = 0 AND turn_index = 1)) AND trim(user_prompt) <> ''")
def candidate_prompts(spark, sf):
    rows = views.prompts(spark, sf).withColumn("is_plan", (F.col("session_id") % 2 == 0) & (F.col("turn_index") == 1))
    return features.candidate_prompts(rows).select("session_id", "turn_index", "user_prompt")


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
CAMEL = "list_transform(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+'), lambda c: lower(c))"
PATHS = "flatten(list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all({0}, '(?:/[\\w.-]+){{2,}}'), lambda p: list_filter(string_split(p, '/'), lambda s: s <> ''))), lambda s: regexp_replace(s, '\\.[^.]+$', '')), lambda s: length(s) > 2), lambda s: " + CAMEL.format("s") + "))"
PARTS = "flatten(list_transform(flatten(list_transform(list_filter(string_split_regex(regexp_replace({0}, '[`''\"{{}}()\\[\\]<>;:,!?@#$%^&*=+|\\\\~/]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT starts_with(w, 'http')), lambda w: list_filter(string_split_regex(w, '[-_]'), lambda p: p <> ''))), lambda p: " + CAMEL.format("p") + "))"
KEEP = f"length(t) > 2 AND t NOT IN ({STOPS}) AND NOT regexp_full_match(t, '[0-9a-f]{{6,}}') AND NOT regexp_full_match(t, '[0-9]+') AND length(t) <= 40"


def tokens_sql(key: str, text: str, source: str) -> str:
    """(key, term) of every token in DuckDB."""
    clean = "list_filter(list_transform(" + PARTS.format(text) + ", lambda t: regexp_replace(t, '[^a-z0-9\\x{3040}-\\x{9fff}]', '', 'g')), lambda t: " + KEEP + ")"
    return f"SELECT {key}, unnest(list_concat({PATHS.format(text)}, {clean})) AS term FROM {source}"


COUNTS = "tok AS (" + tokens_sql("doc_id", "text", "documents") + "), counts AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL), nd AS (SELECT count(DISTINCT doc_id) AS docs FROM counts), vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term), kept AS (SELECT term, df, ln(docs / CAST(df AS DOUBLE)) AS idf FROM vocab, nd WHERE df >= 2 AND df <= greatest(2, floor(docs * 0.8)))"


def document_terms(spark, sf):
    return features.term_counts(views.table(spark, sf, "documents"), "doc_id", look=True)


@query(f"WITH {COUNTS} SELECT * FROM counts")
def tokens(spark, sf):
    return document_terms(spark, sf)


@query(f"WITH {COUNTS} SELECT * FROM vocab")
def token_df(spark, sf):
    return features.document_frequency(document_terms(spark, sf), "doc_id")


@query(f"WITH {COUNTS}, w AS (SELECT doc_id, term, ln(1 + n) * idf AS w FROM counts JOIN kept USING (term)) SELECT doc_id, term, round(CASE WHEN l > 0 THEN w / l ELSE 0 END, 6) AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM w)")
def tfidf(spark, sf):
    return features.tfidf(document_terms(spark, sf), "doc_id").withColumn("weight", F.round("weight", 6))


@query("SELECT page_id, " + PATHS.format("url") + " AS parts FROM pages")
def path_tokens(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", T.path_tokens(F.col("url")).alias("parts"))


@query("SELECT page_id, array_to_string(" + CAMEL.format("regexp_replace(url, 'example', 'exampleURLPart', 'g')") + ", ' ') AS parts FROM pages")
def camel_split(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.array_join(T.camel_parts(F.replace("url", F.lit("example"), F.lit("exampleURLPart"))), " ").alias("parts"))


@query(SQL + f", {BREAKDOWN}, n AS (SELECT count(DISTINCT session_id) AS docs FROM breakdown), i AS (SELECT tool_name, CASE WHEN docs = count(*) THEN 1.0 ELSE ln(docs / CAST(count(*) AS DOUBLE)) END AS idf FROM breakdown, n GROUP BY tool_name, docs), w AS (SELECT session_id, tool_name, ln(1 + n_calls) * idf AS w FROM breakdown JOIN i USING (tool_name)) SELECT session_id, tool_name, round(w / sqrt(sum(w * w) OVER (PARTITION BY session_id)), 6) AS weight FROM w")
def tool_idf(spark, sf):
    return features.tool_vectors(tool_breakdown(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(SQL + """, c AS (SELECT session_id, count(*) AS t, count(*) FILTER (WHERE tool_name IN ('Edit','Write')) AS w, count(*) FILTER (WHERE tool_name = 'Read') AS r FROM calls GROUP BY 1),
d AS (SELECT session_id, 0.5 AS d0, 0.5 AS d1, 1.0 AS d2, 0.0 AS d3, ln(1 + t / CAST(turn_count AS DOUBLE)) AS d4, w / CAST(t AS DOUBLE) AS d5, r / CAST(t AS DOUBLE) AS d6 FROM sess JOIN c USING (session_id)),
l AS (SELECT *, sqrt(d0*d0+d1*d1+d2*d2+d3*d3+d4*d4+d5*d5+d6*d6) AS n FROM d)
SELECT session_id, """ + ", ".join(f"round(CAST(d{i} / n AS DOUBLE), 6) AS d{i}" for i in range(7)) + " FROM l")
def structural(spark, sf):
    calls = calls_of(spark, sf)
    rows = views.sessions(calls).withColumns({"assistant_turns": F.col("turn_count"), "tool_turns": F.col("turn_count"), "subagent_count": F.lit(0)})
    found = features.structure(rows, overview.tool_breakdown(calls))
    return found.select("session_id", *[F.round(f"d{i}", 6).alias(f"d{i}") for i in range(7)])


@query(SQL + ", tok AS (" + tokens_sql("session_id", "user_prompt", "turns") + "), c AS (SELECT session_id, term, count(*) AS n FROM tok GROUP BY ALL) SELECT session_id, term, n, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS INTEGER) AS place FROM c QUALIFY place <= 5")
def session_keywords(spark, sf):
    return features.keywords(views.prompts(spark, sf))


@query(SQL + ", p AS (SELECT session_id, turn_index, user_prompt, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS i FROM turns), w AS (SELECT DISTINCT session_id, i, term FROM (" + tokens_sql("session_id, i", "user_prompt", "p") + """)), z AS (SELECT session_id, i, count(*) AS s FROM w GROUP BY ALL),
b AS (SELECT x.session_id, x.i, y.i AS j, count(*) AS b FROM w x JOIN w y ON x.session_id = y.session_id AND x.term = y.term AND x.i <> y.i GROUP BY ALL),
s AS (SELECT b.session_id, b.i, sum(b / CAST(u.s + v.s - b AS DOUBLE)) AS total FROM b JOIN z u ON u.session_id = b.session_id AND u.i = b.i JOIN z v ON v.session_id = b.session_id AND v.i = b.j GROUP BY ALL)
SELECT p.session_id, p.turn_index, round(coalesce(total, 0) / (p.i + 1), 9) AS score, left(p.user_prompt, 300) AS prompt FROM p LEFT JOIN s ON s.session_id = p.session_id AND s.i = p.i QUALIFY row_number() OVER (PARTITION BY p.session_id ORDER BY score DESC, p.i) = 1""")
def representative_prompt(spark, sf):
    return features.representative_prompts(views.prompts(spark, sf))


@query(SQL + f", {EDITED}, p AS (SELECT session_id, count(*) AS n, min(file_path) AS a, count(DISTINCT string_split(file_path, '/')[3]) AS dirs, count(DISTINCT file_path) AS f FROM files GROUP BY 1) SELECT session_id, CASE WHEN f = 1 OR dirs = 1 THEN '/src/' || string_split(a, '/')[3] ELSE '/src' END AS scope FROM p")
def common_prefix(spark, sf):
    return features.directory_scope(files_edited(spark, sf))


@query(SQL + ", s AS (SELECT tool_name AS a, lead(tool_name, 1) OVER w AS b, lead(tool_name, 2) OVER w AS c FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) SELECT a || ' → ' || b || ' → ' || c AS sequence, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20")
def tool_trigrams(spark, sf):
    return sequences.trigrams(calls_of(spark, sf), ORDER)


GRAMS = f"""runs AS (SELECT session_id, project, list(tool_name || ':' || {TARGET}) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS run FROM calls),
every AS (SELECT session_id, project, length, run[1:length] AS steps FROM runs, (SELECT unnest([3,4,5,6,7]) AS length) WHERE len(run) >= length),
grams AS (SELECT steps, CAST(length AS INTEGER) AS length, count(*) AS n, count(DISTINCT session_id) AS n_sessions, count(DISTINCT project) AS n_projects FROM every GROUP BY ALL HAVING count(*) >= 2)"""
COVERED = "parts AS (SELECT g.steps[a:a+s-1] AS steps, max(g.n) AS outer_n FROM grams g, (SELECT unnest([3,4,5,6]) AS s), (SELECT unnest([1,2,3,4,5]) AS a) WHERE s < g.length AND a + s - 1 <= g.length GROUP BY 1), maxi AS (SELECT g.* FROM grams g LEFT JOIN parts p ON p.steps = g.steps AND p.outer_n >= 0.8 * g.n WHERE p.steps IS NULL)"
SHOWN = "array_to_string(steps, ' → ') AS sequence, length, n, n_sessions, n_projects"


def shown(grams):
    return grams.select(F.array_join("steps", sequences.ARROW).alias("sequence"), "length", "n", "n_sessions", "n_projects")


@query(SQL + f", {GRAMS} SELECT {SHOWN} FROM grams")
def enriched_ngrams(spark, sf):
    return shown(sequences.ngrams(calls_of(spark, sf), ORDER))


@query(SQL + f", {GRAMS}, {COVERED} SELECT {SHOWN} FROM maxi")
def maximal_patterns(spark, sf):
    return shown(sequences.maximal(sequences.ngrams(calls_of(spark, sf), ORDER)))


@query(SQL + f", {GRAMS}, {COVERED} SELECT {SHOWN} FROM maxi ORDER BY n DESC, length DESC, steps LIMIT 30")
def top_patterns(spark, sf):
    return shown(sequences.top_patterns(sequences.maximal(sequences.ngrams(calls_of(spark, sf), ORDER))))
