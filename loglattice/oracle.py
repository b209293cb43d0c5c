"""What the registered queries say, as DuckDB SQL over the same tables."""

from __future__ import annotations

from .operators.search import STEP2, STEP3, STEP4

ZONE = "America/Chicago"


def _events(zone: str = ZONE) -> str:
    local = f"((ts AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"
    return f"""ev AS (SELECT event_type AS tool, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 7) AS model, user_id::VARCHAR AS session_id, 'proj' || (user_id % 10) AS project,
      (props->>'$.k')::BIGINT AS tokens, value::DECIMAL(38,12) AS cost, strftime({local}, '%Y-%m-%d') AS date, hour({local})::INT AS hour, event_id FROM events)"""


def _r2(x: str) -> str:
    return f"floor(({x})::DOUBLE * 100 + 0.5) / 100"


COST = _r2("sum(cost)") + " AS cost_usd"
TOKENS = "sum(tokens)::BIGINT AS tokens"
SESSION_COUNT = "count(DISTINCT tool || '|' || session_id) AS session_count"
MESSAGES = "count(*) AS messages"
SLOTS = {
    "tool": ("tool", (TOKENS, COST, SESSION_COUNT, MESSAGES)),
    "provider": ("provider", (TOKENS, COST)),
    "model": ("tool, provider, model", (TOKENS, COST, SESSION_COUNT, MESSAGES)),
    "project": ("project", (TOKENS, COST, SESSION_COUNT)),
}
DAILY = f"SELECT date, {TOKENS}, {COST}, {SESSION_COUNT}, {MESSAGES} FROM ev GROUP BY date"
#: Measures of totals over days.
SUMS = {TOKENS: TOKENS, COST: _r2("sum(cost_usd::DECIMAL(38,12))") + " AS cost_usd", SESSION_COUNT: "sum(session_count)::BIGINT AS session_count", MESSAGES: "sum(messages)::BIGINT AS messages"}


def _by_day(slot: str, source: str = "ev") -> str:
    keys, measures = SLOTS[slot]
    return f"SELECT date, {keys}, {', '.join(measures)} FROM {source} GROUP BY date, {keys}"


def _totals(slot: str, where: str = "true") -> str:
    keys, measures = SLOTS[slot]
    label = f", {keys} AS label" if slot in ("tool", "provider") else ""
    return f"WITH {_events()}, kept AS (SELECT * FROM ev WHERE {where}), days AS ({_by_day(slot, 'kept')}) SELECT {keys}{label}, {', '.join(SUMS[m] for m in measures)} FROM days GROUP BY {keys}"


WEEK = "(d + ((7 - dayofweek(d)) % 7)::INT)"
SESSION = """s AS (SELECT printf('%012d', o_orderkey) AS file_path, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%d') AS created_at, '/' || r_name || '/' || n_name AS cwd, o_orderpriority AS tool,
  coalesce(n, 0)::INT AS message_count, (coalesce(n, 0) % 4)::INT AS n_files, c_name AS first_prompt, o_orderstatus = 'F' AS errored, o_orderkey % 5 = 0 AS proof
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RANGED = f"WITH {SESSION}, r AS (SELECT * FROM s WHERE created_at >= '1995-01-01' AND created_at <= '1995-06-30')"
SCORED = f"""{SESSION}, scored AS (SELECT *, (log2(message_count + 1.0) + 0.5 * least(n_files, 10) + CASE WHEN proof THEN 2.0 ELSE 0.0 END)
  * pow(0.5, greatest(epoch(TIMESTAMP '1998-08-02' - created_at::TIMESTAMP) / 86400.0, 0) / 7.0) AS score, message_count <= 2 AND n_files = 0 AND NOT proof AS trivial FROM s)"""
PRIMER = f"""WITH {SCORED}, scope AS (SELECT * FROM scored WHERE (cwd = '/ASIA' OR starts_with(cwd, '/ASIA/')) AND created_at >= strftime(DATE '1998-08-02' - 900, '%Y-%m-%d')),
  best AS (SELECT * FROM scope WHERE NOT trivial OR NOT EXISTS (FROM scope WHERE NOT trivial) ORDER BY score DESC, created_at DESC, date DESC, file_path LIMIT 10)"""
STRIPPED = "text"
for _tag in ("system-reminder", "local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args"):
    STRIPPED = f"regexp_replace({STRIPPED}, '<{_tag}>.*?</{_tag}>', '', 'gs')"


INDEXED = f"m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, role, text FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {STRIPPED} ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant')) WHERE trim(text) <> '')"


def _clean(x: str) -> str:
    return f"substr(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), 1, 100)"


LINE_USAGE = """u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT * 8000 AS input, l_quantity::BIGINT * 10 AS output, l_quantity::BIGINT * 100 AS cache_read, l_quantity::BIGINT * 20 AS cache_write,
  l_quantity::BIGINT * 5 AS hour, CASE WHEN l_returnflag = 'R' THEN l_tax END AS recorded FROM lineitem),
  p AS (SELECT p_partkey, p_retailprice / 1e6 AS rate, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 1e6 * 1.5::DOUBLE END AS write, CASE WHEN p_size % 5 = 0 THEN p_retailprice / 1e6 / 4 END AS read, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1e6 * 2 END AS above FROM part)"""


def _tiered(tokens: str, rate: str, above: str) -> str:
    return f"(CASE WHEN {tokens} <= 0 THEN 0.0 WHEN {above} IS NOT NULL AND {tokens} > 200000 THEN 200000::DOUBLE * {rate} + ({tokens} - 200000)::DOUBLE * {above} ELSE {tokens}::DOUBLE * {rate} END)"


PRICED = " + ".join((_tiered("input", "rate", "above"), _tiered("output", "(rate * 5)", "NULL::DOUBLE"), _tiered("cache_read", "coalesce(read, rate * 0.1::DOUBLE)", "NULL::DOUBLE"), _tiered("greatest(0, cache_write - hour)", "coalesce(write, rate * 1.25::DOUBLE)", "NULL::DOUBLE"), _tiered("hour", "(rate * 2)", "(above * 2)")))
NOT_WORD = r"[^\p{L}\p{N}\p{M}\p{Co}]+"



def _stem(x: str) -> str:
    """The stems that search_stemmed_top looks for; other words stay as they are, which counts alike."""
    return f"CASE WHEN regexp_full_match({x}, 'licens(e|es|ed|ing|ings|er|ers)?') THEN 'licens' WHEN regexp_full_match({x}, 'version(s|ed|ing)?') THEN 'version' WHEN regexp_full_match({x}, 'public(s|ize|ized|al)?') THEN 'public' ELSE {x} END"


SQL: dict[str, str] = {
    "usage_daily": f"WITH {_events()} {DAILY}",
    **{f"usage_daily_by_{s}": f"WITH {_events()} {_by_day(s)}" for s in SLOTS},
    **{f"usage_by_{s}": _totals(s) for s in SLOTS},
    "usage_grouping_sets": f"""WITH {_events()} SELECT date, tool, provider, model, project, CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(tool) = 0 THEN 'tool' ELSE 'day' END AS slot,
      {TOKENS}, {COST}, {SESSION_COUNT}, {MESSAGES} FROM ev GROUP BY GROUPING SETS ((date), (date, tool), (date, provider), (date, tool, provider, model), (date, project))""",
    "usage_summary": f"""WITH {_events()}, days AS ({DAILY}), runs AS (SELECT count(*) AS n, min(d) AS a, max(d) AS b FROM (SELECT date::DATE AS d, date::DATE - row_number() OVER (ORDER BY date)::INT AS run FROM days) GROUP BY run),
      models AS (SELECT tool, provider, model, count(*) AS n FROM ev GROUP BY tool, provider, model ORDER BY n DESC, tool || '|' || provider || '|' || model LIMIT 1), hours AS (SELECT hour, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, hour LIMIT 1)
      SELECT sum(tokens)::BIGINT AS total_tokens, {_r2("sum(cost_usd::DECIMAL(38,12))")} AS total_cost_usd, sum(session_count)::BIGINT AS session_count, sum(messages)::BIGINT AS messages, count(*) AS active_days,
      (SELECT coalesce(max(CASE WHEN a <= DATE '2024-01-30' AND b >= DATE '2024-01-30' THEN DATE '2024-01-30' - a + 1 END), 0)::BIGINT FROM runs) AS current_streak, (SELECT max(n) FROM runs) AS longest_streak, (SELECT hour FROM hours) AS peak_hour,
      (SELECT tool FROM models) AS favourite_tool, (SELECT provider FROM models) AS favourite_provider, (SELECT model FROM models) AS favourite_model FROM days""",
    "usage_hour_hist": f"WITH {_events()} SELECT h::INT AS hour, count(event_id) AS messages FROM range(24) t(h) LEFT JOIN ev ON hour = h GROUP BY 1",
    "usage_daily_hours": f"WITH {_events()} SELECT date, h::INT AS hour, count(event_id) AS messages FROM (SELECT DISTINCT date FROM ev) CROSS JOIN range(24) t(h) LEFT JOIN (SELECT date AS d, hour, event_id FROM ev) ON d = date AND hour = h GROUP BY 1, 2",
    "usage_weekday_hist": f"WITH {_events()} SELECT w::INT AS weekday, count(event_id) AS messages FROM range(7) t(w) LEFT JOIN ev ON dayofweek(date::DATE) = w GROUP BY 1",
    "usage_weekly_dense": f"""WITH {_events()}, days AS (SELECT *, date::DATE AS d FROM ({DAILY})), weeks AS (SELECT {WEEK} AS week, sum(tokens) AS tokens, sum(cost_usd::DECIMAL(38,12)) AS cost, sum(session_count) AS session_count, sum(messages) AS messages FROM days WHERE {WEEK} <> DATE '2024-01-14' GROUP BY 1)
      SELECT strftime(g, '%Y-%m-%d') AS week_ending, coalesce(tokens, 0)::BIGINT AS tokens, {_r2("coalesce(cost, 0)")} AS cost_usd, coalesce(session_count, 0)::BIGINT AS session_count, coalesce(messages, 0)::BIGINT AS messages
      FROM (SELECT unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS g FROM weeks) LEFT JOIN weeks ON week = g::DATE""",
    "usage_weekly_by_tool": f"WITH {_events()}, days AS (SELECT *, date::DATE AS d FROM ({_by_day('tool')})) SELECT strftime({WEEK}, '%Y-%m-%d') AS week_ending, tool, {TOKENS}, {SUMS[COST]} FROM days GROUP BY 1, 2",
    "usage_streaks": f"""WITH {_events()}, days AS (SELECT DISTINCT date::DATE AS d FROM ev WHERE dayofweek(date::DATE) <> 3 AND date <> '2024-01-10'), runs AS (SELECT count(*) AS n, min(d) AS a, max(d) AS b FROM (SELECT d, d - row_number() OVER (ORDER BY d)::INT AS run FROM days) GROUP BY run)
      SELECT coalesce(max(CASE WHEN a <= DATE '2024-01-30' AND b >= DATE '2024-01-30' THEN DATE '2024-01-30' - a + 1 END), 0)::BIGINT AS current_streak, max(n) AS longest_streak FROM runs""",
    "usage_period_filter": f"WITH {_events('Asia/Tokyo')} {DAILY.replace('FROM ev', 'FROM ev WHERE date BETWEEN $$2024-01-15$$ AND $$2024-01-20$$')}",
    "usage_allow_deny": _totals("project", "(project IN ('proj1', 'proj2') OR starts_with(project, 'proj3') OR starts_with(project, 'proj4')) AND project <> 'proj2' AND NOT starts_with(project, 'proj4')"),
    "usage_prior_merge": f"""WITH {_events()}, days AS ({DAILY}), gone AS (SELECT date, sum(tokens) AS t, sum(cost_usd::DECIMAL(38,12)) AS c, sum(session_count) AS s FROM ({_by_day('project')}) WHERE project = 'proj0' GROUP BY 1)
      SELECT date, (tokens - coalesce(t, 0))::BIGINT AS tokens, {_r2("cost_usd::DECIMAL(38,12) - coalesce(c, 0)")} AS cost_usd, (session_count - coalesce(s, 0))::BIGINT AS session_count, messages, 'prior' AS src FROM days LEFT JOIN gone USING (date) WHERE date < '2024-01-15'
      UNION ALL SELECT date, tokens, cost_usd, session_count, messages, 'fresh' FROM days WHERE date >= '2024-01-15'""",
    "usage_prior_slots": " UNION ALL ".join(
        f"""SELECT '{slot}' AS slot, {" || '|' || ".join(keys.split(", "))} AS key, {TOKENS}, {SUMS[COST]} FROM (WITH {_events()} {_by_day(slot)}) WHERE {"project <> 'proj0'" if slot == "project" else "true"} GROUP BY {keys}"""
        for slot, (keys, _) in SLOTS.items()
    ),
    "usage_weekly_runs": f"WITH {_events()}, w AS (SELECT *, date::DATE AS d FROM ev) SELECT strftime({WEEK}, '%Y-%m-%d') AS week_ending, tool, {TOKENS}, {COST}, {SESSION_COUNT}, {MESSAGES} FROM w GROUP BY 1, 2",
    "pricing_tiered_cost": f"WITH {LINE_USAGE} SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, round(coalesce(recorded, CASE WHEN rate IS NULL THEN 0.0 ELSE {PRICED} END), 9) AS cost FROM u LEFT JOIN p ON l_partkey = p_partkey",
    "pricing_warnings": f"WITH {LINE_USAGE} SELECT l_partkey::VARCHAR AS model, count(*) AS events, sum(input + output + cache_read + cache_write)::BIGINT AS tokens FROM u WHERE recorded IS NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) AND input > 0 GROUP BY 1",
    "asof_forward_fill": """SELECT event_id, signup_id, signup_value FROM (SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS signup_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS signup_value FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE signup_id IS NOT NULL""",
    "dedup_first_seen": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')",
    "usage_dedup_messages": "SELECT event_id FROM events QUALIFY user_id % 2 <> 0 OR row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) = 1",
    "msgs_indexed": f"WITH {INDEXED} SELECT conv_id, index::INT AS index, role, text FROM m",
    "msgs_page": f"WITH {INDEXED} SELECT conv_id, index::INT AS index, role FROM m WHERE index >= 1 AND index < 3",
    "session_counts": "SELECT conv_id, (count(*) FILTER (WHERE role IN ('user', 'assistant')))::INT AS message_count FROM conversations GROUP BY 1",
    "session_first_prompt": f"SELECT conv_id, {_clean('arg_min(t, turn)')} AS text FROM (SELECT conv_id, turn, {STRIPPED} AS t FROM conversations WHERE role = 'user') WHERE trim(t) <> '' GROUP BY 1",
    "session_closing": r"""SELECT conv_id, substr(trim(coalesce(arg_max(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '')), 1, 500) AS closing_user,
      substr(trim(regexp_replace(array_to_string(list_filter(string_split(coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND trim(text) <> ''), ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*★\s*Insight\s*─*\s*$') AND NOT regexp_matches(x, '^\s*─{5,}\s*$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')), 1, 500) AS closing_assistant
      FROM conversations GROUP BY 1""",
    "clean_text": f"SELECT page_id, {_clean('html')} AS text FROM pages",
    "match_context": """SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(replace(substr(text, a + 1, b - a), chr(10), ' ')) || CASE WHEN b < length(text) THEN '…' ELSE '' END AS snippet
      FROM (SELECT doc_id, text, greatest(0, hit - 30) AS a, least(length(text), hit + 77) AS b FROM (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS hit FROM documents) WHERE hit >= 0)""",
    "content_match": "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')",
    "session_display": f"""WITH {SESSION}, x AS (SELECT *, DATE '1998-08-02' - date::DATE AS age_days FROM s) SELECT file_path, first_prompt AS display_text, regexp_extract(cwd, '[^/]+$') AS folder,
      CASE WHEN age_days <= 0 THEN 'today' WHEN age_days = 1 THEN 'yesterday' WHEN age_days < 7 THEN age_days || 'd' WHEN age_days < 30 THEN (age_days // 7) || 'w' ELSE date END AS age,
      'cd "' || cwd || '"' || CASE WHEN tool = '1-URGENT' THEN ' && claude --resume ' || file_path ELSE '' END AS resume FROM x""",
    "session_recent": f"WITH {SESSION} SELECT file_path, date, cwd, tool FROM s ORDER BY date DESC, file_path LIMIT 50",
    "session_scoped": f"WITH {SESSION} SELECT file_path, created_at, cwd, tool FROM s WHERE tool = '1-URGENT' AND (cwd = '/EUROPE' OR starts_with(cwd, '/EUROPE/')) AND errored",
    "session_range": f"WITH {SESSION} SELECT file_path, created_at, cwd, tool FROM s WHERE created_at >= '1995-01-01' AND created_at <= '1995-01-31'",
    "digest_compact": f"""{RANGED}, tools AS (SELECT created_at, cwd, string_agg(tool, '|' ORDER BY o) AS tools FROM (SELECT created_at, cwd, tool, min(file_path) AS o FROM r GROUP BY ALL) GROUP BY 1, 2),
      topics AS (SELECT created_at, cwd, string_agg(t, '|' ORDER BY o) AS topics FROM (SELECT created_at, cwd, first_prompt AS t, min(file_path) AS o FROM r WHERE first_prompt <> '' GROUP BY created_at, cwd, first_prompt QUALIFY row_number() OVER (PARTITION BY created_at, cwd ORDER BY o) <= 10) GROUP BY 1, 2),
      paths AS (SELECT created_at, cwd, string_agg(file_path, '|' ORDER BY file_path) AS file_paths FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY created_at, cwd ORDER BY file_path DESC) <= 5) GROUP BY 1, 2)
      SELECT created_at, cwd, count(*) AS session_count, sum(message_count)::BIGINT AS messages, any_value(tools) AS tools, any_value(topics) AS topics, any_value(file_paths) AS file_paths FROM r JOIN tools USING (created_at, cwd) JOIN topics USING (created_at, cwd) JOIN paths USING (created_at, cwd) GROUP BY 1, 2""",
    "digest_details": f"{RANGED} SELECT created_at, cwd, file_path, message_count, row_number() OVER (PARTITION BY created_at, cwd ORDER BY message_count DESC, file_path)::INT AS rank FROM r WHERE message_count > 3 QUALIFY rank <= 10",
    "digest_totals": f"{RANGED} SELECT count(*) AS session_count, sum(message_count)::BIGINT AS messages, count(DISTINCT cwd) AS projects FROM r",
    "metrics_totals": f"{RANGED} SELECT count(*) AS session_count, sum(message_count)::BIGINT AS messages FROM r",
    **{f"metrics_{n}": f"{RANGED} SELECT {c}, count(*) AS session_count, sum(message_count)::BIGINT AS messages FROM r GROUP BY 1" for n, c in (("tool", "tool"), ("project", "cwd"), ("daily", "created_at"))},
    "metrics_hours": "SELECT strftime(ts, '%H') AS hour, count(*) AS session_count FROM (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1) GROUP BY 1",
    "session_scores": f"WITH {SCORED} SELECT file_path, round(score, 6) AS score, trivial FROM scored",
    "primer_recent": f"{PRIMER} SELECT file_path, round(score, 6) AS score FROM best",
    "primer_headlines": f"{PRIMER} SELECT file_path, created_at FROM scope WHERE file_path NOT IN (SELECT file_path FROM best) ORDER BY created_at DESC, date DESC, file_path LIMIT 40",
    "search_stemmed_top": rf"""WITH c AS (SELECT doc_id, unnest([10.0, 3.0, 5.0])::DOUBLE AS w, unnest([split_part(text, chr(10), 1), text, source]) AS t FROM documents),
      k AS (SELECT doc_id, w, list_transform(list_filter(regexp_split_to_array(coalesce(t, ''), '{NOT_WORD}'), lambda x: x <> ''), lambda x: {_stem("lower(strip_accents(x))")}) AS words FROM c),
      size AS (SELECT doc_id, sum(len(words)) AS n FROM k GROUP BY 1 HAVING n > 0), corpus AS (SELECT (SELECT count(*) FROM documents) AS docs, sum(n) AS tokens FROM size),
      hit AS (SELECT doc_id, 'licens' AS q, w * len(list_filter(words, lambda x: x = 'licens')) AS tf FROM k UNION ALL SELECT doc_id, 'public', w * len(list_filter(words, lambda x: x = 'public')) FROM k
        UNION ALL SELECT doc_id, 'version 2', w * len(list_filter(range(1, len(words)), lambda i: words[i] = 'version' AND words[i + 1] = '2')) FROM k),
      tf AS (SELECT doc_id, q, sum(tf) AS tf FROM hit GROUP BY 1, 2 HAVING sum(tf) > 0), df AS (SELECT q, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN corpus GROUP BY 1)
      SELECT doc_id, round(-sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (tokens / docs)))), 6) AS score FROM tf JOIN df USING (q) JOIN size USING (doc_id) CROSS JOIN corpus GROUP BY 1 ORDER BY score, doc_id LIMIT 20""",
    "pricing_fuzzy_match": r"""WITH m AS (SELECT DISTINCT 'eu/' || lower(p_brand) || '-2024' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '01' AS model FROM part), k AS (SELECT DISTINCT lower(p_brand) AS key FROM part),
      hit AS (SELECT model, key FROM m JOIN k ON regexp_matches(model, '(^|[^A-Za-z0-9])' || regexp_escape(key) || '($|[-.][0-9]{8}($|[^A-Za-z0-9])|[^A-Za-z0-9.-]|[-.]($|[^0-9]))'))
      SELECT model, arg_min(key, (-length(key), key)) AS key FROM m LEFT JOIN hit USING (model) GROUP BY 1""",
    "search_bm25": rf"""WITH c AS (SELECT doc_id, unnest([10.0, 3.0, 5.0])::DOUBLE AS w, unnest([split_part(text, chr(10), 1), text, source]) AS t FROM documents),
      k AS (SELECT doc_id, w, list_filter(regexp_split_to_array(coalesce(t, ''), '{NOT_WORD}'), lambda x: x <> '') AS words FROM c),
      size AS (SELECT doc_id, sum(len(words)) AS n FROM k GROUP BY 1 HAVING n > 0), corpus AS (SELECT (SELECT count(*) FROM documents) AS docs, sum(n) AS tokens FROM size),
      tf AS (SELECT doc_id, q, sum(w * len(list_filter(words, lambda x: lower(x) = q))) AS tf FROM k CROSS JOIN (VALUES ('licensed'), ('apache'), ('src3')) v(q) GROUP BY 1, 2 HAVING tf > 0),
      df AS (SELECT q, count(*) AS df, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN corpus GROUP BY 1)
      SELECT doc_id, round(-sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (tokens / docs)))), 6) AS score FROM tf JOIN df USING (q) JOIN size USING (doc_id) CROSS JOIN corpus GROUP BY 1""",
    "files_union": """SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: (list_position(w, x), x))), lambda p: p[2]), ' ') AS files FROM (SELECT doc_id, flatten(list_transform(list_filter(l, lambda x, i: i % 2 = 1), lambda x: string_split(x, ' '))) || flatten(list_transform(list_filter(l, lambda x, i: i % 2 = 0), lambda x: string_split(x, ' '))) AS w
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""",
    "lines_to_session": f"""WITH c AS (SELECT *, strftime(DATE '2024-03-01' + (conv_id % 40 + turn)::INT, '%Y-%m-%d') AS day, {STRIPPED} AS t FROM conversations)
      SELECT conv_id::VARCHAR AS session_id, '/w/' || any_value(conv_id % 5) AS cwd, arg_min(day, turn) AS created_at, arg_max(day, turn) AS date, coalesce({_clean("arg_min(t, turn) FILTER (WHERE role = 'user' AND trim(t) <> '')")}, '') AS first_prompt,
      (count(*) FILTER (WHERE role IN ('user', 'assistant')))::INT AS message_count, substr(trim(coalesce(arg_max(t, turn) FILTER (WHERE role = 'user' AND trim(t) <> ''), '')), 1, 500) AS closing_user, (count(*) FILTER (WHERE turn % 9 = 4))::INT AS error_count,
      coalesce((SELECT string_agg(x, '|' ORDER BY o) FROM (SELECT 'run ' || (turn % 2) AS x, min(turn) AS o FROM conversations d WHERE d.conv_id = c.conv_id AND role = 'assistant' AND turn % 3 = 0 GROUP BY 1)), '') AS commands FROM c GROUP BY conv_id""",
    "lines_to_messages": f"SELECT conv_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS index, role, CASE WHEN role = 'user' THEN {STRIPPED} ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(CASE WHEN role = 'user' THEN {STRIPPED} ELSE text END) <> ''",
    "lines_to_usage": """SELECT 's' || user_id AS session_id, 'model-' || (user_id % 3) AS model, 'repo' || (user_id % 4) AS project, k AS input, k * 2 AS output, k * 3 AS cache_read, k + 7 AS cache_write, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
      FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) QUALIFY event_id % 5 = 0 OR row_number() OVER (PARTITION BY event_id % 5 = 0, event_id // 4, event_id // 2 ORDER BY event_id) = 1""",
    "lines_asof_model": """SELECT session_id, model, CASE WHEN substr(session_id, 2)::BIGINT % 2 = 0 THEN 'even' ELSE 'unknown' END AS project, count(*) AS events, sum(10)::BIGINT AS input, sum(k)::BIGINT AS cache_read FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k,
      's' || last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS session_id, 'g' || last_value(CASE WHEN event_type = 'view' THEN event_id % 3 END IGNORE NULLS) OVER w AS model FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE event_type NOT IN ('signup', 'view') AND session_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2, 3""",
    "lines_scan": """SELECT conv_id::VARCHAR AS session_id, arg_max(strftime(DATE '2024-03-01' + (conv_id % 40 + turn)::INT, '%Y-%m-%d'), turn) AS date, (count(*) FILTER (WHERE role IN ('user', 'assistant')))::INT AS message_count
      FROM conversations GROUP BY 1 HAVING contains(lower(string_agg(CASE WHEN role = 'user' THEN text END, chr(10))), 'the')""",
    "anti_removed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "change_gate": "SELECT doc_id FROM documents WHERE doc_id % 7 = 0",
}


def _log_sessions() -> str:
    day, tool = "strftime(DATE '2024-03-01' + (conv_id % 40 + turn)::INT, '%Y-%m-%d')", "conv_id % 3"
    user, assistant, system = "role = 'user'", "role = 'assistant'", "role NOT IN ('user', 'assistant')"

    def seen(value: str, which: str, sep: str = "|", limit: int = 50) -> str:
        """Distinct values in the order in which they come first."""
        return f"coalesce((SELECT string_agg(x, '{sep}' ORDER BY o) FROM (SELECT {value} AS x, min(turn) AS o FROM t d WHERE d.conv_id = t.conv_id AND {which} GROUP BY 1 ORDER BY o LIMIT {limit})), '')"

    def told(value: str, which: str, limit: int) -> str:
        return f"coalesce((SELECT string_agg(x, chr(10) ORDER BY turn) FROM (SELECT {value} AS x, turn FROM t d WHERE d.conv_id = t.conv_id AND {which} ORDER BY turn LIMIT {limit})), '')"

    words = f"coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE genuine), '')"
    helped = f"coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE {user} AND trim(t) <> ''), '')"
    return rf"""WITH t AS (SELECT conv_id, turn, role, {tool} AS k, coalesce({STRIPPED}, '') AS t, {day} AS day, {user} AND trim(coalesce({STRIPPED}, '')) <> '' AND ({tool} > 0 OR turn % 4 <> 2) AS genuine, {tool} = 0 OR {user} OR {assistant} AS x FROM conversations),
      s AS (SELECT CASE k WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'pi' END AS tool, conv_id::VARCHAR AS session_id, CASE k WHEN 0 THEN CASE WHEN conv_id % 7 = 0 THEN '/w/.claude/worktrees/x' ELSE '/w/p' || (conv_id % 5) END WHEN 1 THEN '/w/c' ELSE '/w/pi' END AS cwd,
      CASE k WHEN 0 THEN 'b' || (arg_max(turn, turn) FILTER (WHERE {user}) % 2) WHEN 1 THEN 'cb' || (conv_id % 4) ELSE '' END AS branch, coalesce({_clean("arg_min(t, turn) FILTER (WHERE genuine)")}, '') AS first_prompt,
      CASE k WHEN 0 THEN coalesce('title ' || (max(turn) FILTER (WHERE {system})), '') ELSE '' END AS custom_title, CASE k WHEN 1 THEN '2024-02-01' ELSE coalesce(arg_min(day, turn) FILTER (WHERE {user} OR {assistant}), '?') END AS created_at,
      coalesce(arg_max(day, turn) FILTER (WHERE {user} OR {assistant}), CASE k WHEN 1 THEN '2024-02-01' ELSE '?' END) AS date, (count(*) FILTER (WHERE {user} OR {assistant} AND k <> 1))::INT AS message_count,
      CASE k WHEN 0 THEN {seen("'/f' || (turn % 3)", assistant)} WHEN 1 THEN {seen("'n' || (turn % 2) || '.py'", system)} ELSE '' END AS files_touched, CASE k WHEN 0 THEN {seen("'/r' || turn", assistant)} ELSE '' END AS files_read,
      CASE k WHEN 0 THEN '' WHEN 1 THEN {seen("'run ' || (turn % 2)", assistant)} ELSE {seen(f"CASE WHEN {assistant} THEN 'make ' || (turn % 2) ELSE 'ls' END", f"NOT {user}")} END AS commands,
      CASE k WHEN 0 THEN 0 WHEN 1 THEN (count(*) FILTER (WHERE {assistant} AND turn % 3 <> 0))::INT ELSE (count(*) FILTER (WHERE {assistant} AND turn % 5 = 1 OR {system} AND turn % 2 = 1))::INT END AS error_count,
      substr(trim(coalesce(arg_max(t, turn) FILTER (WHERE genuine), '')), 1, 500) AS closing_user, CASE k WHEN 0 THEN substr({told("'t' || turn", assistant, 100000)}, 1, 20000) ELSE '' END AS thinking,
      CASE k WHEN 0 THEN '' WHEN 1 THEN {told("'bad ' || turn", f"{assistant} AND turn % 3 <> 0", 20)} ELSE {told(f"CASE WHEN {assistant} THEN 'failed ' || turn ELSE 'out' END", f"({assistant} AND turn % 5 = 1 OR {system} AND turn % 2 = 1)", 20)} END AS context_text,
      md5({words} || CASE WHEN conv_id % 6 = 0 AND {helped} <> '' THEN CASE WHEN {words} = '' THEN '' ELSE chr(10) END || {helped} ELSE '' END) AS said, k = 0 AND (conv_id % 7 = 0 OR NOT bool_or({user})) AS out FROM t GROUP BY conv_id, k)
      SELECT * EXCLUDE (out), error_count > 0 AS errored FROM s WHERE NOT out"""


SQL["logs_sessions"] = _log_sessions()
SQL["logs_lines"] = """WITH every AS (SELECT conv_id, turn * 4 AS spot, CASE conv_id % 3 WHEN 0 THEN CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'custom-title' END WHEN 1 THEN CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'event_msg' ELSE 'response_item' END ELSE 'message' END AS kind FROM conversations
    UNION ALL SELECT conv_id, turn * 4 + 1, NULL FROM conversations WHERE turn % 5 = 4 UNION ALL SELECT DISTINCT conv_id, -1, CASE conv_id % 3 WHEN 1 THEN 'session_meta' ELSE 'session' END FROM conversations WHERE conv_id % 3 > 0)
  SELECT * FROM (SELECT CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'pi' END AS tool, conv_id::VARCHAR AS session_id, (row_number() OVER w - 1)::INT AS line_no, (count(*) OVER (PARTITION BY conv_id))::INT AS n_lines, kind FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY spot)) WHERE kind IS NOT NULL"""
SQL["logs_usage"] = """WITH e AS (SELECT event_id AS n, user_id, event_type, (props->>'$.k')::BIGINT AS k, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN event_type = 'view' THEN event_id % 3 END IGNORE NULLS) OVER w AS g
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  u AS (SELECT 'codex' AS tool, 'openai' AS provider, 'g' || g AS model, s, 10 AS input, k AS output, k AS cache_read, NULL::DOUBLE AS cost FROM e WHERE user_id % 2 = 0 AND event_type NOT IN ('signup', 'view') AND g IS NOT NULL
    UNION ALL SELECT 'pi', 'v' || (user_id % 3), 'm' || (n % 4), s, k, 2 * k, CASE WHEN n % 3 = 0 THEN k ELSE 0 END, CASE WHEN n % 5 = 0 THEN n % 100 END FROM e WHERE user_id % 2 = 1 AND event_type NOT IN ('signup', 'view'))
  SELECT tool, provider, model, 's' || s AS session_id, CASE WHEN s % 2 = 0 THEN 'even' ELSE 'unknown' END AS project, count(*) AS events, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cost) AS cost_usd FROM u WHERE s IS NOT NULL GROUP BY 1, 2, 3, s"""
SQL["asof_blocks"] = "SELECT event_id, event_type, last_value(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM events"


def _stems() -> str:
    """Porter's algorithm step by step over every word, by patterns of vowels (V) and consonants (C)."""

    def form(x: str) -> str:
        out = f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '^y', 'C')"
        for _ in range(3):  # of several y in a row, each depends on the one before
            out = f"regexp_replace(regexp_replace({out}, 'Vy', 'VC', 'g'), '([^Vy])y', '\\1V', 'g')"
        return f"regexp_replace({out}, '[^V]', 'C', 'g')"

    def cut(x: str, n: int) -> str:
        return f"substr({x}, 1, length({x}) - {n})"

    def measure(n: int) -> str:
        return f"len(regexp_extract_all({cut('f', n)}, 'V+C+'))"

    def short(n: int) -> str:
        return f"(regexp_matches({cut('f', n)}, 'CVC$') AND NOT regexp_matches({cut('w', n)}, '[wxy]$'))"

    def mended(n: int) -> str:
        base, double = cut("w", n), f"(regexp_matches({cut('f', n)}, 'CC$') AND right({cut('w', n)}, 1) = substr({cut('w', n)}, -2, 1))"
        return f"CASE WHEN regexp_matches({base}, '(at|bl|iz)$') THEN {base} || 'e' WHEN {double} AND NOT regexp_matches({base}, '[lsz]$') THEN {cut('w', n + 1)} WHEN {measure(n)} = 1 AND {short(n)} THEN {base} || 'e' ELSE {base} END"

    def longest(pairs, least: int, more=lambda s: "true") -> str:
        whens = (f"WHEN w LIKE '%{x}' THEN CASE WHEN {measure(len(x))} > {least} AND {more(x)} THEN {cut('w', len(x))} || '{y}' ELSE w END" for x, y in sorted(pairs, key=lambda p: -len(p[0])))
        return f"CASE {' '.join(whens)} ELSE w END"

    steps = [
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' AND length(w) > 3 THEN {cut('w', 2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut('w', 1)} ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(3)} > 0 THEN {cut('w', 1)} ELSE w END WHEN w LIKE '%ed' AND contains({cut('f', 2)}, 'V') THEN {mended(2)} WHEN w LIKE '%ing' AND contains({cut('f', 3)}, 'V') THEN {mended(3)} ELSE w END",
        f"CASE WHEN w LIKE '%y' AND contains({cut('f', 1)}, 'V') THEN {cut('w', 1)} || 'i' ELSE w END",
        longest(STEP2, 0), longest(STEP3, 0),
        longest([(x, "") for x in STEP4], 1, lambda x: f"regexp_matches({cut('w', 3)}, '[st]$')" if x == "ion" else "true"),
        f"CASE WHEN w LIKE '%e' AND ({measure(1)} > 1 OR {measure(1)} = 1 AND NOT {short(1)}) THEN {cut('w', 1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {measure(1)} > 1 THEN {cut('w', 1)} ELSE w END",
    ]
    chain = [f"s0 AS (SELECT term, documents, term AS w, {form('term')} AS f FROM word)"]
    for i, step in enumerate(steps):
        chain.append(f"t{i} AS (SELECT term, documents, CASE WHEN length(term) BETWEEN 3 AND 64 THEN {step} ELSE w END AS w FROM s{i}), s{i + 1} AS (SELECT *, {form('w')} AS f FROM t{i})")
    words = f"list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '{NOT_WORD}'), lambda x: x <> ''), lambda x: lower(x)))"
    return f"WITH word AS (SELECT term, count(*) AS documents FROM (SELECT unnest({words}) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]+') GROUP BY 1), {', '.join(chain)} SELECT term, w AS stem, documents FROM s{len(steps)}"


SQL["search_terms"] = _stems()
_WORD = NOT_WORD.replace("[^", "[")
SQL["search_snippets"] = rf"""WITH best AS (SELECT doc_id FROM ({SQL['search_bm25'].replace("('licensed'), ('apache'), ('src3')", "('licensed')")}) ORDER BY score, doc_id LIMIT 20),
  d AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w, regexp_split_to_array(text, '{_WORD}') AS gap FROM documents SEMI JOIN best USING (doc_id)),
  n AS (SELECT *, len(w) AS n, list_filter(range(0, len(w)), lambda i: lower(w[i + 1]) = 'licensed') AS hits, list_filter(range(0, len(w)), lambda i: i = 0 OR regexp_matches(gap[i + 1], '[.:][ 	

]+$')) AS starts FROM d),
  h AS (SELECT *, unnest(hits) AS spot FROM n), s AS (SELECT *, list_max(list_filter(starts, lambda i: i <= spot)) AS sentence FROM h),
  c AS (SELECT doc_id, w, gap, n, hits, spot AS begin, spot, 0 AS kind, 0 AS bonus FROM s UNION ALL SELECT doc_id, w, gap, n, hits, sentence, spot, 1, CASE WHEN sentence = 0 THEN 120 ELSE 100 END FROM s WHERE n > 32 AND sentence < spot),
  v AS (SELECT *, list_filter(hits, lambda i: i >= begin AND i < begin + 32) AS inside FROM c),
  x AS (SELECT *, CASE WHEN len(inside) > 0 THEN 999 + len(inside) ELSE 0 END + bonus AS worth, CASE WHEN kind = 1 THEN begin ELSE greatest(0, least(inside[1] - trunc((32 - (inside[len(inside)] + 1 - inside[1])) / 2)::BIGINT, n - 32)) END AS start FROM v),
  b AS (SELECT *, least(n, start + 32) AS stop FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, spot, kind) = 1)
  SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE gap[1] END || array_to_string(list_transform(range(start + 1, stop + 1), lambda i: CASE WHEN i = start + 1 THEN '' ELSE gap[i] END || w[i]), '') || CASE WHEN stop < n THEN '…' ELSE gap[n + 1] END AS snippet FROM b"""


def _name_index() -> str:
    def holds(a: str, b: str) -> str:
        digit = f"CASE WHEN regexp_matches({b}, '[0-9]$') THEN '($|[-.][0-9]{{8}}($|[^A-Za-z0-9])|[^A-Za-z0-9.-]|[-.]($|[^0-9]))' ELSE '($|[^A-Za-z0-9])' END"
        return f"regexp_matches({a}, '(^|[^A-Za-z0-9])' || regexp_escape({b}) || {digit})"

    plain = "lower(translate({}, '.@', '--'))"
    either = " OR ".join((holds("model", "key"), holds("key", "model"), holds("pm", "pk"), holds("pk", "pm")))
    return f"""WITH m AS (SELECT *, {plain.format('model')} AS pm FROM (SELECT DISTINCT unnest([p_brand || '.' || (p_size % 9), 'EU/' || translate(p_name, ' ', '.') || '@2024010' || (p_size % 9), lower(p_type) || '/' || lower(p_brand) || '/' || p_size, split_part(p_name, ' ', 1)]) AS model FROM part)),
      k AS (SELECT *, {plain.format('key')} AS pk FROM (SELECT DISTINCT unnest([translate(p_name, ' ', '-'), 'x/' || lower(p_brand) || '@' || (p_size % 9), lower(p_type) || '-' || split_part(lower(p_brand), '#', 2), p_brand || '/' || p_size]) AS key FROM part)),
      hit AS (SELECT model, arg_min(key, (-length(key), key)) AS key FROM m JOIN k ON contains(pm, pk) OR contains(pk, pm) WHERE {either} GROUP BY 1)
      SELECT model, CASE WHEN model IN (SELECT key FROM k) THEN model ELSE hit.key END AS key FROM m LEFT JOIN hit USING (model)"""


SQL["pricing_name_index"] = _name_index()
SQL["usage_period_filter"] = SQL["usage_period_filter"].replace("$$", "'")
SQL["usage_bitmap_sets"] = SQL["usage_grouping_sets"]
