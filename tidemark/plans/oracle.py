"""SQL of the registered queries, for DuckDB: written from the definitions, not from the plans."""

from __future__ import annotations

from tidemark.functions.text import SALIENCE
from tidemark.operators.activity import GAP_CAP_US
from tidemark.sources import bindings as B

WIDE = 21_600_000_000
_WEEK = 7 * 86_400_000_000


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


W2 = [(k, s, u, i) for i, (k, s, u) in enumerate(B.WINDOWS)]
W4 = [(f"w{i}", B.WINDOWS[1][2] - _WEEK * (4 - i), B.WINDOWS[1][2] - _WEEK * (3 - i), i) for i in range(4)]
_PROJECTS = ["stock-dashboard", "blog-site", "acme-web", "data-pipeline", "playground", "acme-core", "acme-web", "acme-web"]
_AREAS = {"stock-dashboard": "investment", "blog-site": "writing", "data-pipeline": "coding", "playground": "other"}


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ACTIVITY = f"""activity AS (
  SELECT event_id, {_case("user_id % 3", ["agent_a", "agent_b", "agent_c"])} AS agent,
    'u' || user_id || '-' || isoyear(ts) || 'W' || weekofyear(ts) AS session_id, epoch_us(ts) AS ts_us, user_id,
    event_type IN ('click', 'purchase') AS is_real_user, {_case("user_id % 8", B.FOLDERS)} AS project_raw, {_case("user_id % 8", _PROJECTS)} AS project
  FROM events)"""


def intervals(cap: int = GAP_CAP_US) -> str:
    return f"""intervals AS (
  SELECT * FROM (SELECT agent, session_id, user_id, project, ts_us AS start_us,
      CASE WHEN lead(ts_us) OVER s IS NOT NULL THEN least(lead(ts_us) OVER s, ts_us + {cap}) END AS end_us FROM activity WINDOW s AS (PARTITION BY agent, session_id ORDER BY ts_us))
  WHERE end_us > start_us)"""


def windows(rows=W2) -> str:
    return f"windows(window_key, since_us, until_us, ord) AS (VALUES {_values(rows)})"


CLIPPED = """clipped AS (
  SELECT w.window_key, i.agent, i.session_id, i.project, greatest(i.start_us, w.since_us) AS start_us, least(i.end_us, w.until_us) AS end_us
  FROM intervals i JOIN windows w ON i.start_us < w.until_us AND i.end_us > w.since_us)"""


def totals(key: str = "window_key") -> str:
    return f"""walls AS (
  SELECT {key}, sum(greatest(0, end_us - greatest(start_us, coalesce(before, start_us)))) AS wall_us, sum(end_us - start_us) AS raw_us FROM (
    SELECT *, max(end_us) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM clipped)
  GROUP BY ALL),
totals AS (SELECT {key}, CAST(raw_us AS BIGINT) AS raw_us, CAST(wall_us AS BIGINT) AS wall_us,
  CASE WHEN wall_us > 0 THEN CAST(raw_us AS DOUBLE) / CAST(wall_us AS DOUBLE) ELSE 1.0 END AS parallelism FROM walls)"""


def sessions(cap: int = GAP_CAP_US) -> str:
    return f"""sessions AS (
  SELECT agent, session_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS msg_count, CAST(sum(CAST(is_real_user AS INT)) AS BIGINT) AS user_msg_count,
    CAST(coalesce(sum(gap), 0) AS BIGINT) AS active_us, min(project_raw) AS project_raw, min(project) AS project, min(user_id) AS user_id FROM (
    SELECT *, CASE WHEN lead(ts_us) OVER s IS NOT NULL THEN least(lead(ts_us) OVER s - ts_us, {cap}) END AS gap FROM activity WINDOW s AS (PARTITION BY agent, session_id ORDER BY ts_us))
  GROUP BY agent, session_id),
engagement AS (SELECT *, user_msg_count >= 2 OR (user_msg_count = 1 AND active_us >= 60000000) AS engaged FROM sessions)"""


SLICES = f"""slices AS (
  SELECT coalesce(i.window_key, e.window_key) AS window_key, coalesce(i.agent, e.agent) AS agent, coalesce(i.session_id, e.session_id) AS session_id,
    least(i.a, e.a) AS start_us, greatest(i.b, e.b) AS end_us, CAST(coalesce(i.us, 0) AS BIGINT) AS active_us, coalesce(e.n, 0) AS msg_count, CAST(coalesce(e.u, 0) AS BIGINT) AS user_msg_count
  FROM (SELECT window_key, agent, session_id, sum(end_us - start_us) AS us, min(start_us) AS a, max(end_us) AS b FROM clipped GROUP BY ALL) i
  FULL JOIN (SELECT w.window_key, agent, session_id, count(*) AS n, sum(CAST(is_real_user AS INT)) AS u, min(ts_us) AS a, max(ts_us) AS b
    FROM activity JOIN windows w ON ts_us >= since_us AND ts_us < until_us GROUP BY ALL) e
  ON i.window_key = e.window_key AND i.agent = e.agent AND i.session_id = e.session_id),
placed AS (SELECT s.*, m.engaged, m.project, m.project_raw, {" ".join(["CASE m.project", *[f"WHEN '{p}' THEN '{a}'" for p, a in _AREAS.items()], "ELSE 'coding' END"])} AS area,
    m.start_us >= w.since_us AND m.end_us < w.until_us AS contained
  FROM slices s JOIN engagement m ON s.agent = m.agent AND s.session_id = m.session_id JOIN windows w ON w.window_key = s.window_key)"""


def base(rows=W2, cap: int = GAP_CAP_US) -> str:
    return "WITH " + ",\n".join([windows(rows), ACTIVITY, intervals(cap), CLIPPED, totals(), sessions(cap), SLICES])


ROLLUP = """rollup_rows AS (
  SELECT p.window_key, area, CASE WHEN grouping(project) = 0 THEN project END AS project, grouping(project) = 1 AS is_area, CAST(sum(active_us) AS BIGINT) AS active_us,
    CASE WHEN any_value(t.raw_us) > 0 THEN CAST(sum(active_us) AS DOUBLE) * CAST(any_value(t.wall_us) AS DOUBLE) / CAST(any_value(t.raw_us) AS DOUBLE) ELSE CAST(sum(active_us) AS DOUBLE) END / 60000000.0 AS minutes,
    count(*) AS sessions, CAST(sum(msg_count) AS BIGINT) AS messages
  FROM placed p LEFT JOIN totals t ON t.window_key = p.window_key GROUP BY GROUPING SETS ((p.window_key, area), (p.window_key, area, project)))"""


def rollup(rows=W2) -> str:
    return base(rows) + ",\n" + ROLLUP


def _usd(micro: str) -> str:
    """Millionths of a dollar, exact, as dollars rounded once to six decimals."""
    return f"CAST(round({micro}, 0) AS DOUBLE) / 1000000.0::DOUBLE"


def usage(rows=W2) -> str:
    rates = {"opus-x": B.FAMILY_PRICES["opus"], "sonnet-y": B.USER_PRICES["sonnet-y"], "haiku-z": B.LISTED_PRICES["haiku-z"]}
    return f"""{windows(rows)},
raw_usage AS (SELECT {_case("user_id % 3", ["agent_a", "agent_b", "agent_c"])} AS agent, epoch_us(ts) AS ts_us, event_id, {_case("event_id % 4", ["opus-x", "sonnet-y", "haiku-z", "mystery-1"])} AS model,
    CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 2 END AS message_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS output_tokens
  FROM events WHERE event_type IN ('view', 'error')),
windowed AS (SELECT w.window_key, u.*, row_number() OVER (PARTITION BY w.window_key, message_id ORDER BY ts_us, event_id) AS rn FROM raw_usage u JOIN windows w ON ts_us BETWEEN since_us AND until_us),
used AS (SELECT * FROM windowed WHERE message_id IS NULL OR rn = 1),
by_model AS (SELECT window_key, model, count(*) AS turns, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(2 * k) AS BIGINT) AS cache_creation, CAST(sum(10 * k) AS BIGINT) AS cache_read, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM used GROUP BY ALL),
rates AS (SELECT model, {", ".join(f"CAST({c} AS DECIMAL(10,6)) AS {c}" for c in ("inp", "outp", "cw", "cr"))} FROM (VALUES {_values([(m, *map(float, r)) for m, r in rates.items()])}) v(model, inp, outp, cw, cr)),
costed AS (SELECT m.*, r.model IS NOT NULL AS priced,
    input_tokens * coalesce(inp, 0) + m.output_tokens * coalesce(outp, 0) + cache_creation * coalesce(cw, 0) + cache_read * coalesce(cr, 0) AS cost_micro,
    (input_tokens + cache_creation + cache_read) * coalesce(inp, 0) + m.output_tokens * coalesce(outp, 0) AS plain_micro
  FROM by_model m LEFT JOIN rates r ON r.model = m.model),
usage_sums AS (SELECT window_key, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(cache_read) AS BIGINT) AS cache_read,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(turns) AS BIGINT) AS turns, sum(cost_micro) AS cost, sum(plain_micro) AS plain,
    coalesce(string_agg(CASE WHEN NOT priced THEN model END, ',' ORDER BY model), '') AS unpriced_models FROM costed GROUP BY window_key)"""


_GOALS = [(g["id"], p, g.get("valid_from"), g.get("valid_until")) for g in B.GOALS for p in {dict(B.ALIASES).get(x, x): 1 for x in g["projects"]}]
_ZONE_US = -5 * 3_600_000_000  # the zone's winter offset; events are in January


def goals(rows=W2) -> str:
    every = [(g["id"], g.get("valid_from"), g.get("valid_until")) for g in B.GOALS]
    return base(rows) + f""",
goal_projects(goal_id, project, vf, vu) AS (VALUES {_values(_GOALS)}),
goal_list(goal_id, vf, vu) AS (VALUES {_values(every)}),
pieces AS (SELECT window_key, project, d, greatest(start_us + {_ZONE_US}, d * 86400000000) AS a, least(end_us + {_ZONE_US}, (d + 1) * 86400000000) AS b
  FROM (SELECT *, unnest(range((start_us + {_ZONE_US}) // 86400000000, (end_us + {_ZONE_US} - 1) // 86400000000 + 1)) AS d FROM clipped)),
days AS (SELECT window_key, project, DATE '1970-01-01' + CAST(d AS INT) AS local_date, sum(b - a) AS amount FROM pieces WHERE b > a GROUP BY ALL),
met AS (SELECT days.*, g.goal_id, count(g.goal_id) OVER (PARTITION BY window_key, days.project, local_date) AS n FROM days LEFT JOIN goal_projects g ON g.project = days.project
  AND (g.vf IS NULL OR local_date >= CAST(g.vf AS DATE)) AND (g.vu IS NULL OR local_date <= CAST(g.vu AS DATE))),
per_goal AS (SELECT window_key, goal_id, sum(CASE WHEN n = 1 THEN amount ELSE 0 END) AS ex, sum(CASE WHEN n > 1 THEN amount ELSE 0 END) AS sh, string_agg(DISTINCT project, ',' ORDER BY project) AS touched, max(local_date) AS latest FROM met WHERE goal_id IS NOT NULL GROUP BY ALL),
goal_rows AS (SELECT w.window_key, g.goal_id, CAST(coalesce(ex, 0) AS BIGINT) AS exclusive_us, CAST(coalesce(sh, 0) AS BIGINT) AS shared_us, coalesce(touched, '') AS touched_projects, latest AS latest_date
  FROM windows w JOIN goal_list g ON coalesce(CAST(g.vf AS DATE), DATE '0001-01-01') <= CAST(make_timestamp(until_us - 1 + {_ZONE_US}) AS DATE) AND coalesce(CAST(g.vu AS DATE), DATE '9999-12-31') >= CAST(make_timestamp(since_us + {_ZONE_US}) AS DATE)
  LEFT JOIN per_goal p ON p.window_key = w.window_key AND p.goal_id = g.goal_id)"""


SNAPSHOTS = """lines AS (SELECT 'b' || l_orderkey AS branch, l_linenumber, epoch_us(l_shipdate) AS ts_us, CAST(l_partkey AS BIGINT) AS p,
    sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM lineitem),
held AS (SELECT *, CASE WHEN l_linenumber % 6 = 0 THEN 0 ELSE CAST(total AS BIGINT) END AS h, CASE WHEN p % 3 = 0 THEN 'unknown' ELSE 'm1' END AS m FROM lines),
snaps AS (SELECT branch, ts_us, h, CASE WHEN bool_or(m <> 'unknown') THEN 'm1' ELSE 'unknown' END AS model FROM held GROUP BY ALL),
deltas AS (SELECT *, greatest(0, h - coalesce(lag(h) OVER (PARTITION BY branch ORDER BY ts_us, h), 0)) AS d FROM snaps)"""

STEPS = """steps AS (SELECT 'u' || user_id AS session_id, event_id AS step, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS ts_us FROM events),
near AS (SELECT *, last_value(CASE WHEN ts_us IS NOT NULL THEN step END IGNORE NULLS) OVER b AS ls, last_value(ts_us IGNORE NULLS) OVER b AS lt,
    first_value(CASE WHEN ts_us IS NOT NULL THEN step END IGNORE NULLS) OVER f AS hs, first_value(ts_us IGNORE NULLS) OVER f AS ht,
    min(ts_us) OVER (PARTITION BY session_id) AS lo, max(ts_us) OVER (PARTITION BY session_id) AS hi FROM steps
  WINDOW b AS (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
timed AS (SELECT session_id, step, ts_us, lo, hi, coalesce(ts_us, CASE WHEN ls IS NOT NULL AND hs IS NOT NULL THEN lt + ((step - ls) * (ht - lt)) // (hs - ls) END, lt, ht) AS est_us FROM near)"""

COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_MARKED = r"regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '(?m)^(\s*(?:\[(?:USER \d+|USER LATE|ASSISTANT END)\]|\.\.\.)\s*$)', '\\\1', 'g')"


def evidence(column: str) -> str:
    return COLLAPSE.format(_MARKED.format(column))


def compact(whole: str, budget: int) -> str:
    head = (budget - 1) // 2
    return f"CASE WHEN length({whole}) <= {budget} THEN {whole} ELSE left({whole}, {head}) || '…' || right({whole}, {budget - head - 1}) END"


NARRATIVE = "coalesce(text, '') <> '' AND NOT starts_with(text, '<scheduled-task') AND NOT starts_with(text, '<system-reminder>') AND NOT contains(text, 'tool_use_id')"

SUMMARY = """summary_table AS (SELECT 'c' || conv_id AS session_id, 'old ' || count(*) AS summary, CASE conv_id % 4 WHEN 0 THEN 'provided' WHEN 1 THEN 'generated' WHEN 2 THEN 'extracted' ELSE 'no_evidence' END AS source,
    CASE WHEN conv_id % 8 < 4 THEN CAST(count(*) AS VARCHAR) ELSE '' END AS evidence_fingerprint, CASE WHEN conv_id % 16 < 12 THEN CAST(count(*) AS VARCHAR) ELSE 'x' END AS observed_evidence_fingerprint,
    CAST(1 AS BIGINT) AS created_at, conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"""

REPO = """repos AS (SELECT 'repo' || c_nationkey AS repo, o_orderkey, epoch_us(o_orderdate) AS ts_us, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
years AS (SELECT 'y' || y AS window_key, epoch_us(make_timestamp(y, 1, 1, 0, 0, 0)) AS since_us, epoch_us(make_timestamp(y + 1, 1, 1, 0, 0, 0)) AS until_us FROM (SELECT unnest(range(1992, 1999)) AS y)),
in_year AS (SELECT * FROM repos JOIN years ON ts_us >= since_us AND ts_us < until_us),
cm AS (SELECT window_key, repo, count(*) AS commits, string_agg(CASE WHEN r <= 3 THEN 'order ' || o_orderkey END, ' | ' ORDER BY r) AS newest FROM (
  SELECT *, row_number() OVER (PARTITION BY window_key, repo ORDER BY ts_us DESC, 'order ' || o_orderkey) AS r FROM in_year WHERE o_orderstatus <> 'P') GROUP BY ALL),
mr AS (SELECT window_key, repo, count(DISTINCT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey // 4 END) + count(*) FILTER (o_orderkey % 9 = 0) AS merged FROM in_year GROUP BY ALL),
rl AS (SELECT window_key, repo, count(*) AS releases, string_agg('v' || o_orderkey, ',' ORDER BY 'v' || o_orderkey) AS tags FROM in_year WHERE o_orderstatus <> 'F' GROUP BY ALL),
repo_rows AS (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY commits DESC, repo) AS rank FROM (
  SELECT window_key, repo, coalesce(commits, 0) AS commits, coalesce(newest, '') AS newest, coalesce(merged, 0) AS merged, coalesce(releases, 0) AS releases, coalesce(tags, '') AS tags
  FROM cm FULL JOIN mr USING (window_key, repo) FULL JOIN rl USING (window_key, repo)))"""

_SALIENT = " || ".join(f"CASE WHEN regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{p})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{c},' ELSE '' END" for c, p in SALIENCE.items())



SKETCHES = f"""sketches AS (
  SELECT window_key, agent || '/' || session_id AS id, agent AS provider, project, area, CAST(CAST(make_timestamp(start_us + {_ZONE_US}) AS DATE) AS VARCHAR) AS local_day, active_us, start_us, msg_count,
    row_number() OVER (PARTITION BY window_key ORDER BY active_us DESC, start_us, agent, agent || '/' || session_id) AS plan_rank FROM placed)"""


def _plan() -> str:
    """The passes of the sampling plan without a budget, each over what those before have chosen."""
    top = lambda by, stage: (f"SELECT window_key, arg_min(id, plan_rank) AS id, '{by}_top' AS reason, {stage} AS stage, row_number() OVER (PARTITION BY window_key ORDER BY sum(active_us) DESC, {by}) AS pos, {by} AS value FROM sketches GROUP BY window_key, {by}").replace("'local_day_top'", "'day_top'")
    steps = [
        SKETCHES, f"tops AS ({top('provider', 1)} UNION ALL {top('project', 2)})",
        "covered AS (SELECT DISTINCT s.window_key, s.local_day FROM sketches s JOIN tops t ON s.window_key = t.window_key AND s.id = t.id)",
        f"pass0 AS (SELECT window_key, id, reason, stage, pos FROM tops UNION ALL SELECT window_key, id, reason, stage, pos FROM ({top('local_day', 3)}) d WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.window_key = d.window_key AND c.local_day = d.value))",
    ]
    for i, code in enumerate(SALIENCE):
        steps.append(f"""pass{i + 1} AS (SELECT * FROM pass{i} UNION ALL SELECT window_key, arg_min(id, plan_rank), 'salience:{code}', {4 + i}, 1 FROM sketches s
  WHERE msg_count % {i + 7} = 0 AND NOT EXISTS (SELECT 1 FROM pass{i} p WHERE p.window_key = s.window_key AND p.id = s.id) GROUP BY window_key)""")
    steps.append(f"""plan AS (SELECT s.window_key, s.id AS internal_id, any_value(plan_rank) AS plan_rank, coalesce(string_agg(reason, ',' ORDER BY stage, pos), 'budget_fill') AS reasons,
  any_value(provider) AS provider, any_value(project) AS project, any_value(local_day) AS local_day FROM sketches s LEFT JOIN pass{len(SALIENCE)} p ON p.window_key = s.window_key AND p.id = s.id GROUP BY s.window_key, s.id)""")
    return base() + ", " + ", ".join(steps)


def _plan_counts() -> str:
    codes = sorted(["provider_top", "project_top", "day_top", "budget_fill", *[f"salience:{c}" for c in SALIENCE]])
    counts = " || ',' || ".join(f"""'"{c}":' || count_if(list_contains(string_split(reasons, ','), '{c}'))""" for c in codes)
    hits = ", ".join(f"count(DISTINCT {d}) AS {d}_target, count(DISTINCT {d}) AS {d}_hit" for d in ("provider", "project", "local_day"))
    return f"SELECT window_key, count(*) AS population, count(*) AS selected, 0::BIGINT AS unselected, {hits}, '{{' || {counts} || '}}' AS reasons, true AS coverage_complete FROM plan GROUP BY window_key"


def _fit(grp: str, source: str, budget: int, overhead: int) -> str:
    """Items chosen from `source` (grp, pos, chars): the next that fits, again and again."""
    return f"""fit(grp, pos, chars, room) AS (SELECT DISTINCT {grp}, -1::BIGINT, 0::BIGINT, {budget}::BIGINT FROM {source} WHERE {grp} IS NOT NULL
  UNION ALL SELECT grp, pos, chars, room FROM (SELECT f.grp, d.pos, d.chars, f.room - d.chars - {overhead} AS room, row_number() OVER (PARTITION BY f.grp ORDER BY d.pos) AS n
    FROM fit f JOIN {source} d ON d.{grp} = f.grp AND d.pos > f.pos AND d.chars + {overhead} <= f.room) WHERE n = 1)"""


def _budgeted(budget: int) -> str:
    """The passes' offers of a window, one after another, each against what those before have left."""
    top = lambda by, reason, stage: f"SELECT s.window_key, {stage} AS stage, t.pos, s.id, '{reason}' AS reason, s.local_day, 40 * s.msg_count AS chars FROM (SELECT window_key, arg_min(id, plan_rank) AS id, row_number() OVER (PARTITION BY window_key ORDER BY sum(active_us) DESC, {by}) AS pos FROM sketches GROUP BY window_key, {by}) t JOIN sketches s ON s.window_key = t.window_key AND s.id = t.id"
    fill = 4 + len(SALIENCE)
    offers = [top("provider", "provider_top", 1), top("project", "project_top", 2), top("local_day", "day_top", 3)]
    offers += [f"SELECT window_key, {4 + i}, plan_rank, id, 'salience:{code}', local_day, 40 * msg_count FROM sketches WHERE msg_count % {i + 7} = 0" for i, code in enumerate(SALIENCE)]
    offers.append(f"SELECT window_key, {fill}, plan_rank, id, 'budget_fill', local_day, 40 * msg_count FROM sketches")
    known, fits = "list_contains(r.chosen, o.id)", "o.chars <= r.room"
    take = f"CASE WHEN o.stage < 4 THEN ({known} OR {fits}) AND NOT (o.stage = 3 AND list_contains(r.days, o.local_day)) WHEN o.stage < {fill} THEN NOT {known} AND {fits} AND NOT list_contains(r.asked, o.stage) ELSE NOT {known} AND {fits} END"
    return (base() + f""", {SKETCHES}, offers AS ({" UNION ALL ".join(offers)}),
 queue AS (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY stage, pos, id) AS n FROM offers),
 run AS (SELECT window_key, 0::BIGINT AS n, {budget}::BIGINT AS room, []::VARCHAR[] AS chosen, []::VARCHAR[] AS days, []::INT[] AS asked, false AS took FROM (SELECT DISTINCT window_key FROM sketches)
   UNION ALL SELECT window_key, n, CASE WHEN take AND NOT known THEN room - chars ELSE room END, CASE WHEN take AND NOT known THEN list_append(chosen, id) ELSE chosen END, CASE WHEN take THEN list_append(days, local_day) ELSE days END,
     CASE WHEN stage BETWEEN 4 AND {fill - 1} AND NOT known THEN list_append(asked, stage) ELSE asked END, take
   FROM (SELECT r.window_key, o.n, r.room, r.chosen, r.days, r.asked, o.id, o.stage, o.chars, o.local_day, {known} AS known, {take} AS take FROM run r JOIN queue o ON o.window_key = r.window_key AND o.n = r.n + 1)),
 plan AS (SELECT q.window_key, q.id AS internal_id, CAST(any_value(s.plan_rank) AS BIGINT) AS plan_rank, string_agg(reason, ',' ORDER BY q.stage, q.pos) AS reasons
   FROM run r JOIN queue q ON q.window_key = r.window_key AND q.n = r.n JOIN sketches s ON s.window_key = q.window_key AND s.id = q.id WHERE took GROUP BY q.window_key, q.id)""").replace("WITH ", "WITH RECURSIVE ", 1)


def _real(text: str) -> str:
    return f"(trim({text}) <> '' AND NOT starts_with({text}, '<') AND NOT contains({text}, 'tool_use_id'))"


def _told(text: str) -> str:
    return f"({text} <> '' AND NOT starts_with({text}, '<scheduled-task') AND NOT starts_with({text}, '<system-reminder>') AND NOT contains({text}, 'tool_use_id'))"


# what the lines of bindings mean, said from the tables and without any JSON
LINES_A = f"""said AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 9 = 0 AND turn <= 1 AND role = 'user' THEN '<scheduled-task name="x"> ' || text ELSE text END AS text, length(text) AS chars, (conv_id * 7 + turn) % 23 = 0 AS broken,
   CASE WHEN (conv_id + turn) % 13 <> 0 THEN (1705276800 + conv_id * 600 + turn * 37) * 1000000 END AS ts_us, {_case("conv_id % 8", B.FOLDERS)} AS folder, conv_id % 11 = 0 AS sub FROM conversations),
 firsts AS (SELECT conv_id, arg_min(text, turn) AS opening FROM said WHERE role = 'user' AND NOT broken AND trim(text) <> '' GROUP BY conv_id),
 msgs_a AS (SELECT 'agent_a' AS agent, 'conv-' || s.conv_id AS session_id, turn + 1 AS line_no, ts_us, role, role = 'user' AND {_real("text")} AS is_real_user, {_told("text")} AS narrative, text, '/work/' || (s.conv_id % 16) AS cwd, sub AS is_subagent, folder AS project_raw,
   coalesce(starts_with(opening, '<scheduled-task'), false) AS is_scheduled FROM said s LEFT JOIN firsts f ON f.conv_id = s.conv_id WHERE NOT broken AND role IN ('user', 'assistant'))"""
LINES_B = f"""msgs_b AS (SELECT 'agent_b' AS agent, 'u' || user_id AS session_id, event_id + 2 AS line_no, epoch_us(ts) AS ts_us, event_type <> 'signup' AND NOT (event_type = 'view' AND event_id % 3 = 0) AS is_activity, event_type IN ('click', 'purchase') OR (event_type = 'view' AND event_id % 3 <> 0) AS counts_msg,
   event_type = 'click' AS is_real_user, CASE WHEN event_type IN ('click', 'error') THEN 'do ' || event_id WHEN event_type = 'purchase' THEN 'do ' || event_id || chr(10) || 'more' ELSE '' END AS text,
   CASE WHEN event_type = 'click' THEN 'user' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END END AS role FROM events WHERE user_id % 10 <> 7
  UNION ALL SELECT 'agent_b', 'u' || user_id, 1, min(epoch_us(ts)), false, false, false, '', NULL FROM events WHERE user_id % 10 <> 7 GROUP BY user_id)"""
LINES_C = f"""steps_c AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us, event_type IN ('click', 'purchase') AS asks, CASE WHEN event_type IN ('click', 'purchase', 'signup') AND user_id % 25 = 0 THEN '<identity> ' ELSE '' END || 'say ' || CAST(json_extract(props, '$.k') AS BIGINT) AS text FROM events),
 msgs_c AS (SELECT 'agent_c' AS agent, 'u' || user_id AS session_id, event_id + 1 AS line_no, ts_us, asks OR event_type IN ('view', 'error') AS counts_msg, asks AND {_real("text")} AS is_real_user, text, CASE WHEN asks THEN 'user' WHEN event_type IN ('view', 'error') THEN 'assistant' END AS role
   FROM steps_c WHERE user_id NOT IN (SELECT user_id FROM steps_c WHERE asks AND user_id % 25 = 0))"""

_HITS = ", ".join(f"count(DISTINCT s.{d}) AS {d}_target, count(DISTINCT CASE WHEN p.internal_id IS NOT NULL THEN s.{d} END) AS {d}_hit" for d in ("provider", "project", "local_day"))

_EVIDENCE_WINDOWS = [(f"e{i:02d}", (1705276800 + (0 if i == 0 else 130 + 500 * 2 ** (i - 1))) * 1_000_000, (1705276800 + 130 + 500 * 2**i) * 1_000_000, i) for i in range(14)]
_SIXTY = lambda at: f"sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT))"

# excerpts from their definition: the first three and the last two messages of the user, and the last answer
EXCERPTS = f"""told AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, role) AS n, text, {evidence('text')} AS e FROM conversations WHERE {NARRATIVE}),
 picked AS (SELECT conv_id, CASE WHEN i <= 3 THEN i ELSE 10 + i END AS place, CASE WHEN i <= 3 THEN '[USER ' || i || ']' ELSE '[USER LATE]' END AS mark, {compact('e', 500)} AS said FROM told t
     WHERE role = 'user' AND (i <= 3 OR (i > n - 2 AND NOT EXISTS (SELECT 1 FROM told h WHERE h.conv_id = t.conv_id AND h.role = 'user' AND h.i <= 3 AND h.text = t.text)))
   UNION ALL SELECT conv_id, 4, '...', NULL FROM told WHERE role = 'user' AND i = 1 AND n > 5
   UNION ALL SELECT conv_id, 1000000, '[ASSISTANT END]', {compact('e', 300)} FROM told WHERE role = 'assistant' AND i = n),
 excerpt AS (SELECT c.conv_id, coalesce(n_users, 0) AS n_users, coalesce(excerpt, '') AS excerpt, coalesce(users, []) AS users FROM (SELECT DISTINCT conv_id FROM told) c
   LEFT JOIN (SELECT conv_id, count(*) AS n_users FROM told WHERE role = 'user' GROUP BY conv_id) u ON u.conv_id = c.conv_id
   LEFT JOIN (SELECT conv_id, string_agg(CASE WHEN said IS NULL THEN mark ELSE mark || chr(10) || said END, chr(10) || chr(10) ORDER BY place) AS excerpt, list(said ORDER BY place) FILTER (starts_with(mark, '[USER')) AS users FROM picked WHERE said IS NULL OR said <> '' GROUP BY conv_id) e ON e.conv_id = c.conv_id)"""

ORACLE: dict[str, str] = {
    "excerpts": f"WITH {EXCERPTS} SELECT conv_id, n_users, excerpt FROM excerpt",
    "narratives": f"""WITH {EXCERPTS} SELECT conv_id, CASE WHEN excerpt = '' THEN '' WHEN len(users) = 0 THEN {COLLAPSE.format('excerpt')}[1:120] WHEN len(users) = 1 THEN users[1][1:120] ELSE users[1][1:60] || ' → ' || users[-1][1:60] END AS narrative FROM excerpt""",
    "label_vocabulary": """WITH rows AS (SELECT lang AS run_id, doc_id // 80 AS chunk, doc_id % 80 AS pos, lower(source) AS bucket FROM documents),
 seen AS (SELECT *, count(*) OVER (PARTITION BY run_id, bucket ORDER BY chunk) AS so_far FROM rows),
 ready AS (SELECT run_id, bucket, min(chunk) AS chunk FROM seen WHERE so_far >= 2 AND bucket NOT IN ('src1', 'src2') GROUP BY ALL),
 since AS (SELECT r.run_id, r.bucket, r.chunk, min(s.pos) AS pos FROM ready r JOIN rows s ON s.run_id = r.run_id AND s.bucket = r.bucket AND s.chunk = r.chunk GROUP BY ALL),
 accepted AS (SELECT * FROM since QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY chunk, pos, bucket) <= greatest(6, 2 + 2) - 2)
 SELECT r.run_id, r.bucket, count(*) AS n FROM rows r LEFT JOIN accepted a ON a.run_id = r.run_id AND a.bucket = r.bucket WHERE r.bucket IN ('src1', 'src2') OR r.chunk > a.chunk OR (r.chunk = a.chunk AND r.pos >= a.pos) GROUP BY ALL""",
    "evidence_slices": f"""WITH {LINES_A}, {windows(_EVIDENCE_WINDOWS)}, inside AS (SELECT w.window_key, m.*, 'projects/' || project_raw || CASE WHEN is_subagent THEN '/subagents' ELSE '' END || '/' || session_id || '.jsonl' AS path FROM msgs_a m JOIN windows w ON ts_us >= since_us AND ts_us < until_us),
 gaps AS (SELECT *, CASE WHEN lead(ts_us) OVER s IS NULL THEN 0 ELSE least(lead(ts_us) OVER s - ts_us, 300000000) END AS gap, sha256(concat_ws(chr(31), ts_us, path, line_no, role, text)) AS h, CASE WHEN is_real_user THEN text END AS said FROM inside WINDOW s AS (PARTITION BY window_key, session_id ORDER BY ts_us, line_no)),
 found AS (SELECT window_key, agent, session_id, min(project_raw) AS project, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS msg_count, CAST(count_if(is_real_user) AS BIGINT) AS user_msg_count, CAST(sum(gap) AS BIGINT) AS between_us,
   sha256(count(*) || ':' || {_SIXTY(1)} || ':' || {_SIXTY(16)}) AS events_digest, coalesce(arg_min(said, (ts_us, line_no)) FILTER (said IS NOT NULL)[1:200], '') AS first_text, coalesce(arg_max(said, (ts_us, line_no)) FILTER (said IS NOT NULL)[1:200], '') AS last_text
   FROM gaps GROUP BY window_key, agent, session_id),
 printed AS (SELECT *, sha256(CAST(to_json({{'p00': 1, 'p01': project, 'p02': first_us, 'p03': last_us, 'p04': msg_count, 'p05': user_msg_count, 'p06': between_us, 'p07': events_digest, 'p08': first_text, 'p09': last_text}}) AS VARCHAR)) AS fingerprint FROM found)
 SELECT *, 'slice-' || substr(sha256('1' || chr(0) || agent || chr(0) || session_id || chr(0) || fingerprint), 1, 24) AS slice_id FROM printed""",
    "aggregate_cache_sets": base() + """, rows AS (SELECT window_key, project, start_us // 86400000000 AS day, start_us % 86400000000 < 64800000000 AS early, agent || '/' || session_id AS id, active_us FROM placed),
 sets AS (SELECT window_key, project, day, count(*) AS n, CAST(sum(active_us) // 3600000000 AS BIGINT) AS hours, string_agg(id, ' ' ORDER BY id) AS ids, string_agg(CASE WHEN early THEN id END, ' ' ORDER BY id) AS old_ids, sum(CASE WHEN early THEN active_us ELSE 0 END) // 3600000000 AS old_hours FROM rows GROUP BY ALL)
 SELECT window_key, project, day, n, hours, coalesce(ids = old_ids AND hours = old_hours, false) AS hit FROM sets""",
    "log_messages_a": f"WITH {LINES_A} SELECT session_id, line_no, ts_us, role, is_real_user, narrative, text, cwd, is_subagent, project_raw, is_scheduled FROM msgs_a",
    "log_usage_a": f"""WITH {LINES_A} SELECT 'projects/' || folder || CASE WHEN sub THEN '/subagents' ELSE '' END || '/conv-' || conv_id || '.jsonl' AS path, turn + 1 AS line_no, ts_us, CASE WHEN conv_id % 6 <> 5 THEN 'model-' || (conv_id % 3) ELSE 'unknown' END AS model,
 'm' || conv_id || '-' || (turn // 2) AS message_id, 10 * turn AS input_tokens, CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END AS cache_creation, chars % 100 AS cache_read, conv_id % 50 AS output_tokens FROM said WHERE role = 'assistant' AND NOT broken AND ts_us IS NOT NULL AND conv_id % 10 <> 3""",
    "log_metrics": "SELECT count(DISTINCT conv_id) AS files, count(*) AS lines, count_if((conv_id * 7 + turn) % 23 = 0) AS bad_lines, count_if((conv_id * 7 + turn) % 23 = 0) = 0 AS inventory_complete FROM conversations",
    "log_messages_b": f"WITH {LINES_B} SELECT session_id, line_no, ts_us, is_activity, counts_msg, is_real_user, text, role FROM msgs_b",
    "log_usage_b": """WITH counted AS (SELECT user_id, event_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'signup'),
 most AS (SELECT user_id, max(n) AS most FROM counted GROUP BY user_id), switches AS (SELECT user_id, event_id, 'm' || (event_id % 4) AS model FROM events WHERE event_type = 'view' AND event_id % 3 = 0),
 own AS (SELECT c.*, (SELECT arg_max(model, s.event_id) FROM switches s WHERE s.user_id = c.user_id AND s.event_id < c.event_id) AS model FROM counted c),
 up AS (SELECT user_id, user_id - 1 AS parent FROM most WHERE user_id % 10 = 7)
 SELECT 'u' || o.user_id AS branch, ts_us, coalesce(model, 'unknown') AS model, 6 AS input_tokens, 1 AS cache_creation, 4 AS cache_read, 3 AS output_tokens
 FROM own o LEFT JOIN up u ON u.user_id = o.user_id LEFT JOIN most m ON m.user_id = u.parent WHERE n > coalesce(m.most, 0)""",
    "log_messages_c": f"WITH {LINES_C} SELECT session_id, line_no, ts_us, counts_msg, is_real_user, text, role FROM msgs_c",
    "log_usage_c": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
 SELECT 'u' || user_id AS session_id, event_id AS step, epoch_us(ts) AS ts_us, CASE event_type WHEN 'view' THEN 's1' ELSE 's2' END AS model, k AS input_tokens, 0 AS cache_creation, CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 2 * k ELSE 0 END AS cache_read, CASE event_type WHEN 'view' THEN k + 1 ELSE k END AS output_tokens
 FROM e WHERE event_type = 'view' OR (event_type = 'error' AND event_id % 7 <> 0)""",
    "log_sessions": f"""WITH {LINES_A}, {LINES_B}, {LINES_C},
 rows AS (SELECT agent, session_id, ts_us, is_real_user, is_scheduled FROM msgs_a WHERE NOT is_subagent UNION ALL SELECT agent, session_id, ts_us, is_real_user, false FROM msgs_b WHERE is_activity UNION ALL SELECT agent, session_id, ts_us, is_real_user, false FROM msgs_c),
 gaps AS (SELECT *, CASE WHEN lead(ts_us) OVER s IS NOT NULL THEN least(lead(ts_us) OVER s - ts_us, 300000000) ELSE 0 END AS gap FROM rows WHERE ts_us IS NOT NULL WINDOW s AS (PARTITION BY agent, session_id ORDER BY ts_us)),
 whole AS (SELECT agent, session_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS msg_count, CAST(count_if(is_real_user) AS BIGINT) AS user_msg_count, CAST(sum(gap) AS BIGINT) AS active_us, max(is_scheduled) AS is_scheduled FROM gaps GROUP BY ALL)
 SELECT * FROM whole WHERE end_us >= {B.WINDOWS[0][1]} AND start_us < {B.WINDOWS[0][1] + 12 * 86_400 * 1_000_000} AND CASE WHEN is_scheduled THEN user_msg_count >= 1 ELSE user_msg_count >= 2 OR (user_msg_count = 1 AND active_us >= 60000000) END""",
    "sampling_plan_budgeted": _budgeted(6000) + " SELECT window_key, internal_id, plan_rank, reasons FROM plan",
    "sampling_coverage": _budgeted(6000) + f" SELECT s.window_key, count(*) AS population, count(p.internal_id) AS selected, {_HITS} FROM sketches s LEFT JOIN plan p ON p.window_key = s.window_key AND p.internal_id = s.id GROUP BY s.window_key",
    "active_time_per_session": f"WITH {ACTIVITY}, {sessions()} SELECT agent, session_id, start_us, end_us, msg_count, user_msg_count, active_us, active_us // 1000000 AS active_sec FROM sessions",
    "active_time_wide_gap": f"WITH {ACTIVITY}, {sessions(WIDE)} SELECT agent, session_id, active_us FROM sessions",
    "engaged_sessions": f"WITH {ACTIVITY}, {sessions()} SELECT agent, session_id, user_msg_count, active_us FROM engagement WHERE engaged",
    "session_window_slices": base() + " SELECT window_key, agent, session_id, start_us, end_us, active_us, msg_count, user_msg_count, engaged, contained FROM placed",
    "sessions_overlapping_windows": base() + " SELECT window_key, agent, count(*) AS sessions FROM sessions JOIN windows ON end_us >= since_us AND start_us < until_us GROUP BY ALL",
    "wall_clock_by_window": base() + " SELECT * FROM totals",
    "wall_clock_wide_gap": base(cap=WIDE) + " SELECT * FROM totals",
    "wall_clock_by_agent": "WITH " + ",\n".join([windows(), ACTIVITY, intervals(), CLIPPED, totals("window_key, agent")]) + " SELECT window_key, agent, wall_us FROM totals",
    "bounded_slice_check": base() + " SELECT window_key, count(*) AS slices, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS twice FROM slices GROUP BY ALL",
    "area_project_rollup": rollup() + " SELECT * FROM rollup_rows",
    "shown_projects": rollup() + " SELECT window_key, area, string_agg(CASE WHEN r <= 3 THEN project END, ',' ORDER BY r) AS projects, CAST(greatest(0, count(*) - 3) AS INT) AS more FROM (SELECT *, row_number() OVER (PARTITION BY window_key, area ORDER BY minutes DESC, project) AS r FROM rollup_rows WHERE NOT is_area) GROUP BY ALL",
    "top_focus": rollup() + """, tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY minutes DESC, area DESC) AS r FROM rollup_rows WHERE is_area) WHERE r = 1)
 SELECT window_key, area, area_minutes, project, project_minutes FROM (SELECT t.window_key, t.area, t.minutes AS area_minutes, p.project, p.minutes AS project_minutes, row_number() OVER (PARTITION BY t.window_key ORDER BY p.minutes DESC, p.project DESC) AS r
   FROM tops t JOIN rollup_rows p ON p.window_key = t.window_key AND p.area = t.area AND NOT p.is_area) WHERE r = 1""",
    "top_sessions_per_area": base() + " SELECT window_key, area, CAST(rank AS INT) AS rank, agent, session_id, active_us, start_us FROM (SELECT *, row_number() OVER (PARTITION BY window_key, area ORDER BY active_us DESC, start_us, agent, session_id) AS rank FROM placed) WHERE rank <= 5",
    "agent_breakdown": base() + """ SELECT window_key, agent, sessions, messages, active_us, CASE WHEN ta > 0 THEN CAST(active_us AS DOUBLE) / CAST(ta AS DOUBLE) ELSE 0.0 END AS time_share, CASE WHEN ts > 0 THEN CAST(sessions AS DOUBLE) / CAST(ts AS DOUBLE) ELSE 0.0 END AS session_share FROM (
 SELECT *, sum(active_us) OVER (PARTITION BY window_key) AS ta, sum(sessions) OVER (PARTITION BY window_key) AS ts FROM (SELECT window_key, agent, count(*) AS sessions, CAST(sum(msg_count) AS BIGINT) AS messages, CAST(sum(active_us) AS BIGINT) AS active_us FROM slices GROUP BY ALL))""",
    "agent_scope": base() + " SELECT window_key, CASE WHEN count(DISTINCT agent) = 1 THEN min(agent) ELSE 'all' END AS agent_scope FROM slices GROUP BY ALL",
    "classification_sources": base() + f""" SELECT area, area_source, count(*) AS sessions FROM (SELECT CASE WHEN project IN ({", ".join(f"'{p}'" for p in _AREAS)}) THEN {" ".join(["CASE project", *[f"WHEN '{p}' THEN '{a}'" for p, a in _AREAS.items()], "END"])}
 WHEN user_id % 5 = 0 THEN 'research' ELSE 'coding' END AS area, CASE WHEN project IN ({", ".join(f"'{p}'" for p in _AREAS)}) THEN 'user_rule' WHEN user_id % 5 = 0 THEN 'llm_cache' ELSE 'fallback' END AS area_source FROM sessions) GROUP BY ALL""",
    "label_cache_by_fingerprint": base() + " SELECT session_id, 'research' AS bucket FROM sessions WHERE user_id % 5 = 0 AND length(session_id) % 2 <> 0",
    "project_names": base() + " SELECT project_raw, project, count(*) AS sessions FROM sessions GROUP BY ALL",
    "majority_vote": """SELECT folder, bucket, votes FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY votes DESC, first, bucket) AS r FROM (
 SELECT source AS folder, lang AS bucket, count(*) AS votes, min(doc_id) AS first FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang IS NOT NULL GROUP BY ALL)) WHERE r = 1""",
    "label_distribution": base() + f""" SELECT area, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, count(*) AS sessions FROM (SELECT project, {" ".join(["CASE project", *[f"WHEN '{p}' THEN '{a}'" for p, a in _AREAS.items()], "ELSE 'coding' END"])} AS area FROM sessions) GROUP BY area""",
    "usage_by_model_window": f"WITH {usage()} SELECT * FROM by_model",
    "usage_merged_by_agent": f"WITH {usage()} SELECT * FROM by_model",
    "usage_cost_by_model": f"WITH {usage()} SELECT window_key, model, {_usd("cost_micro")} AS cost_usd, {_usd("plain_micro")} AS cost_uncached_usd, priced FROM costed",
    "usage_cost_totals": f"""WITH {usage()} SELECT window_key, input_tokens, cache_creation, cache_read, output_tokens, turns, input_tokens + cache_creation + cache_read + output_tokens AS total_tokens, unpriced_models,
 CASE WHEN input_tokens + cache_creation + cache_read > 0 THEN CAST(cache_read AS DOUBLE) / CAST(input_tokens + cache_creation + cache_read AS DOUBLE) ELSE 0.0 END AS cache_hit, {_usd("cost")} AS cost_usd, {_usd("plain")} AS cost_uncached_usd, {_usd("plain - cost")} AS savings_usd FROM usage_sums""",
    "usage_coverage": base() + " SELECT window_key, NOT bool_or(agent = 'agent_c') AS usage_complete, CASE WHEN bool_or(agent = 'agent_c') THEN 'agent_c' ELSE '' END AS partial_agents, '' AS unavailable_agents FROM slices GROUP BY ALL",
    "usage_step_dedup": f"WITH {usage()} SELECT agent AS session_id, count(*) AS steps, CAST(sum(k) AS BIGINT) AS input_tokens FROM raw_usage WHERE event_id % 3 <> 0 GROUP BY ALL",
    "cumulative_delta": f"WITH {SNAPSHOTS} SELECT branch, ts_us, model, 2 * d AS input_tokens, 2 * d AS cache_creation, d AS cache_read, 5 * d AS output_tokens FROM deltas WHERE d > 0",
    "inherited_prefix": f"WITH {SNAPSHOTS} SELECT branch || '-c' AS branch, count(*) // 2 AS inherited FROM snaps WHERE h > 0 GROUP BY branch",
    "inherited_broken_runs": """WITH RECURSIVE o AS (SELECT 'c' || o_custkey AS branch, o_custkey, o_orderkey, (o_orderkey // 4) % 3 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
 tree AS (SELECT DISTINCT branch, 'c' || (o_custkey // 2) AS parent FROM o WHERE o_custkey % 4 >= 2),
 up AS (SELECT branch, parent AS ancestor FROM tree UNION SELECT up.branch, t.parent FROM up JOIN tree t ON t.branch = up.ancestor),
 scan AS (SELECT branch, ancestor, 0::BIGINT AS j, 0::BIGINT AS got FROM up
   UNION ALL SELECT s.branch, s.ancestor, s.j + 1, s.got + CASE WHEN mine.v = theirs.v THEN 1 ELSE 0 END FROM scan s JOIN o theirs ON theirs.branch = s.ancestor AND theirs.i = s.j LEFT JOIN o mine ON mine.branch = s.branch AND mine.i = s.got)
 SELECT branch, max(got) AS inherited FROM scan GROUP BY branch""",
    "branch_usage": f"""WITH {SNAPSHOTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY ts_us, h) AS i, count(*) OVER (PARTITION BY branch) AS n, greatest(0, h - coalesce(lag(h) OVER (PARTITION BY branch ORDER BY ts_us, h), 0)) AS g FROM snaps WHERE h > 0),
 child AS (SELECT a.branch || '-c' AS branch, a.h AS x, coalesce(b.h, 0) AS y FROM ranked a LEFT JOIN ranked b ON b.branch = a.branch AND b.i = a.n // 2 WHERE a.i = a.n)
 SELECT branch, count(*) AS turns, CAST(sum(2 * g) AS BIGINT) AS input_tokens, CAST(sum(2 * g) AS BIGINT) AS cache_creation, CAST(sum(g) AS BIGINT) AS cache_read, CAST(sum(5 * g) AS BIGINT) AS output_tokens FROM ranked WHERE g > 0 GROUP BY branch
 UNION ALL SELECT branch, 1, 2 * (x - y), 2 * (x - y) + 7, x - y + 7, 5 * (x - y) + 7 FROM child""",
    "duplicate_memberships": base() + """, folders AS (SELECT project_raw, dense_rank() OVER (ORDER BY project_raw) AS p, min(CASE user_id % 8 WHEN 2 THEN 'web-app' WHEN 6 THEN 'web-app' WHEN 7 THEN 'web-app' WHEN 4 THEN 'scratch-pad' ELSE project END) AS name FROM activity GROUP BY project_raw)
 SELECT needle, count(*) AS n_areas, string_agg(project_raw, ',' ORDER BY p) AS areas FROM (SELECT DISTINCT project_raw, p, unnest(string_split(name, '-')) AS needle FROM folders) GROUP BY needle HAVING count(*) > 1""",
    "ancestor_closure": """WITH RECURSIVE chain AS (SELECT o_orderkey AS branch, CASE WHEN (row_number() OVER w - 1) % 4 > 0 THEN lag(o_orderkey) OVER w END AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 up AS (SELECT branch, parent AS ancestor FROM chain WHERE parent IS NOT NULL UNION ALL SELECT up.branch, c.parent FROM up JOIN chain c ON c.branch = up.ancestor WHERE c.parent IS NOT NULL) SELECT branch, ancestor FROM up""",
    "step_interpolation": f"WITH {STEPS} SELECT session_id, step, ts_us, est_us FROM timed",
    "steps_in_windows": f"WITH {windows()}, {STEPS} SELECT window_key, count(*) AS steps FROM timed JOIN windows ON (ts_us IS NULL AND since_us <= lo AND hi <= until_us) OR est_us BETWEEN since_us AND until_us GROUP BY ALL",
    "asof_model": "SELECT CAST(user_id AS VARCHAR) AS path, event_id AS line_no, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'm' || (event_id % 5) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS model FROM events",
    "period_comparison": rollup() + """ SELECT area, current_min, previous_min, current_min - previous_min AS delta_min, CASE WHEN previous_min > 0 THEN (current_min - previous_min) / previous_min * 100 END AS pct_change FROM (
 SELECT area, coalesce(max(minutes) FILTER (window_key = 'current'), 0.0) AS current_min, coalesce(max(minutes) FILTER (window_key = 'previous'), 0.0) AS previous_min FROM rollup_rows WHERE is_area GROUP BY area)""",
    "comparison_totals": base() + ", " + usage().split(",\n", 1)[1] + """ SELECT max(hours) FILTER (window_key = 'current') AS current_hours, max(o) FILTER (window_key = 'current') AS current_output_tokens, max(c) FILTER (window_key = 'current') AS current_cost_usd,
 max(hours) FILTER (window_key = 'previous') AS previous_hours, max(o) FILTER (window_key = 'previous') AS previous_output_tokens, max(c) FILTER (window_key = 'previous') AS previous_cost_usd
 FROM (SELECT t.window_key, wall_us / 3600000000.0::DOUBLE AS hours, u.output_tokens AS o, """ + _usd("cost") + """ AS c FROM totals t JOIN usage_sums u ON u.window_key = t.window_key)""",
    "trend_points": base(W4) + ", " + usage(W4).split(",\n", 1)[1] + """ SELECT w.window_key, CAST(w.ord AS INT) AS ord, coalesce(wall_us, 0) / 3600000000.0::DOUBLE AS hours, coalesce(output_tokens, 0) AS output_tokens, coalesce(""" + _usd("cost") + """, 0.0) AS cost_usd,
 round(coalesce(CAST(cost AS DOUBLE) / 1e6, 0.0) / (3500.0::DOUBLE * 7.0::DOUBLE / 30.0::DOUBLE) * 100.0::DOUBLE, 6) AS quota_pct FROM windows w LEFT JOIN totals t ON t.window_key = w.window_key LEFT JOIN usage_sums u ON u.window_key = w.window_key""",
    "trend_matrix": rollup(W4) + " SELECT a.area, w.window_key, CAST(w.ord AS INT) AS ord, coalesce(r.minutes, 0.0) AS minutes FROM (SELECT DISTINCT area FROM rollup_rows) a CROSS JOIN windows w LEFT JOIN rollup_rows r ON r.area = a.area AND r.window_key = w.window_key AND r.is_area",
    "trend_change": rollup(W4) + """ SELECT area, window_key, minutes, previous, round(CASE WHEN previous > 0 THEN (minutes - previous) / previous * 100 END, 6) AS pct, round(mean, 6) AS mean FROM (
 SELECT *, lag(minutes) OVER (PARTITION BY area ORDER BY ord) AS previous, avg(minutes) OVER (PARTITION BY area) AS mean FROM (
 SELECT a.area, w.window_key, w.ord, coalesce(r.minutes, 0.0) AS minutes FROM (SELECT DISTINCT area FROM rollup_rows) a CROSS JOIN windows w LEFT JOIN rollup_rows r ON r.area = a.area AND r.window_key = w.window_key AND r.is_area))""",
    "goal_breakdown": goals() + " SELECT * FROM goal_rows",
    "top_goals": goals() + " SELECT window_key, goal_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY exclusive_us + shared_us DESC, goal_id) AS rank FROM goal_rows) WHERE rank <= 2",
    "goal_lanes": goals() + " SELECT window_key, CAST(sum(CASE WHEN n = 1 THEN amount ELSE 0 END) AS BIGINT) AS exclusive_us, CAST(sum(CASE WHEN n > 1 THEN amount ELSE 0 END) AS BIGINT) AS shared_us, CAST(sum(CASE WHEN n = 0 THEN amount ELSE 0 END) AS BIGINT) AS unattributed_us, CAST(sum(amount) AS BIGINT) AS covered_us FROM (SELECT DISTINCT window_key, project, local_date, amount, n FROM met) GROUP BY ALL",
    "goal_history": goals(W4) + """ SELECT g.window_key, goal_id, exclusive_us, shared_us, latest_date, exclusive_us * s / 3600000000.0::DOUBLE AS exclusive_hours, shared_us * s / 3600000000.0::DOUBLE AS shared_hours
 FROM (SELECT r.*, CASE WHEN coalesce(raw_us, 0) > 0 THEN CAST(wall_us AS DOUBLE) / CAST(raw_us AS DOUBLE) ELSE 1.0::DOUBLE END AS s FROM goal_rows r LEFT JOIN totals t ON t.window_key = r.window_key) g""",
    "local_day_split": f"""WITH {ACTIVITY}, {intervals(WIDE)} SELECT DATE '1970-01-01' + CAST(d AS INT) AS local_date, count(*) AS pieces, CAST(sum(b - a) AS BIGINT) AS us FROM (
 SELECT d, greatest(start_us + {_ZONE_US}, d * 86400000000) AS a, least(end_us + {_ZONE_US}, (d + 1) * 86400000000) AS b FROM (SELECT *, unnest(range((start_us + {_ZONE_US}) // 86400000000, (end_us + {_ZONE_US} - 1) // 86400000000 + 1)) AS d FROM intervals)) WHERE b > a GROUP BY ALL""",
    "message_predicates": f"SELECT conv_id, turn, role = 'user' AND trim(coalesce(text, '')) <> '' AND NOT starts_with(coalesce(text, ''), '<') AND NOT contains(coalesce(text, ''), 'tool_use_id') AS is_real_user, {NARRATIVE} AS narrative, CAST(length({COLLAPSE.format('text')}) AS INT) AS chars FROM conversations",
    "compact_documents": f"SELECT doc_id, {compact('e', 120)} AS short FROM (SELECT doc_id, {evidence('text')} AS e FROM documents)",
    "salience_codes": f"SELECT doc_id, rtrim({_SALIENT}, ',') AS codes FROM documents",
    "text_precedence": f"""SELECT conv_id, coalesce(nullif({COLLAPSE.format('summary')}, ''), nullif({COLLAPSE.format('native')}, ''), nullif({COLLAPSE.format('first')}, ''), '') AS text FROM (
 SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 's' || count(*) END AS summary, arg_min(text, turn) FILTER (role = 'system') AS native, left(arg_min(text, turn), 40) AS first FROM conversations GROUP BY conv_id)""",
    "day_quota_sample": f"""WITH {ACTIVITY}, {sessions()}, ranked AS (SELECT *, CAST(make_timestamp(start_us) AS DATE) AS day, row_number() OVER (PARTITION BY CAST(make_timestamp(start_us) AS DATE) ORDER BY active_us DESC, start_us, session_id) AS r FROM sessions)
 SELECT session_id, active_us, place FROM (SELECT session_id, active_us, row_number() OVER (ORDER BY r > 14, CASE WHEN r <= 14 THEN day END, active_us DESC, start_us, session_id) AS place FROM ranked) WHERE place <= 100""",
    "first_texts": f"""WITH t AS (SELECT source AS project, left(text, 160) AS text, min(doc_id) AS first, sum(n_chars) AS active FROM documents GROUP BY ALL)
 SELECT project, rank, text FROM (SELECT project, text, row_number() OVER (PARTITION BY project ORDER BY first) AS rank FROM t WHERE text <> '') WHERE rank <= 2""",
    "summary_upsert": f"""WITH {SUMMARY}, new AS (SELECT CASE WHEN conv_id % 5 = 0 THEN session_id || '-new' ELSE session_id END AS session_id, 'new ' || n AS summary, CASE WHEN conv_id % 2 = 0 THEN 'generated' ELSE 'provided' END AS source,
 CASE WHEN conv_id % 2 = 0 THEN 'legacy-unknown' ELSE '' END AS fp, CAST(2 AS BIGINT) AS created_at FROM summary_table WHERE conv_id % 3 = 0),
 j AS (SELECT t.session_id AS a, s.session_id AS b, t.summary AS ts, s.summary AS ss, t.source AS tq, s.source AS sq, t.evidence_fingerprint AS te, t.observed_evidence_fingerprint AS tt, s.fp, t.created_at AS tc, s.created_at AS sc,
  s.session_id IS NULL OR coalesce(t.source = 'provided' AND s.source <> 'provided', false) AS k FROM summary_table t FULL JOIN new s ON t.session_id = s.session_id)
 SELECT coalesce(a, b) AS session_id, CASE WHEN k THEN ts ELSE ss END AS summary, CASE WHEN k THEN tq ELSE sq END AS source, CASE WHEN k THEN te ELSE fp END AS evidence_fingerprint, CASE WHEN k THEN tt ELSE fp END AS observed_evidence_fingerprint, CASE WHEN k THEN tc ELSE sc END AS created_at FROM j""",
    "evidence_status": f"""WITH {SUMMARY}, st AS (SELECT session_id, source, CASE WHEN source = 'no_evidence' THEN 'unavailable' WHEN source <> 'generated' THEN 'not_applicable' WHEN evidence_fingerprint IN ('', 'legacy-unknown') THEN 'legacy'
 WHEN observed_evidence_fingerprint IN ('', 'unavailable') THEN 'unavailable' WHEN evidence_fingerprint = observed_evidence_fingerprint THEN 'current' ELSE 'stale' END AS status FROM summary_table) SELECT session_id, status, source = 'provided' OR (source = 'generated' AND status = 'current') AS eligible FROM st""",
    "newest_generated": f"WITH {SUMMARY} SELECT session_id, n AS created_at FROM (SELECT *, row_number() OVER (ORDER BY n DESC, session_id DESC) AS r FROM summary_table WHERE source = 'generated') WHERE r <= 20",
    "session_facts": """WITH t AS (SELECT *, CASE WHEN trim(text) <> '' THEN text END AS said, role = 'user' AND trim(coalesce(text, '')) <> '' AND NOT starts_with(coalesce(text, ''), '<') AND NOT contains(coalesce(text, ''), 'tool_use_id') AS real FROM conversations)
 SELECT 'agent_a' AS agent, conv_id AS session_id, arg_min('/d' || turn, turn) FILTER (turn % 2 = 1) AS cwd, left(arg_min(said, turn) FILTER (real AND said IS NOT NULL), 200) AS first_user_text, arg_max(said, turn) FILTER (real AND said IS NOT NULL) AS latest_user_text,
 arg_max(said, turn) FILTER (role = 'assistant' AND said IS NOT NULL) AS final_assistant_text FROM t GROUP BY conv_id""",
    "price_changes": """WITH p AS (SELECT 'p' || p_partkey AS model, p_partkey % 10 AS k, p_partkey % 7 AS inp, p_partkey % 11 AS out, p_partkey % 5 AS cw, p_partkey % 3 AS cr FROM part),
 o AS (SELECT * FROM p WHERE k <> 1), n AS (SELECT * REPLACE (inp + CASE WHEN k = 3 THEN 1 ELSE 0 END AS inp) FROM p WHERE k <> 2)
 SELECT coalesce(o.model, n.model) AS model, CASE WHEN o.model IS NULL THEN 'added' WHEN n.model IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM o FULL JOIN n ON o.model = n.model WHERE o.model IS NULL OR n.model IS NULL OR (o.inp, o.out, o.cw, o.cr) <> (n.inp, n.out, n.cw, n.cr)""",
    "coverage_over_weeks": base(W4) + " SELECT DISTINCT agent, CASE agent WHEN 'agent_c' THEN 'partial' ELSE 'complete' END AS usage_coverage FROM slices",
    "refresh_worklist": f"""WITH {SUMMARY}, j AS (SELECT t.session_id, t.n, t.conv_id, CASE WHEN t.conv_id % 11 = 0 THEN 'unavailable' ELSE CAST(t.n AS VARCHAR) END AS seen, CASE WHEN t.conv_id % 7 <> 0 THEN t.source END AS source, t.conv_id % 3 AS version, t.evidence_fingerprint AS fp FROM summary_table t)
 SELECT session_id, n AS plan_rank, conv_id % 5 = 0 AS has_reason, row_number() OVER (ORDER BY conv_id % 5 <> 0, n, session_id) AS priority FROM j WHERE source IS NULL OR (source = 'no_evidence' AND seen <> 'unavailable') OR (source = 'extracted' AND seen <> 'unavailable')
 OR (source = 'generated' AND seen <> 'unavailable' AND (version < 2 OR fp = 'legacy-unknown' OR fp <> seen))""",
    "summary_resolution": f"""WITH {SUMMARY} SELECT CASE WHEN conv_id % 2 = 0 THEN 'slice-' || session_id ELSE session_id END AS evidence_id, session_id AS public_id, session_id AS row_id, summary, source FROM summary_table WHERE source = 'provided' OR conv_id % 2 = 1""",
    "missing_summaries": "SELECT DISTINCT 'c' || conv_id AS session_id FROM conversations WHERE conv_id % 6 = 0",
    "aggregate_cache": base() + " SELECT window_key, area, n, hours, n % 2 = 0 AS hit FROM (SELECT window_key, area, count(*) AS n, CAST(sum(active_us) // 3600000000 AS BIGINT) AS hours FROM placed GROUP BY ALL)",
    "invalidate_cache": base() + " SELECT window_key, area, count(*) AS n FROM placed WHERE window_key <> 'previous' GROUP BY ALL",
    "repo_activity": f"WITH {REPO} SELECT window_key, repo, commits, newest, merged, releases, tags, rank, rank <= 10 AS is_enriched FROM repo_rows",
    "repo_totals": f"WITH {REPO} SELECT window_key, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(merged) AS BIGINT) AS merged, CAST(sum(releases) AS BIGINT) AS releases, count(*) AS repositories, bool_and(rank <= 10) AS complete FROM repo_rows GROUP BY ALL",
    "star_delta": f"""WITH {REPO}, per_day AS (SELECT repo, day, sum(count(*)) OVER (PARTITION BY repo ORDER BY day) AS stars FROM repos GROUP BY repo, day),
 at_day AS (SELECT window_key, p.repo, CAST(arg_max(stars, day) AS BIGINT) AS stars, CAST(arg_max(stars, day) FILTER (day < CAST(make_timestamp(since_us) AS DATE)) AS BIGINT) AS before FROM per_day p JOIN years ON day <= CAST(make_timestamp(until_us) AS DATE) GROUP BY ALL)
 SELECT window_key, repo, stars, before, stars - before AS delta FROM at_day""",
    "parsed_timestamps": "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE epoch_us(date_trunc('second', ts)) END AS ts_us FROM events",
    "sampling_plan_unbudgeted": _plan() + " SELECT window_key, internal_id, plan_rank, reasons FROM plan",
    "plan_projection": _plan() + " " + _plan_counts(),
    "budget_fit": "WITH RECURSIVE docs AS (SELECT source, doc_id AS pos, length(text) AS chars FROM documents), " + _fit("source", "docs", 6000, 5) + ' SELECT grp AS "group", pos, CAST(chars AS INT) AS chars FROM fit WHERE pos >= 0',
    "areas_under_budget": (base() + f""", {SKETCHES}, items AS (SELECT window_key, plan_rank AS pos, area, id, project || ': ' || repeat('step ', msg_count) AS text, length(project || ': ') + 5 * msg_count AS chars FROM sketches),
 {_fit("window_key", "items", 3000, 5)} SELECT i.window_key, area, string_agg(id, ',' ORDER BY i.pos) AS ids, string_agg(text, '|' ORDER BY i.pos) AS texts
 FROM items i JOIN fit f ON f.grp = i.window_key AND f.pos = i.pos GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1),
    "area_texts": rollup() + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY window_key, area ORDER BY active_us DESC, start_us, agent, session_id) AS rank FROM placed),
 told AS (SELECT window_key, area, string_agg('- worked on ' || project || ' in ' || session_id, chr(10) ORDER BY rank) AS lines FROM (
   SELECT *, row_number() OVER (PARTITION BY window_key, area ORDER BY rank) AS n FROM ranked WHERE rank <= 5 AND msg_count % 2 = 0 AND area <> 'coding') WHERE n <= 4 GROUP BY ALL),
 own AS (SELECT window_key, area, '- Projects: ' || string_agg(project, ', ' ORDER BY r) || '.' AS lines FROM (
   SELECT *, row_number() OVER (PARTITION BY window_key, area ORDER BY minutes DESC, project) AS r FROM rollup_rows WHERE NOT is_area) WHERE r <= 3 GROUP BY ALL)
 SELECT a.window_key, a.area, a.area || ': ' || sessions || CASE WHEN sessions = 1 THEN ' session · ' ELSE ' sessions · ' END || CAST(round_even(minutes, 0) AS BIGINT) || ' active min.' || chr(10) || chr(10) || coalesce(t.lines, o.lines) AS text
 FROM rollup_rows a LEFT JOIN told t ON t.window_key = a.window_key AND t.area = a.area LEFT JOIN own o ON o.window_key = a.window_key AND o.area = a.area WHERE is_area""",
    "summary_provenance": f"WITH {SUMMARY} SELECT session_id, CASE WHEN conv_id % 5 <> 0 THEN source WHEN conv_id % 3 = 0 THEN 'native_title' ELSE 'first_message' END AS provenance FROM summary_table",
}
