"""Session queries: cards of sessions, one row a session, and three sources of events as of one time."""

from pyspark.sql import functions as F

from helixlake.operators import asof
from helixlake.operators import sessions as op
from helixlake.plans.registry import query
from helixlake.session import stored
from helixlake.sources import constants as k
from helixlake.sources import views as v

_PHASES = ["plan-created", "plan-warning", "context-attached", "interrupted", "blocked-dependency", "writeback-emitted", "task-started"]
_STATES = ["pending", "running", "done", "error", "cancelled"]


def _pick(words, i):
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def _sources(spark, sf_dir):
    """(sessions, steps, tasks, logs) out of customers, their orders and the lines of these."""
    c, n, o = F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderkey")
    cu, od = v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "orders")
    plan = lambda x: F.concat(F.lit("plan-"), x.cast("string"))
    sessions = cu.select(
        c.alias("session"), F.when(c % 19 == 0, "off-domain").when(c % 17 != 0, "scientific-pathway").alias("category"), F.col("c_mktsegment").alias("reason"), F.when(c % 5 != 0, plan(c)).alias("plan"), F.when(c % 5 != 0, c * 10).alias("plan_at"), (c % 3 == 0).alias("interrupted"),
        F.when(c % 4 == 0, F.col("c_name")).alias("context"), F.col("c_nationkey").alias("saved"), F.repeat("c_name", (c % 8).cast("int")).alias("request"),
    )
    steps = od.where("o_custkey % 5 <> 0").select(
        n.alias("session"), o.alias("place"), o.alias("step"), _pick(k.TOOLS, o % 14).alias("tool"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("objective"), F.when(o % 9 == 0, "unsupported").when(o % 8 == 0, "planned").otherwise("enqueued").alias("status"), F.when((o % 9 != 0) & (o % 4 != 0), o).alias("task"),
    )
    li = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.unix_date(F.col("l_shipdate").cast("date"))).cast("long").alias("day"), F.sum("l_partkey").alias("s"))
    li = li.join(od.select("o_orderkey", "o_custkey", "o_orderpriority"), li.l_orderkey == F.col("o_orderkey"))
    li = stored(li.select("o_orderkey", "o_custkey", "o_orderpriority", "l_linenumber", "day", "s"))  # read for tasks and for every use of the logs
    s, line = F.col("s"), F.col("l_linenumber")
    events = li.select(n.alias("session"), o.alias("task"), (s % 3).alias("at"), line.alias("event"), F.col("o_orderpriority").alias("label"), _pick(k.TOOLS, o % 14).alias("tool"), _pick(_STATES, s % 5).alias("status"), o.alias("created"), F.when(s % 2 == 0, s).alias("started"), F.when(s % 5 == 2, s + 1).alias("finished"))
    logs = li.select(n.alias("session"), (o * 10 + line).alias("log"), F.col("day").alias("at"), _pick(_PHASES, s % 7).alias("phase"), F.concat(F.lit("note "), s.cast("string")).alias("message"), F.when(s % 4 != 0, o).alias("task"), F.when(s % 6 != 0, _pick(k.TOOLS, o % 14)).alias("tool"), F.when(s % 3 != 0, plan(n)).alias("plan"), F.when(s % 5 != 0, s % 5 != 1).alias("ok"))
    return sessions, steps, stored(op.latest_tasks(events)), logs


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BASE = f"""sessions AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 19 = 0 THEN 'off-domain' WHEN c_custkey % 17 <> 0 THEN 'scientific-pathway' END AS category, c_mktsegment AS reason, CASE WHEN c_custkey % 5 <> 0 THEN 'plan-' || c_custkey END AS plan, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 END AS plan_at, c_custkey % 3 = 0 AS interrupted,
  CASE WHEN c_custkey % 4 = 0 THEN c_name END AS context, c_nationkey AS saved, repeat(c_name, c_custkey % 8) AS request FROM customer),
steps AS (SELECT o_custkey AS session, o_orderkey AS place, {_words(k.TOOLS)}[o_orderkey % 14 + 1] AS tool, o_orderpriority AS title, o_orderstatus AS objective, CASE WHEN o_orderkey % 9 = 0 THEN 'unsupported' WHEN o_orderkey % 8 = 0 THEN 'planned' ELSE 'enqueued' END AS status, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderkey END AS task FROM orders WHERE o_custkey % 5 <> 0),
lines AS (SELECT o_custkey AS session, o_orderkey, o_orderpriority, l_linenumber, epoch(min(CAST(l_shipdate AS DATE)))::BIGINT // 86400 AS day, sum(l_partkey)::BIGINT AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
tasks AS (SELECT session, o_orderkey AS task, o_orderpriority AS label, {_words(k.TOOLS)}[o_orderkey % 14 + 1] AS tool, {_words(_STATES)}[s % 5 + 1] AS status, o_orderkey AS created, CASE WHEN s % 2 = 0 THEN s END AS started, CASE WHEN s % 5 = 2 THEN s + 1 END AS finished FROM lines QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s % 3 DESC, l_linenumber DESC) = 1),
logs AS (SELECT session, o_orderkey * 10 + l_linenumber AS log, day AS "at", {_words(_PHASES)}[s % 7 + 1] AS phase, 'note ' || s AS message, CASE WHEN s % 4 <> 0 THEN o_orderkey END AS task, CASE WHEN s % 6 <> 0 THEN {_words(k.TOOLS)}[o_orderkey % 14 + 1] END AS tool, CASE WHEN s % 3 <> 0 THEN 'plan-' || session END AS plan, CASE WHEN s % 5 <> 0 THEN s % 5 <> 1 END AS ok FROM lines)"""
_CASE = lambda known, c: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in known.items()) + " END"
_CARDS = f"""{_BASE}, planned AS (SELECT * FROM sessions WHERE plan IS NOT NULL AND coalesce(category, '') <> 'off-domain'),
own AS (SELECT session, count(*) FILTER (phase IN ('plan-created', 'plan-warning')) AS n_plan, arg_max("at", ("at", -log)) FILTER (phase = 'context-attached') AS context_at, count(*) FILTER (task IS NULL) AS n_free FROM logs WHERE plan IS NOT NULL GROUP BY session),
broken AS (SELECT session, arg_max(log, ("at", -log)) AS log, arg_max(message, ("at", -log)) AS message, max("at") AS "at" FROM logs WHERE phase = 'interrupted' GROUP BY session),
chain AS (SELECT session, count(*) AS n, string_agg(tool, ' → ' ORDER BY place) AS tools FROM steps GROUP BY session), noted AS (SELECT session, task, count(*) AS n FROM logs WHERE task IS NOT NULL GROUP BY ALL),
cards AS (SELECT session, 0 AS section, 0 AS rank, 'step-classification' AS id, 'classification' AS kind, 'Classified request domain' AS title, 'done' AS status, reason AS detail, NULL::VARCHAR AS task, NULL::VARCHAR AS tool, NULL::BIGINT AS started, NULL::BIGINT AS finished, 0 AS n_logs FROM sessions WHERE category IS NOT NULL
 UNION ALL SELECT session, 1, 0, 'step-off-domain', 'off-domain-advisory', 'Query routed outside scope', 'info', 'no scientific tool', NULL, NULL, NULL, NULL, 0 FROM sessions WHERE category = 'off-domain'
 UNION ALL SELECT session, 2, 0, 'step-interrupted-' || log, 'interrupted', 'Session interrupted', 'interrupted', message, NULL, NULL, "at", NULL, 1 FROM sessions JOIN broken USING (session) WHERE interrupted
 UNION ALL SELECT session, 3, 0, 'step-planning-' || plan, 'planning', 'Built deterministic plan', 'done', CASE WHEN n IS NULL THEN 'Planner returned no actionable steps — warning recorded.' ELSE 'Planner proposed ' || n || ' step(s): ' || tools END, NULL, NULL, plan_at, NULL, coalesce(n_plan, 0) FROM planned LEFT JOIN chain USING (session) LEFT JOIN own USING (session)
 UNION ALL SELECT session, 4, 0, 'step-context-' || plan, 'context-attached', 'Attached workbench context', CASE WHEN context_at IS NULL THEN 'planned' ELSE 'done' END, coalesce(context, 'No active workbench context'), NULL, NULL, context_at, NULL, CASE WHEN context_at IS NULL THEN 0 ELSE 1 END FROM planned LEFT JOIN own USING (session)
 UNION ALL SELECT session, 5, 0, 'step-evidence-check', 'evidence-check', 'Checked evidence adapters', 'done', 'Workbench evidence ledger holds ' || saved || ' saved item(s); 1 adapter(s) wired.', NULL, NULL, NULL, NULL, 0 FROM planned
 UNION ALL SELECT s.session, 6, s.place, 'step-plan-' || s.place, CASE WHEN s.status = 'unsupported' THEN 'unsupported-step' ELSE 'plan-step' END, s.title, CASE WHEN s.status = 'unsupported' THEN 'unsupported' WHEN t.status IS NOT NULL THEN {_CASE(op.TASK_STATUS, 't.status')} ELSE {_CASE(op.STEP_STATUS, 's.status')} END, s.objective, t.task::VARCHAR, s.tool, t.started, t.finished, least(8, coalesce(CASE WHEN t.task IS NOT NULL THEN d.n ELSE own.n_free END, 0))
  FROM steps s JOIN planned p ON p.session = s.session LEFT JOIN tasks t ON t.session = s.session AND t.task = s.task LEFT JOIN noted d ON d.session = t.session AND d.task = t.task LEFT JOIN own ON own.session = s.session
 UNION ALL SELECT t.session, 7, t.created, 'step-task-' || t.task, 'plan-step', t.label, {_CASE(op.TASK_STATUS, 't.status')}, 'Ad-hoc ' || upper(t.tool) || ' task', t.task::VARCHAR, t.tool, t.started, t.finished, least(8, coalesce(d.n, 0)) FROM tasks t LEFT JOIN noted d ON d.session = t.session AND d.task = t.task WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.session = t.session AND s.task = t.task)
 UNION ALL SELECT session, CASE phase WHEN 'blocked-dependency' THEN 8 ELSE 9 END, -"at", CASE phase WHEN 'blocked-dependency' THEN 'step-blocked-' ELSE 'step-writeback-' END || log, CASE phase WHEN 'blocked-dependency' THEN 'blocked-dependency' ELSE 'writeback' END, CASE phase WHEN 'blocked-dependency' THEN 'Downstream step blocked' ELSE 'Writeback · ' || coalesce(upper(tool), 'AXON') END,
  CASE WHEN phase = 'blocked-dependency' THEN 'blocked' WHEN coalesce(ok, true) THEN 'done' ELSE 'failed' END, message, task::VARCHAR, tool, "at", NULL, 1 FROM logs WHERE phase IN ('blocked-dependency', 'writeback-emitted')),
placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY section, rank, id) AS place FROM cards)"""


@query(f"WITH {_CARDS} SELECT session, place, id, kind, title, status, detail, task, tool, started, finished, n_logs::BIGINT AS n_logs FROM placed")
def session_cards(spark, sf_dir):
    return op.cards(*_sources(spark, sf_dir)).drop("section", "rank")


_PLANNED = "kind IN ('plan-step', 'unsupported-step')"
_SUMS = {n: f"count(*) FILTER ({_PLANNED} AND status = '{s}')" for n, s in (("completed", "done"), ("failed", "failed"), ("cancelled", "cancelled"), ("unsupported", "unsupported"))} | {"blocked": f"count(*) FILTER ({_PLANNED} AND status = 'blocked' OR kind = 'blocked-dependency')", "interruptions": "count(*) FILTER (kind = 'interrupted')", "writeback": "count(*) FILTER (kind = 'writeback')"}
_NAMED = {n: "interrupted" if n == "interruptions" else n for n in _SUMS}


@query(f"""WITH {_CARDS}, g AS (SELECT session, {', '.join(f'{x} AS {n}' for n, x in _SUMS.items())}, count(*) AS n_cards, coalesce(arg_min(id, place) FILTER (status = 'running'), arg_min(id, place) FILTER (status = 'waiting'), arg_min(id, place) FILTER (status = 'blocked'), arg_max(id, place)) AS current FROM placed GROUP BY session),
st AS (SELECT s.session, count(*) AS n, count(*) FILTER (s.status <> 'unsupported') AS able, count(*) FILTER (s.status <> 'unsupported' AND t.status IS NOT NULL) AS tasks, {', '.join(f"count(*) FILTER (s.status <> 'unsupported' AND t.status = '{x}') AS {x}" for x in _STATES)} FROM steps s LEFT JOIN tasks t ON t.session = s.session AND t.task = s.task GROUP BY s.session),
lg AS (SELECT session, max("at") AS logged FROM logs GROUP BY session), tk AS (SELECT session, min(created) AS created FROM tasks GROUP BY session),
o AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN {n} || ' {w}' END" for n, w in _NAMED.items())}], lambda x: x IS NOT NULL) AS parts FROM g)
SELECT s.session, CASE WHEN category = 'off-domain' THEN 'Off-domain request · no plan' WHEN plan IS NOT NULL AND chain.tools IS NOT NULL THEN 'Session · ' || upper(chain.tools) WHEN plan IS NOT NULL THEN 'Session · planner returned no steps' WHEN context IS NOT NULL THEN 'Session · awaiting plan' ELSE 'Session · idle' END AS title,
 CASE WHEN interrupted THEN 'interrupted' WHEN coalesce(category, '') = 'off-domain' THEN 'off-domain' WHEN plan IS NULL THEN 'idle' WHEN coalesce(able, 0) = 0 THEN 'unsupported' WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'waiting' WHEN st.tasks = 0 THEN 'planning' WHEN done = st.tasks THEN 'completed' WHEN error > 0 AND done > 0 THEN 'partial' WHEN error > 0 THEN 'failed' WHEN st.cancelled > 0 THEN 'cancelled' ELSE 'waiting' END AS status,
 CASE WHEN length(request) <= 96 THEN request ELSE rtrim(request[1:95]) || '…' END AS request, coalesce(plan_at, created) AS started, coalesce(logged, plan_at, created) AS last_activity, current, {', '.join(f'coalesce(o.{n}, 0) AS {n}' for n in [*_SUMS, 'n_cards'])}, coalesce(o.failed > 0 OR o.cancelled > 0 OR o.blocked > 0 OR o.interruptions > 0, false) AS needs_user, CASE WHEN coalesce(len(parts), 0) = 0 THEN 'No steps executed yet.' ELSE array_to_string(parts, ' · ') END AS headline
FROM sessions s LEFT JOIN o ON o.session = s.session LEFT JOIN st ON st.session = s.session LEFT JOIN lg ON lg.session = s.session LEFT JOIN tk ON tk.session = s.session LEFT JOIN chain ON chain.session = s.session""")
def session_overview(spark, sf_dir):
    sessions, steps, tasks, logs = _sources(spark, sf_dir)
    return op.overview(sessions, steps, tasks, logs, op.cards(sessions, steps, tasks, logs))


@query("""WITH p AS (SELECT o_custkey AS who, epoch_us(o_orderdate)::BIGINT // 86400000000 AS "at", o_orderkey AS tie FROM orders), t AS (SELECT o_custkey AS who, epoch_us(min(l_shipdate))::BIGINT // 86400000000 AS "at", o_orderkey AS tie FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), e AS (SELECT user_id AS who, epoch_us(ts)::BIGINT // 86400000000 - 10000 + event_id % 3000 AS "at", event_id AS tie FROM events),
b AS (SELECT who, "at", 0 AS r, 'plan' AS source, tie FROM p UNION ALL SELECT who, "at", 1, 'task', tie FROM t UNION ALL SELECT who, "at", 2, 'log', tie FROM e),
l AS (SELECT *, last_value(CASE WHEN r = 0 THEN tie END IGNORE NULLS) OVER w AS plan, last_value(CASE WHEN r = 1 THEN tie END IGNORE NULLS) OVER w AS task, last_value(CASE WHEN r = 2 THEN tie END IGNORE NULLS) OVER w AS log FROM b WINDOW w AS (PARTITION BY who ORDER BY "at", r, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT who, "at", source, tie, plan, task, log FROM l""")
def session_timeline(spark, sf_dir):
    """Orders, their first shipment and events of a customer, each with the last of the other two before it."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    o, n = v.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    plans = o.select(F.col("o_custkey").alias("who"), day("o_orderdate").alias("at"), n.alias("tie"), n.alias("plan"))
    ships = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("l_shipdate"))
    tasks = o.join(ships, n == F.col("l_orderkey")).select(F.col("o_custkey").alias("who"), day("l_shipdate").alias("at"), n.alias("tie"), n.alias("task"))
    e = F.col("event_id")
    logs = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), (day("ts") - 10000 + e % 3000).alias("at"), e.alias("tie"), e.alias("log"))
    return asof.as_of({"plan": plans, "task": tasks, "log": logs}, ["who"], "at", "tie")
