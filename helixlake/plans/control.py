"""Workflow-control, provenance and admission queries."""

from pyspark.sql import functions as F

from helixlake.operators import control, trust
from helixlake.plans.registry import query
from helixlake.plans.tools import values
from helixlake.sources import constants as k
from helixlake.sources import views as v


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STATUSES = f"""s0 AS (SELECT o_custkey AS project, {_list(k.GOLDEN_PATH)}[o_orderkey % 6 + 1] AS tool, o_orderkey AS k, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
statuses AS (SELECT project, tool, k % 10 <> 0 AS has_outputs, CASE WHEN k % 10 = 0 THEN ['result.a', 'result.b'] ELSE [] END AS missing, CASE o_orderstatus WHEN 'F' THEN 'real' WHEN 'O' THEN CASE WHEN k % 7 = 0 THEN 'demo' ELSE 'partial' END END AS validity,
 CASE WHEN k % 8 = 7 THEN NULL WHEN k % 4 = 0 THEN (o_totalprice % 100) / 100 ELSE 1.0 END AS confidence, CASE WHEN k % 5 <> 0 THEN 0.1 END AS uncertainty, k % 13 = 0 AS simulated, coalesce(['blocked', 'gated', 'demoOnly', 'simulated'][k % 12 + 1], 'ok') AS run_status FROM s0 WHERE n = 1)"""
_EVIDENCE = "evidence AS (SELECT user_id AS project, ['literature', 'analysis', 'tool', 'system', 'other'][event_id % 5 + 1] AS kind FROM events), coverage AS (SELECT project, count(*)::INTEGER AS have, list(DISTINCT kind) FILTER (kind <> 'other') AS have_kinds FROM evidence GROUP BY project)"
_CONTRACTS = values("contracts", "tool, scope, intent, floor, min_confidence, bounded, min_evidence, kinds, gate_on_missing, human, min_text", [(*c, None if c[4] is None else f"{c[4]:g}") for c in k.CONTRACTS])
_RANK = "CASE {} WHEN 'demo' THEN 0 WHEN 'partial' THEN 1 WHEN 'real' THEN 2 END"
_EVALUATED = f"""{_STATUSES}, {_EVIDENCE}, {_CONTRACTS}, e0 AS (SELECT s.*, c.* EXCLUDE (tool), coalesce(v.have, 0) AS have, list_filter(c.kinds, lambda x: NOT list_contains(coalesce(v.have_kinds, []), x)) AS missing_kinds,
 coalesce({_RANK.format('s.validity')} >= {_RANK.format('c.floor')}, false) AS validity_ok, c.min_confidence IS NULL OR coalesce(s.confidence >= c.min_confidence, false) AS confidence_ok, NOT c.bounded OR s.uncertainty IS NOT NULL AS uncertainty_ok FROM statuses s JOIN contracts c USING (tool) LEFT JOIN coverage v USING (project)),
e1 AS (SELECT *, have >= min_evidence AND len(missing_kinds) = 0 AS evidence_ok FROM e0),
evaluated AS (SELECT *, has_outputs AND NOT simulated AND validity_ok AND confidence_ok AND uncertainty_ok AS ok,
 list_filter([CASE WHEN NOT has_outputs THEN 'REQUIRED_OUTPUTS_MISSING' END, CASE WHEN NOT validity_ok THEN 'VALIDITY_BELOW_FLOOR' END, CASE WHEN NOT confidence_ok THEN 'CONFIDENCE_BELOW_FLOOR' END, CASE WHEN NOT uncertainty_ok THEN 'UNCERTAINTY_UNBOUNDED' END, CASE WHEN NOT evidence_ok THEN 'EVIDENCE_MISSING' END, CASE WHEN simulated THEN 'SIMULATED_OUTPUT' END], lambda x: x IS NOT NULL) AS codes,
 array_to_string(list_filter([CASE WHEN NOT has_outputs THEN 'required outputs missing: ' || array_to_string(missing, ', ') END, CASE WHEN validity_ok THEN NULL WHEN validity IS NULL THEN 'validity missing; floor ' || floor ELSE 'validity ' || validity || ' below floor ' || floor END, CASE WHEN NOT confidence_ok THEN 'confidence below ' || min_text END, CASE WHEN NOT uncertainty_ok THEN 'uncertainty gate unresolved' END,
  CASE WHEN NOT evidence_ok THEN 'evidence ' || have || '/' || min_evidence || CASE WHEN len(missing_kinds) > 0 THEN '; missing ' || array_to_string(missing_kinds, ', ') ELSE '' END END, CASE WHEN simulated THEN 'payload is demo/simulated' END], lambda x: x IS NOT NULL), '; ') AS reason FROM e1)"""


def _statuses(spark, sf_dir):
    from pyspark.sql import Window

    n, golden = F.col("o_orderkey"), F.array(*map(F.lit, k.GOLDEN_PATH))
    o = v.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.get(golden, (n % 6).cast("int")).alias("tool"))
    last = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", "tool").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("n = 1")
    none = F.array().cast("array<string>")
    runs = F.array(*map(F.lit, ["blocked", "gated", "demoOnly", "simulated"]))
    return last.select(
        F.col("o_custkey").alias("project"), "tool", (n % 10 != 0).alias("has_outputs"), F.when(n % 10 == 0, F.array(F.lit("result.a"), F.lit("result.b"))).otherwise(none).alias("missing"),
        F.when(F.col("o_orderstatus") == "F", "real").when(F.col("o_orderstatus") == "O", F.when(n % 7 == 0, "demo").otherwise("partial")).alias("validity"),
        F.when(n % 8 == 7, None).when(n % 4 == 0, (F.col("o_totalprice") % 100) / 100).otherwise(1.0).alias("confidence"), F.when(n % 5 != 0, 0.1).alias("uncertainty"), (n % 13 == 0).alias("simulated"),
        F.coalesce(F.get(runs, (n % 12).cast("int")), F.lit("ok")).alias("run_status"),
    )


def _coverage(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["literature", "analysis", "tool", "system", "other"]))
    return control.evidence_coverage(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind")))


def _evaluated(spark, sf_dir):
    return control.evaluate(_statuses(spark, sf_dir), control.contracts(spark), _coverage(spark, sf_dir))


@query(f"WITH {_EVIDENCE} SELECT project, have, list_sort(have_kinds) AS have_kinds FROM coverage")
def evidence_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("have_kinds", F.sort_array("have_kinds"))


@query(f"WITH {_EVALUATED} SELECT project, tool, validity_ok, confidence_ok, uncertainty_ok, evidence_ok, missing_kinds, codes, reason FROM evaluated")
def contract_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("project", "tool", "validity_ok", "confidence_ok", "uncertainty_ok", "evidence_ok", "missing_kinds", "codes", "reason")


_GATED = f"""{_EVALUATED}, {values('inputs', 'tool, up', k.REQUIRED_INPUTS)}, n AS (SELECT e.project, e.tool, i.up, list_filter([CASE WHEN u.ok IS NULL THEN upper(i.up) || ' payload missing' END, CASE WHEN NOT u.ok THEN upper(i.up) || ' contract unsatisfied: ' || u.reason END,
 CASE WHEN u.run_status IN ('blocked', 'gated', 'demoOnly') THEN upper(i.up) || ' is itself ' || u.run_status END, CASE WHEN u.run_status = 'simulated' THEN upper(i.up) || ' is simulated' END], lambda x: x IS NOT NULL) AS why FROM evaluated e JOIN inputs i USING (tool) LEFT JOIN evaluated u ON u.project = e.project AND u.tool = i.up),
gates AS (SELECT e.project, e.tool, CASE WHEN coalesce(len(n.why), 0) > 0 OR NOT has_outputs THEN 'blocked' WHEN simulated THEN 'demoOnly' WHEN ok THEN 'ok' ELSE 'gated' END AS status, CASE WHEN len(n.why) > 0 THEN [n.up] ELSE [] END AS blocking, CASE WHEN len(n.why) > 0 THEN array_to_string(n.why, '; ') WHEN ok THEN '' ELSE reason END AS reason,
 len(human) > 0 OR NOT (coalesce(len(n.why), 0) > 0 OR NOT has_outputs) AND NOT ok AS human_gate FROM evaluated e LEFT JOIN n ON n.project = e.project AND n.tool = e.tool)"""


@query(f"WITH {_GATED} SELECT * FROM gates")
def contract_gate(spark, sf_dir):
    return control.gate(_evaluated(spark, sf_dir), spark.createDataFrame(k.REQUIRED_INPUTS, "tool string, up string").coalesce(1))


_STATES = f"""place AS (SELECT tool, n FROM (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(k.GOLDEN_PATH, 1))}) p(tool, n)), run AS (SELECT project, n, row_number() OVER (PARTITION BY project ORDER BY n) AS k, min(ok::INTEGER) OVER (PARTITION BY project ORDER BY n) AS good FROM evaluated JOIN place USING (tool)),
states AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 10 = 3 THEN 5 WHEN c_custkey % 10 = 4 THEN 1 WHEN c_custkey % 30 = 5 THEN 7 ELSE 1 + coalesce((SELECT count(*) FROM run WHERE run.project = c_custkey AND good = 1 AND k = n), 0) END AS place FROM customer)"""
_DECISIONS = f"""{_EVALUATED}, {_STATES}, d0 AS (SELECT project, place, CASE WHEN place > 0 THEN {_list(k.GOLDEN_PATH)}[least(place, 6)] END AS tool, CASE WHEN place > 1 THEN {_list(k.GOLDEN_PATH)}[place - 1] END AS before FROM states),
d1 AS (SELECT d.*, c.min_evidence, coalesce(c.kinds, []) AS kinds, c.gate_on_missing, coalesce(len(c.human) > 0, false) AS human, e.ok, e.simulated, e.confidence, e.uncertainty, e.validity, b.ok AS before_ok, coalesce(v.have, 0) AS have, coalesce(v.have_kinds, []) AS have_kinds
 FROM d0 d LEFT JOIN contracts c ON c.tool = d.tool LEFT JOIN evaluated e ON e.project = d.project AND e.tool = d.tool LEFT JOIN evaluated b ON b.project = d.project AND b.tool = d.before LEFT JOIN coverage v ON v.project = d.project),
d2 AS (SELECT *, list_filter(kinds, lambda x: NOT list_contains(have_kinds, x)) AS missing FROM d1),
d3 AS (SELECT *, CASE WHEN place = 7 THEN 1 WHEN place = 0 THEN 2 WHEN before IS NOT NULL AND NOT coalesce(before_ok, false) THEN 3 WHEN gate_on_missing AND (have < min_evidence OR len(missing) > 0) THEN 4 WHEN coalesce(simulated, false) THEN 5 WHEN NOT coalesce(ok, false) THEN 6 ELSE 7 END AS rule FROM d2),
decisions AS (SELECT project, ['complete', 'idle', 'blocked', 'gated', 'demoOnly', 'ready', 'ready'][rule] AS status, tool, CASE rule WHEN 1 THEN NULL WHEN 2 THEN 'pathd' WHEN 3 THEN before WHEN 7 THEN {_list(k.GOLDEN_PATH)}[place + 1] ELSE tool END AS next, ['DBTL_COMMITTED', 'NO_TARGET', 'UPSTREAM_BLOCKED', 'EVIDENCE_GATE', 'DEMO_ONLY', 'CURRENT_TOOL_NOT_READY', 'CURRENT_TOOL_SATISFIED'][rule] AS code, have,
 CASE WHEN place BETWEEN 1 AND 6 THEN missing ELSE [] END AS missing_kinds, CASE WHEN place > 0 THEN confidence END AS confidence, CASE WHEN rule = 5 THEN uncertainty::DOUBLE END AS uncertainty, CASE WHEN place > 0 THEN validity END AS validity, CASE WHEN rule = 2 THEN false WHEN rule IN (4, 5) THEN true WHEN rule = 7 THEN place IN (4, 5) ELSE human END AS human_gate FROM d3)"""


def _decisions(spark, sf_dir):
    evaluated = _evaluated(spark, sf_dir)
    golden = F.array(*map(F.lit, k.GOLDEN_PATH))
    reached = trust.golden_prefix(evaluated.select("project", F.array_position(golden, F.col("tool")).cast("int").alias("place"), control.advances().alias("ok"))).select("project", "reached")
    c, n = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project")), F.col("project")
    place = F.when(n % 8 == 0, 0).when(n % 10 == 3, 5).when(n % 10 == 4, 1).when(n % 30 == 5, 7).otherwise(1 + F.coalesce("reached", F.lit(0)))
    projects = c.join(reached, "project", "left").select("project", F.get(F.array(*map(F.lit, k.STATES)), place.cast("int")).alias("state"))
    return control.decide(projects, evaluated, _coverage(spark, sf_dir))


@query(f"WITH {_DECISIONS} SELECT * FROM decisions")
def workflow_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(f"""WITH {_DECISIONS}, last AS (SELECT o_custkey AS project, arg_max({_list(k.TOOLS)}[o_orderkey % 14 + 1], (o_orderdate, o_orderkey)) AS run_tool, arg_max(coalesce(['blocked', 'gated', 'demoOnly', 'simulated'][o_orderkey % 6 + 1], 'ok'), (o_orderdate, o_orderkey)) AS run_status, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN [{_list(k.TOOLS)}[o_orderkey % 5 + 1]] ELSE [] END, (o_orderdate, o_orderkey)) AS run_blocking FROM orders GROUP BY 1),
g AS (SELECT d.*, run_tool, run_status, run_blocking, CASE WHEN run_tool IN ({', '.join(f"'{c[0]}'" for c in k.CONTRACTS if c[1] == 'workflow')}) AND run_status IN ('blocked', 'gated', 'demoOnly') THEN run_status END AS gate FROM decisions d LEFT JOIN last USING (project))
SELECT project, coalesce(gate, status) AS status, tool, CASE WHEN gate = 'blocked' THEN coalesce(run_blocking[1], next) ELSE next END AS next, list_filter([code, CASE WHEN gate IS NOT NULL THEN 'LATEST_RUN_' || upper(gate) END], lambda x: x IS NOT NULL) AS codes, human_gate OR coalesce(gate, status) IN ('gated', 'demoOnly') AS human_gate, coalesce(gate, status) = 'demoOnly' AS demo_only, run_tool, run_status FROM g""")
def workflow_snapshot(spark, sf_dir):
    n = F.col("o_orderkey")
    tools, runs = F.array(*map(F.lit, k.TOOLS)), F.array(*map(F.lit, ["blocked", "gated", "demoOnly", "simulated"]))
    run = F.struct(F.get(tools, (n % 14).cast("int")).alias("run_tool"), F.coalesce(F.get(runs, (n % 6).cast("int")), F.lit("ok")).alias("run_status"), F.when(n % 4 == 0, F.array(F.get(tools, (n % 5).cast("int")))).otherwise(F.array().cast("array<string>")).alias("run_blocking"))
    last = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.max_by(run, F.struct("o_orderdate", "o_orderkey")).alias("r")).select("project", "r.*")
    return control.snapshot(_decisions(spark, sf_dir), last)


_ENTRIES = """entries AS (SELECT o_custkey AS payload, o_orderkey AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'prov:' || o_orderkey END AS provenance_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS tool, o_custkey * 10 + o_orderkey % 10 AS timestamp, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ['prov:' || (o_orderkey - 3), o_orderpriority || ':' || (o_custkey * 10 + (o_orderkey + 1) % 10)] END AS upstream FROM orders)"""


def _chains(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    e = v.table(spark, sf_dir, "orders").select(
        c.alias("payload"), n.alias("place"),
        F.struct(
            F.when(n % 3 == 0, F.concat(F.lit("prov:"), n.cast("string"))).alias("provenance_id"), F.when(n % 11 != 0, F.col("o_orderpriority")).alias("tool"), (c * 10 + n % 10).alias("timestamp"),
            F.when(n % 5 != 0, F.array(F.concat(F.lit("prov:"), (n - 3).cast("string")), F.concat_ws(":", "o_orderpriority", (c * 10 + (n + 1) % 10).cast("string")))).alias("upstream"),
        ).alias("entry"),
    )
    payloads = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("payload"), F.lit(None).cast("array<struct<provenance_id:string,tool:string,timestamp:bigint,upstream:array<string>>>").alias("entries"))
    return control.attach_provenance(payloads, e)


@query(f"WITH {_ENTRIES} SELECT c_custkey AS payload, count(place) AS n_entries, string_agg(coalesce(provenance_id, tool || ':' || timestamp, '-'), ',' ORDER BY place) AS chain FROM customer LEFT JOIN entries ON payload = c_custkey GROUP BY c_custkey")
def provenance_chains(spark, sf_dir):
    name = lambda e: F.coalesce(e["provenance_id"], F.when(e["tool"].isNotNull(), F.concat_ws(":", e["tool"], e["timestamp"].cast("string"))), F.lit("-"))
    return _chains(spark, sf_dir).select("payload", F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("entries", name), ","), F.lit("-")).alias("chain")).select("payload", F.greatest("n", F.lit(0)).alias("n_entries"), "chain")


@query(f"""WITH {_ENTRIES}, kept AS (SELECT payload, place, coalesce(provenance_id, tool || ':' || timestamp) AS id, coalesce(upstream, []) AS upstream FROM entries WHERE provenance_id IS NOT NULL OR tool IS NOT NULL), firsts AS (SELECT payload, id, min(place) AS place FROM kept GROUP BY ALL), ids AS (SELECT payload, list(id ORDER BY place) AS ids FROM firsts GROUP BY payload),
ups AS (SELECT payload, place, unnest(upstream) AS up, generate_subscripts(upstream, 1) AS j FROM kept), gone AS (SELECT payload, list(up ORDER BY o) AS missing FROM (SELECT payload, up, min((place, j)) AS o FROM ups WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.payload = ups.payload AND f.id = ups.up) GROUP BY ALL) GROUP BY payload)
SELECT c_custkey AS payload, coalesce(ids, []) AS ids, len(coalesce(ids, []))::INTEGER AS length, coalesce(missing, []) AS missing, len(coalesce(missing, [])) > 0 AS has_missing FROM customer LEFT JOIN ids ON ids.payload = c_custkey LEFT JOIN gone ON gone.payload = c_custkey""")
def chain_diagnostics(spark, sf_dir):
    return control.chain_diagnostics(_chains(spark, sf_dir))


_ALL_TOOLS = [*k.TOOLS, "fbasim-single", "fbasim-community", "other"]
_ASSUMED = [a for a, _ in k.ASSUMPTIONS] + ["unknown.one"]


@query(f"""WITH {values('tiers', 'tool, tool_tier', [*k.TOOL_TIERS, *k.SUB_TOOL_TIERS])}, {values('known', 'a, severity', k.ASSUMPTIONS)}, p AS (SELECT o_orderkey AS payload, {_list(_ALL_TOOLS)}[o_orderkey % {len(_ALL_TOOLS)} + 1] AS tool, CASE WHEN o_orderkey % 4 = 0 THEN 'real' END AS validity, o_orderkey % 3 <> 0 AS has, {_list(_ALL_TOOLS)}[o_custkey % {len(_ALL_TOOLS)} + 1] AS run_tool, CASE WHEN o_orderkey % 5 < 3 THEN {_list(k.TIERS)}[o_orderkey % 5 + 1] END AS run_tier,
 list_slice({_list(_ASSUMED)}, o_orderkey % {len(_ASSUMED)} + 1, o_orderkey % {len(_ASSUMED)} + 6) AS assumptions FROM orders), q AS (SELECT *, CASE WHEN has THEN assumptions ELSE [] END AS there FROM p)
SELECT payload, has AS trusted, coalesce(CASE WHEN has THEN run_tool END, q.tool) AS source_tool, coalesce(CASE WHEN has THEN run_tier END, validity, tool_tier, 'unknown') AS source_validity, list_filter(there, lambda x: list_contains({_list(a for a, s in k.ASSUMPTIONS if s == 'blocking')}, x)) AS blocking, list_filter(there, lambda x: list_contains({_list(a for a, s in k.ASSUMPTIONS if s == 'warning')}, x)) AS warnings FROM q LEFT JOIN tiers ON tiers.tool = q.tool""")
def trust_states(spark, sf_dir):
    n = F.col("o_orderkey")
    names, assumed, tiers = (F.array(*map(F.lit, x)) for x in (_ALL_TOOLS, _ASSUMED, k.TIERS))
    p = v.table(spark, sf_dir, "orders").select(
        n.alias("payload"), F.get(names, (n % len(_ALL_TOOLS)).cast("int")).alias("tool"), F.when(n % 4 == 0, "real").alias("validity"), (n % 3 != 0).alias("has_provenance"), F.get(names, (F.col("o_custkey") % len(_ALL_TOOLS)).cast("int")).alias("run_tool"),
        F.get(tiers, (n % 5).cast("int")).alias("run_tier"), F.slice(assumed, (n % len(_ASSUMED) + 1).cast("int"), F.lit(6)).alias("assumptions"),
    )
    return control.trust_state(p)


def _payload_json(spark, sf_dir):
    n = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fields = F.array_join(F.filter(F.array(
        F.when(n % 4 == 0, '"validity":"real"').when(n % 4 == 1, '"validity":"odd"'), F.when(n % 5 == 0, '"isDraft":true').when(n % 5 == 1, '"feedbackSource":"draft"').when(n % 5 == 2, '"isDraft":"yes"'),
        F.when(n % 7 == 0, '"humanGateStatus":"rejected"').when(n % 7 == 1, '"humanGateApproved":true').when(n % 7 == 2, '"humanGateApproved":false').when(n % 7 == 3, '"humanGateStatus":"later"'),
        F.when(n % 3 != 0, text('"runProvenance":{"toolId":"', F.col("o_orderpriority"), '",', F.when(n % 9 == 1, "").otherwise(text('"timestamp":', n, ",")), '"validityTier":"partial","evidence":[{"id":"e', n % 10, '"},{"x":1},{"id":"f"}],"inputAssumptions":["a"],"outputAssumptions":["b","c', n % 6, '"]}')),
    ), lambda x: x.isNotNull()), ",")
    json = F.when(n % 17 == 0, "no json").otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    surfaces = F.array(*[F.lit(s[0]) for s in k.SURFACES])
    return v.table(spark, sf_dir, "orders").select(n.alias("payload"), F.get(F.array(*map(F.lit, k.TOOLS)), (n % 14).cast("int")).alias("tool"), F.get(surfaces, (n % 5).cast("int")).alias("surface"), json.alias("json"), F.when(n % 2 == 0, "demo").alias("fallback"))


_ADMISSION = f"""p AS (SELECT o_orderkey AS payload, o_orderkey AS n, o_orderkey % 17 = 0 AS bad, {_list(k.TOOLS)}[o_orderkey % 14 + 1] AS tool, {_list(s[0] for s in k.SURFACES)}[o_orderkey % 5 + 1] AS surface, o_orderpriority, NOT (o_orderkey % 17 = 0) AND o_orderkey % 3 <> 0 AS has FROM orders),
a AS (SELECT payload, tool, surface, coalesce(CASE WHEN NOT bad AND n % 4 = 0 THEN 'real' END, CASE WHEN has THEN 'partial' END, CASE WHEN n % 2 = 0 THEN 'demo' END) AS tier, NOT bad AND n % 5 IN (0, 1) AS draft, CASE WHEN has AND n % 9 <> 1 THEN [o_orderpriority || ':' || n] ELSE [] END AS provenance_ids, CASE WHEN has THEN ['e' || (n % 10), 'f'] ELSE [] END AS evidence_ids,
 CASE WHEN has THEN ['a', 'b', 'c' || (n % 6)] ELSE [] END AS assumptions, CASE WHEN bad THEN NULL ELSE CASE n % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' WHEN 2 THEN 'pending' END END AS human FROM p)"""


@query(f"WITH {_ADMISSION} SELECT * FROM a")
def admission_inputs(spark, sf_dir):
    return control.admission_input(_payload_json(spark, sf_dir)).drop("json", "fallback")


@query(f"""WITH {_ADMISSION}, {values('surfaces', 'surface, allowed, needs_provenance, needs_gate, denies_drafts', k.SURFACES)}, j AS (SELECT a.*, s.allowed, needs_provenance, needs_gate AND coalesce(human, 'pending') <> 'approved' AS gate, denies_drafts FROM a JOIN surfaces s USING (surface)),
d AS (SELECT *, CASE WHEN tier IS NULL THEN 2 WHEN draft AND denies_drafts THEN 3 WHEN NOT list_contains(allowed, tier) THEN 4 WHEN needs_provenance AND len(provenance_ids) = 0 THEN 5 WHEN gate AND coalesce(human, 'pending') = 'rejected' THEN 6 WHEN gate THEN 7 WHEN tier = 'demo' THEN 8 ELSE 9 END AS rule FROM j)
SELECT payload, CASE WHEN rule <= 6 THEN 'blocked' WHEN rule = 7 THEN 'gated' WHEN rule = 8 THEN 'demoOnly' ELSE 'ok' END AS status, rule >= 8 AS write FROM d""")
def payload_admission(spark, sf_dir):
    x = control.admission_input(_payload_json(spark, sf_dir)).withColumn("provenance", F.size("provenance_ids"))
    return control.admit(x, trust.policies(spark)).select("payload", "status", "write")


@query(f"""WITH x AS (SELECT o_orderkey AS run, {_list(k.TOOLS)}[o_orderkey % 14 + 1] AS tool, o_orderkey % 5 = 0 AS simulated, o_custkey % 3 = 0 OR o_custkey % 4 = 0 AS linked, o_orderkey % 2 = 0 AS committed FROM orders)
SELECT run, CASE WHEN tool IN ({', '.join(f"'{t}'" for t in k.EXPERIMENT_TOOLS)}) THEN 'experiment' ELSE 'analysis' END AS category, upper(tool) || ' run' AS title, CASE WHEN simulated THEN 'simulated' WHEN tool IN ({', '.join(f"'{t}'" for t in k.EXPERIMENT_TOOLS)}) THEN 'experiment-backed' WHEN linked THEN 'evidence-linked' ELSE 'contextual' END AS authority,
 CASE WHEN tool = 'dbtlflow' AND committed THEN 'committed' WHEN simulated THEN 'simulated' ELSE 'recorded' END AS status FROM x""")
def experiment_records(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return control.experiment_records(v.table(spark, sf_dir, "orders").select(
        n.alias("run"), F.get(F.array(*map(F.lit, k.TOOLS)), (n % 14).cast("int")).alias("tool"), (n % 5 == 0).alias("simulated"), F.when(c % 3 == 0, "s").otherwise("").alias("source"), F.when(c % 4 == 0, "r").alias("analyze_ref"), F.when(n % 2 == 0, "committed").otherwise("draft").alias("feedback_source"),
    ))


def _fnv36(s: str) -> str:
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    digits = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36**i}) % 36 + 1)::INTEGER, 1)" for i in range(6, -1, -1))
    return f"(SELECT CASE WHEN h = 0 THEN '0' ELSE ltrim({digits}, '0') END FROM (SELECT {h} AS h))"


@query(f"""WITH c AS (SELECT o_orderkey AS run, {_list(k.TOOLS)}[o_orderkey % 14 + 1] AS tool, CASE WHEN o_orderkey % 2 = 0 THEN '"export"' ELSE 'null' END AS surface, CASE WHEN o_orderkey % 3 = 0 THEN '["a","b' || (o_orderkey % 5) || '","a"," "]' ELSE '[]' END AS inputs, CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b' || (o_orderkey % 5)] ELSE [] END AS kept, o_orderdate::VARCHAR AS started, CASE WHEN o_orderkey % 4 = 0 THEN '"' || o_orderdate::VARCHAR || '"' ELSE 'null' END AS completed FROM orders),
j AS (SELECT *, '{{"toolId":"' || tool || '","activityType":"simulation","surface":' || surface || ',"actor":null,"inputAssumptionIds":' || inputs || ',"outputAssumptionIds":[],"evidenceIds":["e' || (run % 7) || '"],"upstreamProvenanceIds":[],"startedAt":"' || started || '","completedAt":' || completed || '}}' AS material FROM c)
SELECT run, 'provenance:' || tool || ':simulation:' || {_fnv36('material')} AS provenance_id, kept AS inputs FROM j""")
def provenance_ids(spark, sf_dir):
    n, date = F.col("o_orderkey"), F.col("o_orderdate").cast("string")
    none = F.lit(None).cast("array<string>")
    c = v.table(spark, sf_dir, "orders").select(
        n.alias("run"), F.get(F.array(*map(F.lit, k.TOOLS)), (n % 14).cast("int")).alias("tool"), F.lit("simulation").alias("activity"), F.when(n % 2 == 0, "export").alias("surface"), F.lit(None).cast("string").alias("actor"),
        F.when(n % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), (n % 5).cast("string")), F.lit("a"), F.lit(" "))).alias("inputs"), none.alias("outputs"), F.array(F.concat(F.lit("e"), (n % 7).cast("string"))).alias("evidence"), none.alias("upstream"),
        date.alias("started"), F.when(n % 4 == 0, date).alias("completed"),
    )
    return control.provenance_entries(c).select("run", "provenance_id", "inputs")
