"""Ledger, trust and dependency-graph queries."""

from pyspark.sql import functions as F

from helixlake.operators import graph, ledger, trust
from helixlake.plans.registry import query
from helixlake.plans.tools import values
from helixlake.sources import constants as k
from helixlake.sources import views as v

TOOL_EDGES = values("edges", "a, b, kind, mode", k.EDGES)
TIERS = values("tools", "tool, tier", k.TOOL_TIERS)
_SURFACES = values("surfaces", "surface, allowed, needs_provenance, needs_gate, denies_drafts", k.SURFACES)
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, tool ORDER BY created DESC, revision DESC) AS n FROM runs) WHERE n = 1)"
#: Which priority's runs feed which others', for staleness over the runs view.
FEEDS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "5-LOW"), ("1-URGENT", "5-LOW")]


#: Tools of the runs view.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def feeds(spark):
    return spark.createDataFrame([(*f, i) for i, f in enumerate(FEEDS)], "a string, b string, place int")


@query(f"WITH {v.RUNS}, {_LATEST} SELECT project, tool, created, revision, status FROM latest")
def latest_run_per_tool(spark, sf_dir):
    return ledger.latest(v.runs(spark, sf_dir), ["project", "tool"], [F.desc("created"), F.desc("revision")])


@query(f"WITH {v.RUNS} SELECT project, tool, created, revision, status FROM runs WHERE status = 'F' ORDER BY created DESC, revision DESC LIMIT 12")
def audit_page(spark, sf_dir):
    return ledger.page(v.runs(spark, sf_dir).where("status = 'F'"), [F.desc("created"), F.desc("revision")], 12, 50)


@query("""SELECT c_custkey AS actor_id, c_name AS actor, n_name AS nation, c_acctbal AS last_seen FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_acctbal DESC, c_nationkey LIMIT 24""")
def member_activity(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("last_seen"))
    n = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return ledger.member_activity(c, n, "k").select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("actor"), F.col("n_name").alias("nation"), "last_seen")


_PROJECTS = "projects AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey || ':' || c_mktsegment END AS project_ref, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey || ':' || CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_mktsegment END END AS old_ref FROM customer)"
_NEED = "{t}.project, {t}.tool, {ref} AS project_ref, coalesce(list(f.a ORDER BY f.place) FILTER (f.a IS NOT NULL), []) AS up, coalesce(list(u.revision::VARCHAR ORDER BY f.place) FILTER (u.revision IS NOT NULL), []) AS ids, array_to_string(list_concat([{t}.tool, coalesce({ref}, 'project:none')], coalesce(list('upstream:' || f.a || ':' || coalesce(u.revision::VARCHAR, 'none') ORDER BY f.place) FILTER (f.a IS NOT NULL), [])), '|') AS signature"
_FEEDS = values("feeds", "a, b, place", [(*f, i) for i, f in enumerate(FEEDS)])
_CURRENT = f"{v.RUNS}, {_LATEST}, {_FEEDS}, {_PROJECTS}, {values('priorities', 'tool', [(t,) for t in PRIORITIES])}, current AS (SELECT {_NEED.format(t='t', ref='t.project_ref')} FROM (SELECT * FROM projects, priorities) t LEFT JOIN feeds f ON f.b = t.tool LEFT JOIN latest u ON u.project = t.project AND u.tool = f.a GROUP BY t.project, t.tool, t.project_ref)"


def _current(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer")
    ref = lambda tail: F.when(F.col("c_custkey") % 9 != 0, F.concat_ws(":", "c_custkey", tail))
    now = c.select(F.col("c_custkey").alias("project"), ref(F.col("c_mktsegment")).alias("project_ref"))
    then = c.select(F.col("c_custkey").alias("project"), ref(F.when(F.col("c_custkey") % 7 == 0, "old").otherwise(F.col("c_mktsegment"))).alias("project_ref"))
    runs = v.runs(spark, sf_dir)
    return ledger.upstreams(runs, now, feeds(spark), spark.createDataFrame([(t,) for t in PRIORITIES], "tool string")), ledger.kept_with(runs, then, feeds(spark))


@query(f"""WITH {_CURRENT}, seen AS (SELECT l.project, l.tool, f.a, f.place, max_by(r.revision, (r.created, r.revision)) AS revision FROM latest l JOIN feeds f ON f.b = l.tool JOIN runs r ON r.project = l.project AND r.tool = f.a AND r.created <= l.created GROUP BY ALL),
stored AS (SELECT {_NEED.format(t='l', ref='p.old_ref')} FROM latest l JOIN projects p ON p.project = l.project LEFT JOIN feeds f ON f.b = l.tool LEFT JOIN seen u ON u.project = l.project AND u.tool = l.tool AND u.a = f.a GROUP BY l.project, l.tool, p.old_ref),
x AS (SELECT c.*, s.project_ref AS old_ref, s.up AS old_up, s.ids AS old_ids, s.signature AS old_signature FROM current c LEFT JOIN stored s ON s.project = c.project AND s.tool = c.tool)
SELECT project, tool, CASE WHEN old_signature IS NULL AND (project_ref IS NOT NULL OR len(up) > 0) THEN 'awaiting-upstream' WHEN old_signature IS NULL THEN 'not-run' WHEN old_signature <> signature THEN 'stale' ELSE 'fresh' END AS status, old_signature IS NOT NULL AND old_ref IS DISTINCT FROM project_ref AS project_changed,
 CASE WHEN old_signature IS NULL THEN up WHEN old_signature <> signature THEN list_transform(list_filter(range(1, len(up) + 1), lambda i: old_up[i] IS DISTINCT FROM up[i] OR old_ids[i] IS DISTINCT FROM ids[i]), lambda i: up[i]) ELSE [] END AS blocking FROM x""")
def staleness(spark, sf_dir):
    return ledger.freshness(*_current(spark, sf_dir))


@query(f"WITH {_CURRENT} SELECT project, tool, project_ref, up, ids, signature FROM current")
def execution_snapshot(spark, sf_dir):
    return _current(spark, sf_dir)[0]


@query(f"WITH {v.RUNS} SELECT project, max(revision) AS revision, count(*) AS n, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'P') AS n_p FROM runs GROUP BY project")
def backend_counts(spark, sf_dir):
    return ledger.meta_counts(v.runs(spark, sf_dir))


@query(f"WITH {v.RUNS}, {_LATEST} SELECT project, tool, CASE status WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'review' END AS state FROM latest")
def checkpoints(spark, sf_dir):
    return ledger.checkpoints(v.runs(spark, sf_dir))


@query(f"""WITH {v.ARTICLES}, a AS (SELECT id, lower(title) AS k, source, id % 2 AS new FROM articles), f AS (SELECT k, arg_min(source, (new, id)) AS source FROM a GROUP BY k)
SELECT x.id, x.k, f.source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, id) AS n FROM a) x JOIN f ON f.k = x.k WHERE n = 1""")
def evidence_upsert(spark, sf_dir):
    a = v.articles(spark, sf_dir).select("id", F.lower("title").alias("k"), "source")
    return ledger.upsert(a.where("id % 2 = 0"), a.where("id % 2 = 1"), F.col("k"), F.asc("id"), keep=("source",))


@query(f"""WITH {v.RUNS}, b AS (SELECT DISTINCT project FROM runs WHERE status = 'P') SELECT * FROM runs WHERE status <> 'P' AND project NOT IN (SELECT project FROM b) UNION ALL SELECT * FROM runs WHERE status = 'P'""")
def replace_index(spark, sf_dir):
    r = v.runs(spark, sf_dir)
    return ledger.replace_partition(r.where("status <> 'P'"), r.where("status = 'P'"), "project")


@query(f"WITH {v.RUNS} SELECT w.project, w.revision, s.stored, w.revision < coalesce(s.stored, 0) AS conflict FROM (SELECT project, revision FROM runs WHERE status = 'O') w LEFT JOIN (SELECT project, max(revision) AS stored FROM runs WHERE status = 'F' GROUP BY project) s USING (project)")
def write_conflicts(spark, sf_dir):
    r = v.runs(spark, sf_dir)
    return ledger.conflicts(r.where("status = 'O'").select("project", "revision"), r.where("status = 'F'"))


@query(f"WITH {v.ARTICLES} SELECT id, title, source FROM articles ORDER BY title, id LIMIT 8 OFFSET 16")
def page_slice(spark, sf_dir):
    return ledger.numbered_page(v.articles(spark, sf_dir).select("id", "title", "source"), [F.asc("title"), F.asc("id")], 3, 8)


@query("""SELECT n_nationkey AS current, r_regionkey * 5 + 2 AS pages, CASE WHEN r_regionkey * 5 + 2 <= 7 THEN range(1, r_regionkey * 5 + 3) WHEN n_nationkey <= 4 THEN [1, 2, 3, 4, 5, 0, r_regionkey * 5 + 2]
 WHEN n_nationkey >= r_regionkey * 5 - 1 THEN [1, 0, r_regionkey * 5 - 2, r_regionkey * 5 - 1, r_regionkey * 5, r_regionkey * 5 + 1, r_regionkey * 5 + 2] ELSE [1, 0, n_nationkey - 1, n_nationkey, n_nationkey + 1, 0, r_regionkey * 5 + 2] END AS buttons FROM nation, region""")
def page_buttons(spark, sf_dir):
    x = v.table(spark, sf_dir, "nation").crossJoin(F.broadcast(v.table(spark, sf_dir, "region"))).select(F.col("n_nationkey").alias("current"), (F.col("r_regionkey") * 5 + 2).alias("pages"))
    return x.withColumn("buttons", ledger.page_buttons(F.col("current"), F.col("pages")))


_REQUESTS = "r AS (SELECT t.tool, s.surface, tt.tier, d.draft, p.provenance, h.human FROM tools t, surfaces s, (VALUES ('demo'), ('partial'), ('real'), (NULL)) tt(tier), (VALUES (true), (false)) d(draft), (VALUES (0), (2)) p(provenance), (VALUES (NULL), ('approved'), ('rejected'), ('pending')) h(human))"


@query(f"""WITH {TIERS}, {_SURFACES}, {_REQUESTS}, j AS (SELECT r.*, s.allowed, s.needs_provenance, s.needs_gate AND coalesce(human, 'pending') <> 'approved' AS gate, s.denies_drafts FROM r JOIN surfaces s USING (surface)),
d AS (SELECT *, CASE WHEN tier IS NULL THEN 2 WHEN draft AND denies_drafts THEN 3 WHEN NOT list_contains(allowed, tier) THEN 4 WHEN needs_provenance AND provenance = 0 THEN 5 WHEN gate AND coalesce(human, 'pending') = 'rejected' THEN 6 WHEN gate THEN 7 WHEN tier = 'demo' THEN 8 ELSE 9 END AS rule FROM j)
SELECT tool, surface, tier, draft, provenance, human, CASE WHEN rule <= 6 THEN 'blocked' WHEN rule = 7 THEN 'gated' WHEN rule = 8 THEN 'demoOnly' ELSE 'ok' END AS status,
CASE rule WHEN 2 THEN 'TIER_NOT_ALLOWED_FOR_SURFACE' WHEN 3 THEN 'DRAFT_OUTPUT_NOT_EXPORTABLE' WHEN 4 THEN CASE WHEN tier = 'demo' AND surface = 'protocol' THEN 'DEMO_OUTPUT_PROTOCOL_BLOCKED' WHEN tier = 'demo' AND surface = 'external-handoff' THEN 'EXTERNAL_HANDOFF_BLOCKED' ELSE 'TIER_NOT_ALLOWED_FOR_SURFACE' END
 WHEN 5 THEN 'PROVENANCE_REQUIRED' WHEN 6 THEN 'HUMAN_GATE_REQUIRED' WHEN 7 THEN 'HUMAN_GATE_REQUIRED' END AS code, CASE WHEN rule IN (2, 4, 6) THEN 'not-allowed' WHEN rule IN (3, 5, 7) THEN 'human-review' END AS override FROM d""")
def policy_matrix(spark, sf_dir):
    each = lambda values, kind: F.explode(F.array(*[F.lit(x).cast(kind) for x in values]))
    p = trust.policies(spark)
    r = p.select("tool", "surface", each(["demo", "partial", "real", None], "string").alias("tier"))
    r = r.withColumn("draft", each([True, False], "boolean")).withColumn("provenance", each([0, 2], "int")).withColumn("human", each([None, "approved", "rejected", "pending"], "string"))
    return trust.decide(r, p)


@query(f"""WITH {TIERS}, s AS (SELECT tool AS source, tier, p, b, w FROM tools, (VALUES (true), (false)) p(p), (VALUES (0), (1)) b(b), (VALUES (0), (1)) w(w)),
g AS (SELECT source || '/' || p::VARCHAR || b::VARCHAR || w::VARCHAR AS source, t.tool AS target, CASE WHEN NOT p THEN 1 WHEN s.tier = 'demo' AND t.tier = 'demo' THEN 2 WHEN s.tier = 'demo' THEN CASE WHEN t.tier IN ('partial', 'real') THEN 3 ELSE 7 END WHEN t.tier = 'real' AND b > 0 THEN 4 WHEN t.tier = 'partial' AND b > 0 THEN 5 WHEN w > 0 OR s.tier = 'partial' OR t.tier = 'partial' THEN 6 ELSE 7 END AS rule FROM s, tools t)
SELECT source, target, rule IN (2, 6, 7) AS allowed, CASE WHEN rule IN (2, 6) THEN 'warn' WHEN rule = 7 THEN 'allow' ELSE 'block' END AS severity, rule FROM g""")
def downstream_gate(spark, sf_dir):
    each = lambda *values: F.explode(F.array(*map(F.lit, values)))
    s = trust.tools(spark).withColumn("p", each(True, False)).withColumn("b", each(0, 1)).withColumn("w", each(0, 1))
    s = s.select(F.concat("tool", F.lit("/"), F.col("p").cast("string"), F.col("b").cast("string"), F.col("w").cast("string")).alias("source"), "tier", F.col("p").alias("has_provenance"), F.col("b").alias("blocking"), F.col("w").alias("warnings"))
    return trust.downstream_gate(s, trust.tools(spark).withColumnsRenamed({"tool": "target", "tier": "target_tier"}))


_PAYLOADS = """p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'real' WHEN 'O' THEN 'partial' END AS tier, CASE WHEN o_custkey % 2 = 0 THEN 'partial' ELSE 'demo' END AS floor, (o_totalprice % 100) / 100 AS confidence,
 CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 0.5 END AS min_confidence, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 0.1 END AS uncertainty, o_custkey % 7 = 0 AS bounded, o_orderkey % 4 AS evidence, 2 AS min_evidence, o_orderkey % 3 AS missing_outputs, o_custkey % 11 = 0 AS simulated FROM orders)"""


@query(f"""WITH {_PAYLOADS}, r AS (SELECT id, list_filter([CASE WHEN missing_outputs > 0 THEN 'REQUIRED_OUTPUTS_MISSING' END,
 CASE WHEN NOT coalesce((CASE tier WHEN 'real' THEN 2 WHEN 'partial' THEN 1 END) >= (CASE floor WHEN 'partial' THEN 1 ELSE 0 END), false) THEN 'VALIDITY_BELOW_FLOOR' END, CASE WHEN min_confidence IS NOT NULL AND NOT confidence >= min_confidence THEN 'CONFIDENCE_BELOW_FLOOR' END,
 CASE WHEN bounded AND uncertainty IS NULL THEN 'UNCERTAINTY_UNBOUNDED' END, CASE WHEN evidence < min_evidence THEN 'EVIDENCE_MISSING' END, CASE WHEN simulated THEN 'SIMULATED_OUTPUT' END], lambda x: x IS NOT NULL) AS reasons FROM p) SELECT id, reasons, len(reasons) = 0 AS ok FROM r""")
def contract_status(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    c, n = F.col("o_custkey"), F.lit(None)
    p = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "real").when(F.col("o_orderstatus") == "O", "partial").alias("tier"), F.when(c % 2 == 0, "partial").otherwise("demo").alias("floor"),
        ((F.col("o_totalprice") % 100) / 100).alias("confidence"), F.when(c % 3 == 0, n).otherwise(0.5).alias("min_confidence"), F.when(c % 5 == 0, n).otherwise(0.1).alias("uncertainty"), (c % 7 == 0).alias("bounded"),
        (F.col("o_orderkey") % 4).alias("evidence"), F.lit(2).alias("min_evidence"), (F.col("o_orderkey") % 3).alias("missing_outputs"), (c % 11 == 0).alias("simulated"),
    )
    return trust.contract_status(p).select("id", "reasons", "ok")


@query("""WITH s AS (SELECT o_custkey AS project, (o_orderkey % 6)::INTEGER + 1 AS place, bool_or(o_orderstatus <> 'P') AS ok FROM orders GROUP BY ALL), q AS (SELECT project, place, ok AND row_number() OVER (PARTITION BY project ORDER BY place) = place AS ok FROM s), r AS (SELECT *, min(ok::INTEGER) OVER (PARTITION BY project ORDER BY place) AS run FROM q)
SELECT project, coalesce(max(place) FILTER (run = 1), 0) AS reached, coalesce(max(place) FILTER (run = 1), 0) + 1 AS next_place FROM r GROUP BY project""")
def golden_prefix(spark, sf_dir):
    s = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project"), ((F.col("o_orderkey") % 6).cast("int") + 1).alias("place")).agg(F.bool_or(F.col("o_orderstatus") != "P").alias("ok"))
    return trust.golden_prefix(s)


_WALK = f"RECURSIVE {TOOL_EDGES}, e AS (SELECT a, b FROM edges WHERE kind IN ('forward', 'feedback')), w(a, b, hops) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, hops + 1 FROM w JOIN e ON e.a = w.b WHERE hops < 12), closure AS (SELECT a, b, min(hops) AS hops FROM w GROUP BY ALL)"


@query(f"WITH {_WALK} SELECT a, b, hops FROM closure")
def tool_closure(spark, sf_dir):
    return graph.closure(graph.edges_of(trust.edges(spark)))


@query(f"WITH {_WALK} SELECT -hops AS place, a AS node FROM closure WHERE b = 'dyncon' AND a <> 'dyncon' UNION ALL SELECT hops, b FROM closure WHERE a = 'dyncon' AND b <> 'dyncon' UNION ALL SELECT 0, 'dyncon'")
def dependency_trace(spark, sf_dir):
    return graph.trace(graph.edges_of(trust.edges(spark)), "dyncon")


@query(f"WITH {TOOL_EDGES} SELECT b AS node FROM edges WHERE a = 'fbasim' AND kind = 'forward' AND mode = 'required'")
def next_required_tools(spark, sf_dir):
    return graph.next_required(trust.edges(spark), "fbasim")


@query("SELECT node, floor(avg(f) * 1000000 + 0.5) / 1000000 AS magnitude FROM (SELECT l_partkey AS node, abs(l_quantity - 25) AS f FROM lineitem UNION ALL SELECT l_suppkey + 1000000, abs(l_quantity - 25) FROM lineitem) GROUP BY node")
def node_flux(spark, sf_dir):
    from helixlake.plans.tools import rounded

    e = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"), (F.col("l_quantity") - 25).alias("flux"))
    return rounded(graph.node_flux(e))


_TASKS = "t AS (SELECT o_orderkey AS task, CASE o_orderkey % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'done' WHEN 2 THEN 'error' ELSE 'pending' END AS status, [o_orderkey - 3, o_orderkey - 7] AS depends_on FROM orders)"


def _tasks(spark, sf_dir):
    o = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select(o.alias("task"), F.when(o % 5 < 2, "done").when(o % 5 == 2, "error").otherwise("pending").alias("status"), F.array(o - 3, o - 7).alias("depends_on"))


@query(f"WITH {_TASKS}, n AS (SELECT task, unnest(depends_on) AS need FROM t WHERE status = 'pending') SELECT task FROM t WHERE status = 'pending' AND task NOT IN (SELECT task FROM n WHERE need NOT IN (SELECT task FROM t WHERE status = 'done'))")
def runnable_tasks(spark, sf_dir):
    return graph.runnable(_tasks(spark, sf_dir))


@query(f"WITH {_TASKS}, n AS (SELECT task, unnest(depends_on) AS need FROM t WHERE status = 'pending') SELECT DISTINCT task FROM n WHERE need IN (SELECT task FROM t WHERE status = 'error')")
def blocked_tasks(spark, sf_dir):
    return graph.blocked_by_failure(_tasks(spark, sf_dir))


@query("""WITH l AS (SELECT p_partkey AS variant, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_partkey = 0 AS is_wild, p_size >= 50 AS is_lead, p_size >= 40 AS survived FROM part), c AS (SELECT parent AS variant, count(*) AS children FROM l WHERE parent IS NOT NULL GROUP BY parent)
SELECT variant, coalesce(children, 0) AS children, CASE WHEN is_wild THEN 'wild-type' WHEN is_lead THEN 'lead' WHEN survived THEN 'survivor' WHEN coalesce(children, 0) = 0 THEN 'dead' ELSE 'rejected' END AS status FROM l LEFT JOIN c USING (variant)""")
def variant_lineage(spark, sf_dir):
    p = F.col("p_partkey")
    return graph.lineage(v.table(spark, sf_dir, "part").select(p.alias("variant"), F.when(p > 0, F.floor(p / 3)).alias("parent"), (p == 0).alias("is_wild"), (F.col("p_size") >= 50).alias("is_lead"), (F.col("p_size") >= 40).alias("survived")))


@query("""SELECT 'strain' AS key, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'condition', o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def coverage_counts(spark, sf_dir):
    return trust.coverage(v.assays(spark, sf_dir), "strain", "condition")


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0), c AS (SELECT doc_id, quality, CASE WHEN doc_id % 10 = 1 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0)
SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'no case' WHEN l.doc_id IS NULL THEN 'no label' ELSE 'toxic differs' END AS problem FROM l FULL JOIN c ON c.doc_id = l.doc_id WHERE c.doc_id IS NULL OR l.doc_id IS NULL OR l.toxic <> c.toxic""")
def label_reconciliation(spark, sf_dir):
    x = v.table(spark, sf_dir, "labels")
    cases = x.where("doc_id % 4 <> 0 OR doc_id % 3 = 0")  # an id is on one side at least
    cases = cases.withColumn("toxic", F.when(F.col("doc_id") % 10 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return trust.reconcile(x.where("doc_id % 3 <> 0"), cases, "doc_id", ["quality", "toxic"])
