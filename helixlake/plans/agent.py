"""Research-agent and laboratory-document queries."""

from pyspark.sql import functions as F

from helixlake.operators import agent as op
from helixlake.plans.registry import query
from helixlake.plans.tools import values
from helixlake.sources import constants as k
from helixlake.sources import views as v


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: Requests that bring every outcome about, dealt out over the conversation turns.
REQUESTS = [
    "Design a pathway for artemisinic acid.", "Run FBA on yeast for ATP", "pathway design with flux balance", "Redesign the enzyme", "What is new?", "  ", "Plan a route to lycopene, with directed evolution and a gene circuit",
    "simulate metabolism for product yield", "Metabolic pathway for taxol! now", "cell-free prototype of a controller, volcano plot and umap, dbtl", "Optimise growth rate and knockout",
]


def _requests(spark, sf_dir):
    n = F.col("conv_id") * 7 + F.col("turn")
    c = v.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.get(F.array(*map(F.lit, REQUESTS)), (n % len(REQUESTS)).cast("int")).alias("request"), F.when(F.col("conv_id") % 3 == 0, "squalene").alias("target"))


_REQUESTS = f"q AS (SELECT conv_id, turn, {_list(REQUESTS)}[(conv_id * 7 + turn) % {len(REQUESTS)} + 1] AS request, CASE WHEN conv_id % 3 = 0 THEN 'squalene' END AS target FROM conversations)"
#: What the requests name, worked out by hand.
_NAMED = "CASE raw WHEN 'Design a pathway for artemisinic acid.' THEN 'artemisinic acid' WHEN 'Plan a route to lycopene, with directed evolution and a gene circuit' THEN 'lycopene' WHEN 'Metabolic pathway for taxol! now' THEN 'taxol' END"
_HITS = "list_filter({w}, lambda w: contains({t}, w))"


@query(f"""WITH {_REQUESTS}, l AS (SELECT *, trim(request) AS raw, trim(regexp_replace(lower(trim(request)), '\\s+', ' ', 'g')) AS low FROM q),
h AS (SELECT *, {_HITS.format(w=_list(k.ROUTE_PATHWAY_WORDS), t='low')} AS a, {_HITS.format(w=_list(k.ROUTE_FLUX_WORDS), t='low')} AS b, coalesce({_NAMED}, target) AS named FROM l),
d AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN len(a) > 0 AND len(b) > 0 THEN 'both' WHEN len(a) > 0 AND named IS NULL THEN 'no-product' WHEN len(a) > 0 THEN 'pathd' WHEN len(b) > 0 THEN 'fbasim' ELSE 'none' END AS reason FROM h)
SELECT conv_id, turn, reason, CASE WHEN reason IN ('pathd', 'fbasim') THEN reason ELSE 'none' END AS kind, CASE WHEN reason = 'pathd' THEN named END AS product, CASE WHEN reason = 'fbasim' THEN CASE WHEN contains(low, 'yeast') THEN 'yeast' ELSE 'ecoli' END END AS species,
 CASE WHEN reason = 'fbasim' THEN CASE WHEN contains(low, 'atp') THEN 'atp' WHEN contains(low, 'product') OR contains(low, 'yield') THEN 'product' ELSE 'biomass' END END AS objective, CASE reason WHEN 'pathd' THEN a WHEN 'fbasim' THEN b ELSE [] END AS signals FROM d""")
def intent_routes(spark, sf_dir):
    return op.route(_requests(spark, sf_dir)).drop("request", "target")


_SUPPORTED = ["pathd", "fbasim"]
_HAS = lambda words: f"len({_HITS.format(w=_list(words), t='low')}) > 0"
_PLANNED = "[" + ", ".join([f"CASE WHEN {_HAS(k.PLAN_WORDS['pathd'])} OR target IS NOT NULL THEN 'pathd' END", f"CASE WHEN {_HAS(k.PLAN_WORDS['fbasim'])} THEN 'fbasim' END", *[f"CASE WHEN {_HAS(w)} THEN '{t}' END" for t, w in k.PLAN_WORDS.items() if t not in ("pathd", "fbasim")]]) + "]"
_NEXT = {a: b for a, b in zip(k.GOLDEN_PATH, k.GOLDEN_PATH[1:])}


@query(f"""WITH {_REQUESTS}, l AS (SELECT conv_id, turn, target, lower(trim(request)) AS low FROM q), t AS (SELECT conv_id, turn, list_slice(list_filter({_PLANNED}, lambda t: t IS NOT NULL), 1, 5) AS tools FROM l),
s AS (SELECT *, list_filter(list_transform(tools, lambda t: CASE t {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _NEXT.items())} END), lambda t: t IS NOT NULL) AS after FROM t)
SELECT conv_id, turn, array_to_string(list_transform(tools, lambda t: t || ':' || CASE WHEN t IN ('pathd', 'fbasim') THEN 'planned' ELSE 'unsupported' END || CASE WHEN t = 'fbasim' AND list_contains(tools, 'pathd') THEN '<pathd' ELSE '' END), ' ') AS steps,
 array_to_string(list_concat(list_concat(list_transform(list_filter(tools, lambda t: t NOT IN ('pathd', 'fbasim')), lambda t: 'unsupported:' || t), list_transform(list_filter(after, lambda t: NOT list_contains(tools, t) AND t NOT IN ('pathd', 'fbasim')), lambda t: 'successor:' || t)), CASE WHEN len(tools) = 0 THEN ['no-steps'] ELSE [] END), ' ') AS warnings FROM s""")
def agent_plans(spark, sf_dir):
    p = op.plan(_requests(spark, sf_dir).withColumn("id", F.struct("conv_id", "turn")), _SUPPORTED)
    step = lambda s: F.concat(s["tool"], F.lit(":"), s["status"], F.when(F.size(s["depends_on"]) > 0, F.concat(F.lit("<"), F.array_join(s["depends_on"], ","))).otherwise(""))
    return p.select("id.conv_id", "id.turn", F.array_join(F.transform("steps", step), " ").alias("steps"), F.array_join("warnings", " ").alias("warnings"))


_SESSIONS = """sessions AS (SELECT c_custkey AS session, c_custkey % 23 = 0 AS interrupted, CASE WHEN c_custkey % 19 = 0 THEN 'off-domain' ELSE 'scientific-pathway' END AS category, c_custkey % 5 <> 0 AS has_plan FROM customer),
steps AS (SELECT o_custkey AS session, NOT (o_custkey % 7 = 0 OR o_orderkey % 9 = 0) AS supported, CASE WHEN o_custkey % 11 = 3 THEN NULL WHEN o_custkey % 4 = 0 THEN 'done' ELSE ['done', 'error', 'cancelled', 'done', 'done', 'running', 'pending'][o_orderkey * o_custkey % (3 + o_custkey % 5) + 1] END AS task_status FROM orders WHERE o_custkey % 5 <> 0)"""


@query(f"""WITH {_SESSIONS}, g AS (SELECT session, count(*) AS n, count(*) FILTER (supported) AS able, count(*) FILTER (supported AND task_status IS NOT NULL) AS tasks, {', '.join(f"count(*) FILTER (supported AND task_status = '{s}') AS {s}" for s in ('running', 'pending', 'error', 'cancelled', 'done'))} FROM steps GROUP BY session)
SELECT session, CASE WHEN interrupted THEN 'interrupted' WHEN category = 'off-domain' THEN 'off-domain' WHEN NOT has_plan THEN 'idle' WHEN coalesce(able, 0) = 0 THEN 'unsupported' WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'waiting' WHEN tasks = 0 THEN 'planning' WHEN done = tasks THEN 'completed' WHEN error > 0 AND done > 0 THEN 'partial' WHEN error > 0 THEN 'failed' WHEN cancelled > 0 THEN 'cancelled' ELSE 'waiting' END AS status FROM sessions LEFT JOIN g USING (session)""")
def session_status(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("o_custkey")
    sessions = v.table(spark, sf_dir, "customer").select(c.alias("session"), (c % 23 == 0).alias("interrupted"), F.when(c % 19 == 0, "off-domain").otherwise("scientific-pathway").alias("category"), (c % 5 != 0).alias("has_plan"))
    names = F.array(*map(F.lit, ["done", "error", "cancelled", "done", "done", "running", "pending"]))
    steps = v.table(spark, sf_dir, "orders").where("o_custkey % 5 <> 0").select(
        n.alias("session"), (~((n % 7 == 0) | (F.col("o_orderkey") % 9 == 0))).alias("supported"), F.when(n % 11 == 3, None).when(n % 4 == 0, "done").otherwise(F.get(names, (F.col("o_orderkey") * n % (3 + n % 5)).cast("int"))).alias("task_status")
    )
    return op.session_status(sessions, steps)


_CARDS = "cards AS (SELECT o_custkey AS session, ['plan-step', 'plan-step', 'unsupported-step', 'blocked-dependency', 'interrupted', 'writeback', 'planning'][o_orderkey % 7 + 1] AS kind, ['done', 'failed', 'cancelled', 'unsupported', 'blocked', 'running'][o_orderkey * 3 % 8 + 1] AS status FROM orders)"
_COUNTS = {s: f"kind IN ('plan-step', 'unsupported-step') AND status = '{w}'" for s, w in (("completed", "done"), ("failed", "failed"), ("cancelled", "cancelled"), ("unsupported", "unsupported"))} | {"blocked": "kind IN ('plan-step', 'unsupported-step') AND status = 'blocked' OR kind = 'blocked-dependency'", "interrupted": "kind = 'interrupted'", "writeback": "kind = 'writeback'"}


@query(f"""WITH {_CARDS}, g AS (SELECT session, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _COUNTS.items())} FROM cards GROUP BY session), p AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN {n} || ' {n}' END" for n in _COUNTS)}], lambda x: x IS NOT NULL) AS parts FROM g)
SELECT session, {', '.join(_COUNTS)}, failed > 0 OR cancelled > 0 OR blocked > 0 OR interrupted > 0 AS needs_user, CASE WHEN len(parts) = 0 THEN 'No steps executed yet.' ELSE array_to_string(parts, ' · ') END AS headline FROM p""")
def session_outcomes(spark, sf_dir):
    n = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ["plan-step", "plan-step", "unsupported-step", "blocked-dependency", "interrupted", "writeback", "planning"]))
    states = F.array(*map(F.lit, ["done", "failed", "cancelled", "unsupported", "blocked", "running"]))
    return op.session_outcome(v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.get(kinds, (n % 7).cast("int")).alias("kind"), F.get(states, (n * 3 % 8).cast("int")).alias("status")))


@query("""WITH a AS (SELECT item_id AS id, text FROM benchmark) SELECT id, s AS section, place, kind, entry FROM (
 SELECT id, 'summary' AS s, 0 AS place, 'paragraph' AS kind, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' and so on' AS entry FROM a UNION ALL SELECT id, 'observations', 1, 'bullet', 'first ' || id FROM a UNION ALL SELECT id, 'observations', 2, 'bullet', 'second' FROM a
 UNION ALL SELECT id, 'interpretation', 3, 'paragraph', 'One part.' FROM a UNION ALL SELECT id, 'interpretation', 4, 'paragraph', 'Another.' FROM a UNION ALL SELECT id, 'next-steps', 5, 'bullet', 'do it' FROM a)""")
def answer_sections(spark, sf_dir):
    text = F.concat(F.lit("left out\n## Summary:\n"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\nand so on\n\n**Key Observations**\n- first "), F.col("item_id").cast("string"), F.lit("\n* second\nInterpretation\nOne part.\n\nAnother.\nRecommended next steps:\n• do it"))
    return op.sections(v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.alias("text")))


@query("""WITH p AS (SELECT doc_id AS id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS paragraph FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda q: trim(q)), lambda q: q <> '') AS p FROM documents)),
m AS (SELECT id, paragraph, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: trim(q)), lambda q: q <> '') AS s FROM p) SELECT id, paragraph, count(*) AS n, sha256(string_agg(s, '|' ORDER BY place)) AS digest FROM (SELECT id, paragraph, unnest(s) AS s, generate_subscripts(s, 1) AS place FROM m) GROUP BY ALL""")
def text_sentences(spark, sf_dir):
    s = op.sentences(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    g = s.groupBy("id", "paragraph").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]).alias("s"))
    return g.select("id", F.col("paragraph").cast("long").alias("paragraph"), "n", F.sha2(F.array_join("s", "|").cast("binary"), 256).alias("digest"))


_NODES = "nodes AS (SELECT o_custkey AS doc, o_orderkey AS place, 'N ' || (o_orderkey % 6) AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' Label ' || (o_orderkey % 5) END AS label, ['enzyme', 'gene', 'odd', 'metabolite'][o_orderkey % 4 + 1] AS type FROM orders)"
_STABLE = f"""{_NODES}, r AS (SELECT *, CASE type WHEN 'odd' THEN 'hypothesis' ELSE type END AS role FROM nodes), s AS (SELECT *, role || ':' || regexp_replace(lower(trim(coalesce(label, id))), '[^a-z0-9]+', '_', 'g') AS signature FROM r)"""


@query(f"""WITH {_STABLE}, old AS (SELECT DISTINCT doc, signature, 'kept ' || signature AS id FROM s WHERE doc % 2 = 0), b AS (SELECT s.doc, place, role, regexp_replace(lower(coalesce(old.id, s.id)), '[^a-z0-9_]', '_', 'g')[1:64] AS base FROM s LEFT JOIN old ON old.doc = s.doc AND old.signature = s.signature)
SELECT doc, place, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS id, role FROM (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY place) AS n FROM b)""")
def stable_nodes(spark, sf_dir):
    n = F.col("o_orderkey")
    types = F.array(*map(F.lit, ["enzyme", "gene", "odd", "metabolite"]))
    nodes = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), n.alias("place"), F.concat(F.lit("N "), (n % 6).cast("string")).alias("id"), F.when(n % 4 != 0, F.concat(F.lit(" Label "), (n % 5).cast("string"))).alias("label"), F.get(types, (n % 4).cast("int")).alias("type"))
    role = F.when(F.col("type") == "odd", "hypothesis").otherwise(F.col("type"))
    old = nodes.where("doc % 2 = 0").select("doc", F.concat(role, F.lit(":"), F.regexp_replace(F.lower(F.trim(F.coalesce("label", "id"))), "[^a-z0-9]+", "_")).alias("signature")).distinct()
    return op.stable_nodes(nodes, old.withColumn("id", F.concat(F.lit("kept "), "signature")))


@query("""SELECT role, count(*) AS n FROM (SELECT CASE WHEN kind = 'catalyzes' THEN 'catalysis' WHEN kind IN ('activates', 'inhibits', 'regulates') THEN 'regulation' WHEN kind = 'unknown' THEN 'abstraction' WHEN evidence THEN 'evidence-backed-transition' ELSE 'inferred-transition' END AS role
 FROM (SELECT ['catalyzes', 'activates', 'inhibits', 'regulates', 'unknown', 'produces'][l_partkey % 6 + 1] AS kind, l_orderkey % 2 = 0 AS evidence FROM lineitem)) GROUP BY role""")
def edge_roles(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["catalyzes", "activates", "inhibits", "regulates", "unknown", "produces"]))
    e = v.table(spark, sf_dir, "lineitem").select(op.edge_role(F.get(kinds, (F.col("l_partkey") % 6).cast("int")), F.when(F.col("l_orderkey") % 2 == 0, "seen")).alias("role"))
    return e.groupBy("role").agg(F.count("*").alias("n"))


_LABWARE = [*k.LABWARE, "other"]
_SLOTS = f"slots AS (SELECT o_custkey AS protocol, o_orderkey AS slot, {_list(_LABWARE)}[o_orderkey % {len(_LABWARE)} + 1] AS labware FROM orders), {values('kinds', 'labware, height, width, base', [(n, *g) for n, g in k.LABWARE.items()])}, numbered AS (SELECT s.*, base, height, width, row_number() OVER (PARTITION BY protocol, base ORDER BY slot) AS n FROM slots s LEFT JOIN kinds USING (labware)), roles AS (SELECT *, CASE WHEN base IS NULL THEN 'unknown labware' WHEN base LIKE 'tiprack%' AND n > 1 THEN 'duplicate tip rack' END AS problem FROM numbered), named AS (SELECT *, CASE WHEN problem IS NULL THEN CASE WHEN base LIKE 'tiprack%' THEN base ELSE base || '_' || n END END AS role FROM roles)"


def _slots(spark, sf_dir):
    n = F.col("o_orderkey")
    return op.labware_roles(v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("protocol"), n.alias("slot"), F.get(F.array(*map(F.lit, _LABWARE)), (n % len(_LABWARE)).cast("int")).alias("labware")))


@query(f"WITH {_SLOTS} SELECT protocol, slot, labware, role, problem FROM named")
def labware_roles(spark, sf_dir):
    return _slots(spark, sf_dir).select("protocol", "slot", "labware", "role", "problem")


_BASES = ["plate_1", "tuberack_1", "reservoir_1", "deepwell_2", "nowhere_1"]
_WELLS = ["A1", "H12", "C5", "D1", "A13", "AA1", "", "B0", "Z9"]


@query(f"""WITH {_SLOTS}, refs AS (SELECT DISTINCT o_custkey AS protocol, CASE WHEN l_partkey % 13 = 0 THEN 'plate_1' ELSE {_list(_BASES)}[l_partkey % 5 + 1] || ':' || {_list(_WELLS)}[l_suppkey % 9 + 1] END AS ref FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT protocol, ref, CASE WHEN len(string_split(ref, ':')) = 2 AND string_split(ref, ':')[1] <> '' AND string_split(ref, ':')[2] <> '' THEN string_split(ref, ':') END AS x FROM refs)
SELECT p.protocol, ref, x[1] AS role, x[2] AS well, CASE WHEN x IS NULL THEN 'malformed' WHEN labware IS NULL THEN 'role not loaded' WHEN NOT regexp_full_match(x[2], '[A-Z][1-9][0-9]?') THEN 'malformed well' WHEN ascii(x[2]) - 65 >= height OR regexp_extract(x[2], '^[A-Z]([1-9][0-9]?)$', 1)::INTEGER > width THEN 'outside' END AS problem
FROM p LEFT JOIN named n ON n.protocol = p.protocol AND n.role = p.x[1]""")
def step_references(spark, sf_dir):
    refs = v.table(spark, sf_dir, "lineitem").join(v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    at = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    ref = F.when(F.col("l_partkey") % 13 == 0, "plate_1").otherwise(F.concat_ws(":", at(_BASES, F.col("l_partkey") % 5), at(_WELLS, F.col("l_suppkey") % 9)))
    return op.parse_references(refs.select(F.col("o_custkey").alias("protocol"), ref.alias("ref")).distinct(), _slots(spark, sf_dir).where("role IS NOT NULL"))


_TYPES = ["promoter", "rbs", "cds", "terminator", "marker"]
_PARTS = f"parts AS (SELECT o_custkey AS doc, o_orderkey AS place, CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE 'p' || o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'part ' || o_orderkey END AS label, {_list(_TYPES)}[o_orderkey * 3 % 5 + 1] AS type, o_orderkey % 2 AS node, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 100) / 100.0 END AS strength FROM orders), {values('kinds', 'type, role, name', [(t, r, n) for t, (r, n) in k.SBOL_ROLES.items()])}, components AS (SELECT doc, place, id, coalesce(label, id) AS name, coalesce(role, 'SO:0000110') AS role, coalesce(kinds.name, 'Sequence Feature') || ' with ' || CASE WHEN strength IS NULL THEN 'default strength' ELSE 'strength ' || printf('%.2f', strength::DOUBLE) END AS description FROM parts LEFT JOIN kinds USING (type))"


def _parts(spark, sf_dir):
    n = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), n.alias("place"), F.when(n % 29 == 0, " ").otherwise(F.concat(F.lit("p"), n.cast("string"))).alias("id"), F.when(n % 3 != 0, F.concat(F.lit("part "), n.cast("string"))).alias("label"),
        F.get(F.array(*map(F.lit, _TYPES)), (n * 3 % 5).cast("int")).alias("type"), (n % 2).alias("node"), F.when(n % 4 != 0, n % 100 / 100.0).alias("strength"),
    )


@query(f"WITH {_PARTS} SELECT * FROM components")
def sbol_components(spark, sf_dir):
    return op.sbol_components(_parts(spark, sf_dir))


@query(f"WITH {_PARTS} SELECT a.doc, a.node, a.id AS promoter, b.id AS cds FROM parts a JOIN parts b ON b.doc = a.doc AND b.node = a.node WHERE a.type = 'promoter' AND b.type = 'cds'")
def sbol_interactions(spark, sf_dir):
    return op.sbol_interactions(_parts(spark, sf_dir))


@query(f"""WITH {_PARTS}, o AS (SELECT *, nullif(list_position({_list(r for r, _ in k.SBOL_ROLES.values())}, role), 0) AS o FROM components), b AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
f AS (SELECT doc, place, 'ERROR missing id' AS issue FROM b WHERE trim(coalesce(id, '')) = '' UNION ALL SELECT doc, place, 'WARNING non-standard role' FROM b WHERE role NOT IN ({', '.join(f"'{r}'" for r in k.SBOL_VALID)}) UNION ALL SELECT doc, place, 'WARNING out of order' FROM b WHERE o < before)
SELECT * FROM f UNION ALL SELECT DISTINCT doc, NULL::BIGINT, 'VALID' FROM b WHERE doc NOT IN (SELECT doc FROM f)""")
def sbol_issues(spark, sf_dir):
    return op.sbol_issues(op.sbol_components(_parts(spark, sf_dir)))


@query(f"""WITH {_PARTS} SELECT doc, string_agg('<urn:parts/' || id || '> a sbol:Component ;' || chr(10) || '  sbol:displayId "' || id || '" ;' || chr(10) || '  dcterms:title "' || name || '" ;' || chr(10) || '  sbol:role <' || role || '> .', chr(10) ORDER BY place) AS turtle FROM components GROUP BY doc""")
def sbol_turtle(spark, sf_dir):
    return op.sbol_turtle(op.sbol_components(_parts(spark, sf_dir)), "urn:parts/")


_ORDER = " ".join(f"WHEN has[{i}] THEN '{w}'" for i, w in enumerate(k.VIEW_ORDER, 1))


@query(f"WITH x AS (SELECT o_orderkey AS id, {_list([*k.VIEW_ORDER, 'odd'])}[o_orderkey % 6 + 1] AS requested, [o_custkey % 2 = 0, o_custkey % 3 = 0, o_custkey % 5 = 0, o_custkey % 7 = 0, false] AS has FROM orders) SELECT id, CASE WHEN coalesce(has[list_position({_list(k.VIEW_ORDER)}, requested)], false) THEN requested {_ORDER} ELSE 'table' END AS mode FROM x")
def view_modes(spark, sf_dir):
    c = F.col("o_custkey")
    there = F.create_map(*[z for w, d in zip(k.VIEW_ORDER, (2, 3, 5, 7, None)) for z in (F.lit(w), (c % d == 0) if d else F.lit(False))])
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, [*k.VIEW_ORDER, "odd"])), (F.col("o_orderkey") % 6).cast("int")).alias("r"), there.alias("has"))
    return o.select("id", op.view_mode(F.col("r"), F.col("has")).alias("mode"))


@query("""WITH a AS (SELECT c_custkey AS artifact, CASE WHEN c_custkey % 10 = 0 THEN 'bundled-demo.h5ad' ELSE c_name || '.H5AD' END AS file_name, c_custkey % 4 AS sample_count, c_custkey % 3 <> 0 AS spatial FROM customer), n AS (SELECT o_custkey AS artifact, count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE NULL END) AS n FROM orders GROUP BY 1)
SELECT artifact, regexp_replace(file_name, '\\.h5ad$', '', 'i') AS name, coalesce(nullif(n, 0), nullif(sample_count, 0), 1) AS samples, CASE WHEN file_name = 'bundled-demo.h5ad' THEN 'demo' WHEN NOT spatial THEN 'partial' ELSE 'real' END AS validity FROM a LEFT JOIN n USING (artifact)""")
def dataset_meta(spark, sf_dir):
    c = F.col("c_custkey")
    a = v.table(spark, sf_dir, "customer").select(c.alias("artifact"), F.when(c % 10 == 0, "bundled-demo.h5ad").otherwise(F.concat("c_name", F.lit(".H5AD"))).alias("file_name"), (c % 4).alias("sample_count"), (c % 3 != 0).alias("spatial"))
    return op.dataset_meta(a, v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("sample")))
