"""Queries of protein sites, contacts, affinities, blocked matrices, one-scan responses and prompt contexts."""

from pyspark.sql import functions as F

from helixlake.operators import context, matrices, spatial
from helixlake.operators import proteins as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded, values
from helixlake.sources import views as v

_LETTERS = f"[^{op.RESIDUES}{op.RESIDUES.lower()}]"
_SEQUENCES = f"s AS (SELECT lang AS family, doc_id AS id, upper(regexp_replace(text, '{_LETTERS}', '', 'g')) AS q, [doc_id % 50, doc_id % 200 + 60] AS catalytic FROM documents), p AS (SELECT family, id, catalytic, length(q) AS n, unnest(string_split(q, '')) AS residue, generate_subscripts(string_split(q, ''), 1) - 1 AS position FROM s WHERE q <> ''), k AS (SELECT family, position, residue, count(*) AS k FROM p GROUP BY ALL), f AS (SELECT family, position, sum(k)::BIGINT AS n, least(1.0, greatest(0.0, 1 - (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / log2(20))) AS conservation FROM k GROUP BY ALL)"


def _sequences(spark, sf_dir):
    n = F.col("doc_id")
    q = F.upper(F.regexp_replace("text", _LETTERS, ""))
    return v.table(spark, sf_dir, "documents").select(F.col("lang").alias("family"), n.alias("id"), q.alias("sequence"), F.array(n % 50, n % 200 + 60).alias("catalytic"))


@query(f"WITH {_SEQUENCES} SELECT family, position, n, {r('conservation')}, {r('avg(conservation) OVER (PARTITION BY family ORDER BY position RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'around')} FROM f")
def conservation_profile(spark, sf_dir):
    return rounded(op.smoothed(op.profile(op.positions(_sequences(spark, sf_dir), ["family"]))).withColumn("position", F.col("position").cast("long")))


@query(f"""WITH {_SEQUENCES}, x AS (SELECT p.id, p.position, p.residue, f.conservation, least(1.0, 1 / (1 + least(abs(p.position - catalytic[1]), abs(p.position - catalytic[2]), p.n) / 5.0::DOUBLE)) AS structural, CASE WHEN p.position / p.n < 0.15 OR p.position / p.n > 0.85 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN p.position % 4 < 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS surface
  FROM p JOIN f USING (family, position) WHERE NOT list_contains(catalytic, p.position)), y AS (SELECT id, position, residue, {r('conservation', digits=3)}, {r('structural', digits=3)}, {r('least(surface, 1.0)', 'surface', 3)}, {r('(1 - abs(conservation - 0.5) * 2) * (1 - structural) * surface', 'composite', 3)} FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, position) AS rank FROM y)
SELECT id, position, residue, conservation, structural, surface, composite, rank, CASE WHEN structural > 0.3 AND structural < 0.6 THEN 'beneficial' WHEN conservation > 0.7 THEN 'deleterious' ELSE 'neutral' END AS effect, {r('0.6::DOUBLE + (1 - conservation) * 0.3::DOUBLE', 'confidence', 3)} FROM z WHERE rank <= 8""")
def mutagenesis_sites(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return op.best_sites(op.top_sites(s, op.profile(op.positions(s, ["family"])))).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {v.CELLS}, x AS (SELECT cluster AS pose, cell AS id, x, y, v[3] AS z FROM cells), q AS (SELECT a.pose, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM x a JOIN x b ON a.pose = b.pose WHERE a.id < b.id)
SELECT pose, a, count(*) AS n, {r('min(d)', 'nearest')}, {r('sum(1 / (0.01::DOUBLE + d * d))', 'strength', 3)} FROM q WHERE d <= 0.1 GROUP BY pose, a""")
def pose_contacts(spark, sf_dir):
    points = v.cells(spark, sf_dir).select(F.col("cluster").alias("pose"), F.col("cell").alias("id"), "x", "y", F.element_at("v", 3).alias("z"))
    near = op.contacts(points, points, 0.1).where("a < b")
    g = near.groupBy("pose", "a").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.sum(1 / (0.01 + F.col("distance") * F.col("distance"))).alias("strength"))
    return rounded(rounded(g, "nearest"), "strength", digits=3)


_CHARGES = values("charges", "residue, charge", [(a, float(q)) for a, q in op.CHARGES.items()])


@query(f"""WITH {_CHARGES}, t AS (SELECT l_orderkey AS enzyme, substr('{op.RESIDUES}', (l_partkey % 20 + 1)::INTEGER, 1) AS residue, l_quantity / 5 AS d, l_partkey % 180 AS angle, 4.0::DOUBLE + l_suppkey % 7 + l_discount * 10 - 0.5::DOUBLE AS pka, 6.0::DOUBLE + o_custkey % 4 AS ph FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT enzyme, exp(-(d - 3.5::DOUBLE) * (d - 3.5::DOUBLE) / 0.5::DOUBLE) AS d, pow(cos(radians(angle - 100)), 2) AS o, 0.15::DOUBLE * (pow(3.5::DOUBLE / greatest(d, 0.5::DOUBLE), 12) - 2 * pow(3.5::DOUBLE / greatest(d, 0.5::DOUBLE), 6)) AS v, 332.0::DOUBLE * (coalesce(charge::DOUBLE, 0) + 1 / (1 + pow(10.0::DOUBLE, ph - pka))) * -0.3::DOUBLE / (4 * pow(greatest(d, 0.5::DOUBLE), 2)) AS e FROM t LEFT JOIN charges USING (residue)),
g AS (SELECT enzyme, least(1.0::DOUBLE, avg(d)) AS d, least(1.0::DOUBLE, avg(o)) AS o, avg(v) AS v, avg(e) AS e FROM u GROUP BY enzyme), s AS (SELECT *, 1 / (1 + exp(v * 5)) AS w, 1 / (1 + exp(e * 2)) AS q FROM g),
x AS (SELECT *, floor((v + e - e * 0.2375::DOUBLE * 4 - 0.0072::DOUBLE * 200 * d * (0.5::DOUBLE + 0.5::DOUBLE * o) + 1.5::DOUBLE) * 1000 + 0.5) / 1000 AS energy, floor((0.35::DOUBLE * d + 0.25::DOUBLE * o + 0.2::DOUBLE * w + 0.2::DOUBLE * q) * 1000 + 0.5) / 1000 AS overall FROM s)
SELECT o_orderkey AS enzyme, coalesce(energy, 0.0) AS energy, {r('coalesce(d, 0.0)', 'distance', 3)}, {r('coalesce(o, 0.0)', 'orientation', 3)}, {r('coalesce(w, 0.0)', 'vdw', 3)}, {r('coalesce(q, 0.0)', 'electrostatic', 3)}, coalesce(overall, 0.0) AS overall, kd_log, verdict
FROM orders LEFT JOIN (SELECT *, floor(least(ln(greatest(0.001::DOUBLE, exp(energy / (1.987e-3 * 298.15)) * 1000)), 1000.0) * 10 + 0.5) / 10 AS kd_log, CASE WHEN overall > 0.8 THEN 'excellent' WHEN overall > 0.6 THEN 'good' WHEN overall > 0.4 THEN 'moderate' ELSE 'poor' END AS verdict FROM x) ON enzyme = o_orderkey""".replace("kd_log, verdict\nFROM orders", "coalesce(kd_log, floor(ln(1000.0) * 10 + 0.5) / 10) AS kd_log, coalesce(verdict, 'unknown') AS verdict\nFROM orders"))
def binding_affinities(spark, sf_dir):
    o, li = v.table(spark, sf_dir, "orders"), v.table(spark, sf_dir, "lineitem")
    enzymes = o.select(F.col("o_orderkey").alias("enzyme"), (6.0 + F.col("o_custkey") % 4).alias("ph"))
    letter = F.substring(F.lit(op.RESIDUES), (F.col("l_partkey") % 20 + 1).cast("int"), F.lit(1))
    residues = li.select(F.col("l_orderkey").alias("enzyme"), letter.alias("residue"), (F.col("l_quantity") / 5).alias("distance"), F.lit(3.5).alias("optimal"), (F.col("l_partkey") % 180).alias("angle"), F.lit(100).alias("optimal_angle"), (4.0 + F.col("l_suppkey") % 7).alias("pka"), (F.col("l_discount") * 10 - 0.5).alias("pka_shift"))
    a = op.binding_affinity(enzymes, residues)
    return a.withColumn("kd_log", F.floor(F.least(F.log("kd"), F.lit(1000.0)) * 10 + 0.5) / 10).drop("kd")


_SIZE = 24


@query(f"WITH {v.EXPRESSION} SELECT a.gene::BIGINT AS row, b.gene::BIGINT AS col, {r('sum(a.value * b.value)', 'value')} FROM expression a JOIN expression b USING (cell) GROUP BY a.gene, b.gene")
def gene_products(spark, sf_dir):
    """The matrix of cells by genes, transposed, times itself."""
    x = matrices.blocked(v.expression(spark, sf_dir).select(F.col("cell").alias("row"), F.col("gene").cast("long").alias("col"), "value"), _SIZE)
    return rounded(matrices.cells(matrices.product(matrices.transposed(x, _SIZE), x, _SIZE), _SIZE))


@query(f"WITH {v.EXPRESSION} SELECT {r('sqrt(sum(value * value))', 'norm')}, count(DISTINCT (cell // {_SIZE}, gene // {_SIZE})) AS n FROM expression")
def matrix_norm(spark, sf_dir):
    return rounded(matrices.norm(matrices.blocked(v.expression(spark, sf_dir).select(F.col("cell").alias("row"), F.col("gene").cast("long").alias("col"), "value"), _SIZE)))


_ARTIFACT = "vec_id % 3"


@query(f"""WITH c AS (SELECT vec_id % 3 AS artifact, vec_id AS cell, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT artifact, cluster, v[3] AS own, generate_subscripts(v, 1) - 1 AS gene, unnest(v) AS value FROM c),
k AS (SELECT artifact, cluster, count(*) AS size, sum(v[3]) / count(*) AS mean FROM c GROUP BY ALL), g AS (SELECT artifact, gene, count(*)::DOUBLE AS n, sum(own) AS sx, sum(value) AS sy, sum(own * own) AS sxx, sum(value * value) AS syy, sum(own * value) AS sxy FROM e WHERE gene <> 2 GROUP BY ALL),
p AS (SELECT artifact, gene, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM g), q AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY abs(r) DESC, gene) AS rank FROM p)
SELECT artifact, (SELECT count(*) FROM c WHERE c.artifact = a.artifact) AS n_cells, (SELECT count(*) FROM c WHERE c.artifact = a.artifact) AS n_placed, (SELECT arg_min(cluster, (-size, cluster)) FROM k WHERE k.artifact = a.artifact) AS selected, 'spatial-2d' AS view,
 (SELECT string_agg(cluster || ':' || size || ':' || round(mean * 1000)::BIGINT, ' ' ORDER BY size DESC, cluster) FROM k WHERE k.artifact = a.artifact) AS clusters, (SELECT string_agg(gene || ':' || round(r * 1000)::BIGINT, ' ' ORDER BY rank) FROM q WHERE q.artifact = a.artifact AND rank <= 6) AS coexpressed, true AS has_trajectory, false AS has_umap FROM (SELECT DISTINCT artifact FROM c) a""")
def spatial_response(spark, sf_dir):
    c = v.cells(spark, sf_dir).withColumn("artifact", F.col("cell") % 3)
    s = spatial.query_response(c, 2)
    thousandth = lambda x: F.round(x * 1000).cast("long").cast("string")
    clusters = F.array_join(F.transform("cluster_summaries", lambda x: F.concat_ws(":", x["cluster"].cast("string"), x["size"].cast("string"), thousandth(x["mean_gene"]))), " ")
    close = F.array_join(F.transform("coexpression", lambda x: F.concat_ws(":", x["gene"].cast("string"), thousandth(x["r"]))), " ")
    return s.select("artifact", "n_cells", "n_placed", F.col("selection.cluster").alias("selected"), F.col("selection.view").alias("view"), clusters.alias("clusters"), close.alias("coexpressed"), F.element_at("views", "trajectory").alias("has_trajectory"), F.element_at("views", "umap").alias("has_umap"))


_BUDGET = 420
_CUT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n - 1})) || '…' END"


@query(f"""WITH c AS (SELECT conv_id AS project, min(turn) AS t0, count(*) AS n FROM conversations GROUP BY 1), e AS (SELECT conv_id AS project, turn AS place, text AS title, CASE WHEN turn % 2 = 0 THEN (2000 + turn)::VARCHAR END AS year FROM conversations WHERE conv_id % 6 <> 5),
p AS (SELECT project, CASE WHEN project % 6 <> 5 THEN 'P' || project END AS target, CASE WHEN project % 4 = 1 THEN 'pathd' END AS tool, CASE WHEN project % 3 = 0 THEN 'ready' END AS status, CASE WHEN project % 5 = 0 THEN repeat('slow step ', 20) END AS bottleneck, CASE WHEN project % 2 = 0 THEN 'warm' END AS concern, project % 3 AS selected FROM c),
sv AS (SELECT project, count(*) AS saved FROM e GROUP BY 1), named AS (SELECT project, 30 + n AS place, '  • ' || {_CUT('title', 80)} || coalesce(' (' || year || ')', '') AS line FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY place, '  • ' || {_CUT('title', 80)} || coalesce(' (' || year || ')', '')) AS n FROM e) WHERE n <= 3),
lines AS (SELECT project, unnest([0, 10, 20, 30, 50, 60, 80]) AS place, unnest(['Workbench context (read-only):', '- Target product: ' || target, '- Active tool: ' || tool, '- Evidence bundle: ' || selected || ' selected of ' || saved || ' saved', '- Top bottleneck: ' || {_CUT('bottleneck', 120)}, '- Thermodynamic concern: ' || concern, '- Workflow state: ' || status || ' (idle)']) AS line FROM p LEFT JOIN sv USING (project) WHERE coalesce(target, tool, status) IS NOT NULL OR saved > 0),
every AS (SELECT project, place, line FROM lines WHERE line IS NOT NULL UNION ALL SELECT project, place, line FROM named), w AS (SELECT *, {_BUDGET} - coalesce(sum(length(line) + 1) OVER (PARTITION BY project ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM every)
SELECT project, string_agg(CASE WHEN length(line) <= room THEN line ELSE rtrim(substr(line, 1, (room - 1)::INTEGER)) || '…' END, chr(10) ORDER BY place) AS text, count(*) AS n, max((length(line) > room)::INTEGER) = 1 AS cut FROM w WHERE room > 0 GROUP BY project""")
def prompt_contexts(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations")
    p, lit = F.col("project"), F.lit
    own = c.select(F.col("conv_id").alias("project")).distinct()
    none = lambda when, x: F.when(when, x)
    projects = own.select("project", none(p % 6 != 5, F.concat(lit("P"), p.cast("string"))).alias("target"), none(p % 4 == 1, lit("pathd")).alias("tool"), none(p % 3 == 0, lit("ready")).alias("status"), lit("idle").alias("machine"), none(p % 5 == 0, F.repeat(lit("slow step "), 20)).alias("bottleneck"), none(p % 2 == 0, lit("warm")).alias("concern"), (p % 3).alias("selected"))
    evidence = c.where("conv_id % 6 <> 5").select(F.col("conv_id").alias("project"), F.col("turn").alias("place"), F.col("text").alias("title"), F.when(F.col("turn") % 2 == 0, (2000 + F.col("turn")).cast("string")).alias("year"))
    steps = own.select("project", lit(0).alias("place"), lit("x").alias("tool")).limit(0)
    return context.within_budget(context.context_lines(projects, evidence, steps), "project", ["place"], _BUDGET)


@query("""SELECT doc_id, sha256('Title: ' || lang || CASE WHEN doc_id % 3 > 0 THEN chr(10) || 'Authors: ' || CASE doc_id % 3 WHEN 1 THEN 'A' ELSE 'A, B' END ELSE '' END || CASE WHEN doc_id % 4 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN '' ELSE chr(10) || 'Source: ' || concat_ws(' · ', CASE WHEN doc_id % 4 <> 0 THEN source END, CASE WHEN doc_id % 5 = 0 THEN '1999' END, CASE WHEN doc_id % 7 <> 0 THEN 'DOI: d' || doc_id END) END || CASE WHEN text <> '' THEN chr(10) || 'Abstract: ' || text ELSE '' END) AS digest FROM documents""")
def evidence_texts(spark, sf_dir):
    n = F.col("doc_id")
    authors = F.slice(F.array(F.lit("A"), F.lit("B")), F.lit(1), (n % 3).cast("int"))
    text = context.evidence_text(F.col("lang"), authors, F.when(n % 4 == 0, F.lit(None)).otherwise(F.col("source")), F.lit(None).cast("string"), F.when(n % 5 == 0, "1999"), F.when(n % 7 != 0, F.concat(F.lit("d"), n.cast("string"))), F.col("text"))
    return v.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"))
