"""Source, record and small-group queries."""

from pyspark.sql import functions as F

from helixlake.functions import text as x
from helixlake.operators import cells as op
from helixlake.operators import literature, spatial
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded
from helixlake.sources import records, views as v


@query(f"WITH {v.CELLS}, d AS (SELECT cell, list_transform(v, lambda q: CASE WHEN q > 0.1 THEN q ELSE 0.0 END) AS v FROM cells), e AS (SELECT cell, (generate_subscripts(v, 1) - 1)::INTEGER AS gene, unnest(v) AS value FROM d) SELECT cell, gene, {r('value')} FROM e WHERE value <> 0")
def sparse_matrix(spark, sf_dir):
    d = v.cells(spark, sf_dir).select("cell", F.transform("v", lambda q: F.when(q > 0.1, q).otherwise(0.0)).alias("dense"))
    return rounded(records.sparse_long(records.sparse_rows(d, "cell", "dense")), "value")


@query("SELECT c_custkey AS cell, c_nationkey::VARCHAR AS cluster, NULL::VARCHAR AS cell_type, NULL::VARCHAR AS batch, c_name AS sample, c_mktsegment AS condition, NULL::VARCHAR AS replicate, floor(c_acctbal)::BIGINT::VARCHAR AS extra FROM customer")
def obs_records(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("Leiden"), F.col("c_name").alias("SAMPLE_ID"), F.col("c_mktsegment").alias("Treatment"), F.floor("c_acctbal").alias("balance"))
    return records.obs_records(c, "c_custkey").withColumn("extra", F.element_at("metadata", "balance")).drop("metadata")


_NODES = """raw AS (SELECT o_custkey AS doc, 'N ' || (o_orderkey % 40) AS id, 'label ' || o_orderkey AS label, ['enzyme', 'gene', 'metabolite', 'odd'][o_orderkey % 4 + 1] AS type, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice % 150) / 100 END AS confidence,
 (o_totalprice % 130) / 100 AS risk, o_totalprice % 120 - 10 AS efficiency FROM orders WHERE o_orderkey % 11 <> 0),
nodes AS (SELECT doc, regexp_replace(lower(id), '[^a-z0-9_]', '_', 'g') AS id, substr(label, 1, 32) AS label, CASE WHEN type = 'odd' THEN 'unknown' ELSE type END AS type, least(greatest(confidence, 0.0), 1.0) AS confidence, least(greatest(risk, 0.0), 1.0) AS risk, least(greatest(efficiency, 0.0), 100.0) AS efficiency FROM (SELECT *, CASE WHEN confidence IS NULL THEN 1 END AS gone FROM raw))"""


def _nodes(spark, sf_dir):
    o, p = F.col("o_orderkey"), F.col("o_totalprice")
    types = F.array(*map(F.lit, ["enzyme", "gene", "metabolite", "odd"]))
    raw = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.when(o % 11 != 0, F.concat(F.lit("N "), (o % 40).cast("string"))).alias("id"), F.concat(F.lit("label "), o.cast("string")).alias("label"), F.element_at(types, (o % 4 + 1).cast("int")).alias("type"),
        F.when(o % 5 != 0, (p % 150) / 100).alias("confidence"), ((p % 130) / 100).alias("risk"), (p % 120 - 10).alias("efficiency"),
    )
    return records.pathway_nodes(raw)


@query(f"WITH {_NODES} SELECT doc, id, label, type, CASE WHEN confidence IS NULL THEN NULL ELSE floor(confidence * 10000 + 0.5) / 10000 END AS confidence, {r('risk', digits=4)}, {r('efficiency', digits=4)} FROM (SELECT doc, id, label, type, CASE WHEN substr(label, 7)::BIGINT % 5 = 0 THEN NULL ELSE confidence END AS confidence, risk, efficiency FROM nodes)")
def pathway_nodes(spark, sf_dir):
    return rounded(_nodes(spark, sf_dir), digits=4)


@query(f"WITH {_NODES}, e AS (SELECT l_suppkey AS doc, 'n_' || (l_partkey % 50) AS a, 'n_' || (l_orderkey % 50) AS b, ['produces', 'other'][l_linenumber % 2 + 1] AS type FROM lineitem) SELECT doc, a, b, CASE type WHEN 'other' THEN 'unknown' ELSE type END AS type FROM e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.doc = e.doc AND n.id = e.a) AND EXISTS (SELECT 1 FROM nodes n WHERE n.doc = e.doc AND n.id = e.b)")
def pathway_edges(spark, sf_dir):
    kinds = F.array(F.lit("produces"), F.lit("other"))
    e = v.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.concat(F.lit("N "), (F.col("l_partkey") % 50).cast("string")).alias("a"), F.concat(F.lit("n-"), (F.col("l_orderkey") % 50).cast("string")).alias("b"), F.element_at(kinds, F.col("l_linenumber") % 2 + 1).alias("type"))
    return records.pathway_edges(e, _nodes(spark, sf_dir))


@query(f"WITH {_NODES} SELECT doc, id, floor(efficiency * 10 + 0.5) / 10 AS efficiency, greatest(0.0, floor(100 - efficiency + 0.5)) AS loss FROM nodes WHERE type = 'enzyme' AND efficiency < 40")
def pathway_bottlenecks(spark, sf_dir):
    return records.bottlenecks(_nodes(spark, sf_dir))


@query(f"WITH {_NODES}, n AS (SELECT *, CASE WHEN substr(label, 7)::BIGINT % 5 = 0 THEN 0.7 ELSE confidence END AS c FROM nodes) SELECT doc, count(*) AS n, {r('avg(c)', 'mean_confidence', 9)}, count(*) FILTER (risk > 0.7) AS high_risk, count(DISTINCT type) AS types FROM n GROUP BY doc")
def pathway_stats(spark, sf_dir):
    return rounded(records.graph_stats(_nodes(spark, sf_dir)), digits=9)


@query("SELECT p_partkey AS page, regexp_replace(trim('hsa:' || n_nationkey), '^[a-z]+:', '') AS id, n_name || ' ' || p_partkey AS name FROM part, nation WHERE n_regionkey = p_partkey % 5")
def tsv_links(spark, sf_dir):
    n = v.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))  # a region's few nations make a page
    line = lambda e: F.concat(F.lit("hsa:"), e["n_nationkey"].cast("string"), F.lit("\t"), e["n_name"], F.lit(" "), F.col("p_partkey").cast("string"))
    p = v.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("r")).join(F.broadcast(n), F.col("r") == F.col("n_regionkey"))  # 5 regions
    return literature.tsv_links(p.select(F.col("p_partkey").alias("page"), F.array_join(F.transform("rows", line), "\n").alias("text")), keep=("page",))


@query("SELECT doc_id AS id, array_to_string(list_filter([regexp_replace(text, '[^a-zA-Z ]', '', 'g'), lang], lambda x: trim(x) <> ''), ' ') AS abstract FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def abstract_xml(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    xml = F.concat(F.lit("<A><AbstractText>"), F.regexp_replace("text", "[^a-zA-Z ]", ""), F.lit("</AbstractText><B/><AbstractText>"), F.col("lang"), F.lit("</AbstractText></A>"))
    return d.select(F.col("doc_id").alias("id"), x.abstract_xml(xml).alias("abstract"))


_E = "e AS (SELECT doc_id AS id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '))) AS word FROM documents), w AS (SELECT item_id AS query, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM benchmark)"


@query(f"WITH {_E}, s AS (SELECT query, id, count(*) AS score FROM w JOIN e USING (word) GROUP BY ALL) SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def evidence_retrieval(spark, sf_dir):
    b = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    d = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return literature.evidence_for(b, d)


def _weights():
    return "MAP {" + ", ".join(f"'{a}': {w}" for a, (_, w) in op.CODONS.items()) + "}", "MAP {" + ", ".join(f"'{a}': '{c}'" for a, (c, _) in op.CODONS.items()) + "}"


_W, _C = _weights()


@query(f"""WITH p AS (SELECT doc_id AS id, string_split(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g'), '') AS a FROM documents),
q AS (SELECT id, list_filter(a, lambda z: z <> '') AS a FROM p), d AS (SELECT id, coalesce(array_to_string(list_transform(a, lambda z: coalesce(({_C})[z], 'NNN')), ''), '') AS dna, list_filter(a, lambda z: ({_W})[z] IS NOT NULL) AS k FROM q)
SELECT id, dna, {r(f'CASE WHEN len(k) > 0 THEN exp(list_sum(list_transform(k, lambda z: ln(({_W})[z]))) / len(k)) ELSE 0.0 END', 'cai', 3)}, {r("coalesce((length(dna) - length(translate(dna, 'GC', ''))) * 100.0 / nullif(length(dna), 0), 0.0)", 'gc', 3)} FROM d""")
def codon_optimised(spark, sf_dir):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return op.codon_optimised(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(up, "[^A-Z]", "").alias("seq")))


@query(f"WITH {v.CELLS} SELECT cluster, count(*) AS n_pairs, {r('avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))', 'distance')} FROM (SELECT * FROM cells) a JOIN cells b USING (cluster) WHERE a.cell < b.cell GROUP BY cluster")
def pair_distance(spark, sf_dir):
    return rounded(op.mean_pair_distance(v.cells(spark, sf_dir), "cluster", "cell", ["x", "y"]))


@query()
def cell_communities(spark, sf_dir):
    c = v.cells(spark, sf_dir)
    return op.communities(spatial.knn(c, 6).withColumn("dataset", F.lit(1)))


@query()
def cluster_hulls(spark, sf_dir):
    return rounded(op.hulls(v.cells(spark, sf_dir), "cluster"))
