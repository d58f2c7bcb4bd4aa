"""Queries of single functions, sources and sinks: each written or read as a user of the workbench would."""

import uuid

from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.functions import sequence as s
from helixlake.functions import text as x
from helixlake.operators import assay, flux, graph, ledger, omics, spatial
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded
from helixlake.session import shared_dir
from helixlake.sources import records
from helixlake.sources import views as v


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'S ' || c_custkey AS sample_id, CASE WHEN c_custkey % 6 = 0 THEN 95.0 ELSE c_acctbal END AS yield, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey / 10.0 END AS biomass, NULL::DOUBLE AS substrate FROM customer WHERE c_custkey % 5 <> 0")
def assay_file(spark, sf_dir):
    c, n = v.table(spark, sf_dir, "customer"), F.col("c_custkey")
    to = _folder(spark, "assay")
    value = F.when(n % 5 == 0, "NA").when(n % 6 == 0, " 95% ").otherwise(F.col("c_acctbal").cast("string"))
    c.select(F.concat(F.lit("S "), n.cast("string")).alias("Sample ID"), value.alias("Titer"), F.when(n % 4 == 0, "nan").otherwise((F.col("c_nationkey") / 10.0).cast("string")).alias("OD600"), F.lit('a "quoted", note').alias("Note")).write.csv(to, header=True, escape='"')
    return assay.read_assay(spark, to)


@query(f"WITH t AS (SELECT l_quantity * 2 + l_discount * 30 AS y, l_quantity * 2 + 1.5 AS f FROM lineitem) SELECT {r('1 - sum(power(y - f, 2)) / sum(power(y - (SELECT avg(y) FROM t), 2))', 'r2')} FROM t")
def goodness_of_fit(spark, sf_dir):
    t = v.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2 + F.col("l_discount") * 30).alias("y"), (F.col("l_quantity") * 2 + 1.5).alias("f"))
    return rounded(assay.r_squared(t, "y", "f"))


@query("SELECT reaction, flux FROM (SELECT l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey AS reaction, l_quantity - 25 AS flux FROM lineitem) ORDER BY abs(flux) DESC, reaction LIMIT 6")
def top_fluxes(spark, sf_dir):
    return flux.top_fluxes(v.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * F.lit(10000000000) + F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("reaction"), (F.col("l_quantity") - 25).alias("flux")))


_EDGES = "e AS (SELECT l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'catalysis' ELSE 'regulation' END AS role, l_partkey % 20 AS a, CASE WHEN l_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS relation, l_suppkey AS b, l_linenumber % 3 AS direction FROM lineitem)"


def _edges(spark, sf_dir):
    return v.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * F.lit(10000000000) + F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "catalysis").otherwise("regulation").alias("role"), (F.col("l_partkey") % 20).alias("a"),
        F.when(F.col("l_suppkey") % 2 == 0, "up").otherwise("down").alias("relation"), F.col("l_suppkey").alias("b"), (F.col("l_linenumber") % 3).alias("direction"),
    )


@query(f"WITH {_EDGES} SELECT role, a, relation, b, direction, min(ord) AS ord FROM e GROUP BY ALL")
def unique_edges(spark, sf_dir):
    return graph.unique_edges(_edges(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey = 3 OR l_suppkey = 3")
def incident_edges(spark, sf_dir):
    return graph.incident(v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), 3)


@query("SELECT task, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status, CASE WHEN status IN ('running', 'error') THEN 'interrupted' END AS note FROM (SELECT o_orderkey AS task, ['pending', 'running', 'done', 'error'][o_orderkey % 4 + 1] AS status FROM orders)")
def restored_queue(spark, sf_dir):
    names = F.array(*map(F.lit, ["pending", "running", "done", "error"]))
    return ledger.restore_queue(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("status")))


@query("SELECT p_partkey AS gene, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_size::DOUBLE END AS value FROM part")
def gene_efficiency(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    points = p.select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("double").alias("efficiency"))
    return omics.efficiency_by_gene(points, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score")))


@query(f"WITH {v.DNA}, x AS (SELECT id, seq, CASE WHEN id % 7 = 0 THEN seq || 'A' ELSE translate(seq, 'AG', 'CG') END AS other FROM dna), l AS (SELECT id, seq, other, range(1, length(seq) + 1) AS pos FROM x) SELECT id, {r('CASE WHEN length(seq) = length(other) AND length(seq) > 0 THEN len(list_filter(pos, lambda i: substr(seq, i, 1) = substr(other, i, 1))) / length(seq) ELSE 0.0 END', 'identity')} FROM l")
def sequence_identity(spark, sf_dir):
    d = v.dna(spark, sf_dir)
    other = F.when(F.col("id") % 7 == 0, F.concat("seq", F.lit("A"))).otherwise(F.translate("seq", "AG", "CG"))
    return rounded(d.select("id", s.identity(F.col("seq"), other).alias("identity")))


@query(f"WITH {v.DNA}, x AS (SELECT id, seq, substr(seq, 1, 8) AS b, range(6, greatest(length(seq) - 7, 6)) AS pos FROM dna WHERE length(seq) >= 8) SELECT id, len(list_filter(pos, lambda i: i > 13 AND (substr(seq, i + 1, 8) = b OR substr(seq, i + 1, 8) = reverse(translate(b, 'ATCG', 'TAGC'))))) > 0 AS elsewhere FROM x")
def mispriming(spark, sf_dir):
    d = v.dna(spark, sf_dir).where("length(seq) >= 8")
    return d.select("id", s.mispriming(F.substring("seq", 1, 8), F.col("seq"), F.lit(0), F.lit(8)).alias("elsewhere"))


@query("SELECT p_partkey AS variant, CASE p_partkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'A' || p_size || 'V' ELSE 'A' || least(p_size, 24) || 'V / K' || greatest(p_size, 26) || 'R' END AS text FROM part")
def mutation_strings(spark, sf_dir):
    size = F.col("p_size")
    one = lambda place, a, b: F.struct(place.alias("place"), F.lit(a).alias("before"), F.lit(b).alias("after"))
    low, high = one(F.least(size, F.lit(24)), "A", "V"), one(F.greatest(size, F.lit(26)), "K", "R")
    n = F.col("p_partkey") % 3
    made = F.when(n == 1, F.array(one(size, "A", "V"))).when(n == 2, F.array(high, low)).otherwise(F.slice(F.array(low), 1, 0))
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), s.mutation_text(made).alias("text"))


@query("WITH d AS (SELECT p_partkey AS id, 'MKTAYIAKQR' || chr((65 + p_size % 20)::INTEGER) || 'LMNPQRS' AS seq FROM part), p AS (SELECT id, unnest(range(1, length(seq) - 3)) AS place, seq FROM d), q AS (SELECT DISTINCT id, place, substr(seq, place, 5) AS motif FROM p) SELECT place::INTEGER AS place, motif FROM q GROUP BY place, motif HAVING count(*) = (SELECT count(*) FROM d) ORDER BY place LIMIT 20")
def consensus_motifs(spark, sf_dir):
    seq = F.concat(F.lit("MKTAYIAKQR"), F.chr(65 + F.col("p_size") % 20), F.lit("LMNPQRS"))
    return s.consensus_motifs(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), seq.alias("seq")))


@query("SELECT doc_id, 'b=' || CASE WHEN length(text) <= 160 THEN text ELSE rtrim(substr(text, 1, 159), ' ') || '…' END || ';c=' || lang AS metadata FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def log_metadata(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    kept = x.safe_metadata(F.create_map(F.lit("raw"), F.col("text"), F.lit("b"), F.col("text"), F.lit("c"), F.col("lang")))
    return d.select("doc_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@query("WITH t AS (SELECT conv_id, turn, replace(replace(text || chr(13) || chr(10) || 'x' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, substr(t, 1, 400) AS text, length(t) > 400 AS truncated FROM t")
def clean_prompts(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    raw = F.concat("text", F.lit("\r\nx\x00\r"))
    return c.select("conv_id", "turn", x.clean_prompt(raw, 400).alias("p")).select("conv_id", "turn", "p.text", "p.truncated")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = c_name THEN [c_name] ELSE [c_mktsegment, c_name] END AS names FROM customer")
def unique_names(spark, sf_dir):
    raw = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("  "), F.col("c_name"), F.concat("c_mktsegment", F.lit(" ")), F.lit(""), F.col("c_name"))
    return v.table(spark, sf_dir, "customer").select("c_custkey", x.unique_strings(raw).alias("names"))


_MESSAGES = ["http 429 rate limit", "request timed out", "401 api key", "404 not found", "cannot parse json", "network fetch", "odd", "confocal stack", "gfp signal", "electron view", "bright field", "flux model", "directed evolution", "cell-free run"]


def _rules(rules, otherwise: str | None = None) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{value}'" for words, value in rules) + (f" ELSE '{otherwise}'" if otherwise else "") + " END"


@query(f"WITH m AS (SELECT event_id, {'[' + ', '.join(repr(t) for t in _MESSAGES) + ']'}[event_id % {len(_MESSAGES)} + 1] AS t FROM events) SELECT event_id, {_rules(x.ERROR_RULES, 'unknown')} AS error, {_rules(x.IMAGING_RULES)} AS imaging, {_rules(x.ROUTE_RULES)} AS tool FROM m")
def keyword_rules(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES)).cast("int"))
    return v.table(spark, sf_dir, "events").select("event_id", x.first_rule(t, x.ERROR_RULES, "unknown").alias("error"), x.first_rule(t, x.IMAGING_RULES).alias("imaging"), x.first_rule(t, x.ROUTE_RULES).alias("tool"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (1950 + o_orderkey % 100)::INTEGER END AS year FROM orders")
def citation_years(spark, sf_dir):
    n = F.col("o_orderkey")
    text = F.when(n % 4 == 0, F.concat(F.lit("No. 31950"), (n % 10).cast("string"))).otherwise(F.concat(F.lit("Some One (12), "), (1950 + n % 100).cast("string"), F.lit(", p. 3; 1801")))
    return v.table(spark, sf_dir, "orders").select("o_orderkey", x.year_of(text).alias("year"))


@query("SELECT doc_id, regexp_replace(text, '(the|and)', '<mark>\\1</mark>', 'gi') AS marked FROM documents")
def highlighted(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", x.highlight(F.col("text"), F.lit("the|and")).alias("marked"))


@query("SELECT doc_id AS id, upper(lang) AS title, 'dump' AS source FROM documents ORDER BY doc_id LIMIT 5")
def connector_rows(spark, sf_dir):
    return records.connector(v.table(spark, sf_dir, "documents"), "dump", {"id": "doc_id", "title": F.upper("lang")})


@query("SELECT vec_id AS cell, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 3 = 1 THEN embedding[3]::DOUBLE END AS z FROM embeddings WHERE vec_id % 3 <> 0")
def cell_coordinates(spark, sf_dir):
    n = F.col("vec_id")
    p = v.cells(spark, sf_dir).withColumnRenamed("cell", "vec_id").select("vec_id", F.slice("v", F.lit(1), F.when(n % 3 == 0, 5).when(n % 3 == 1, 3).otherwise(2)).alias("p"))
    return records.coordinates(p, "vec_id", "p")


@query("SELECT n_nationkey, n_name, 'draft' AS status, 0 AS revision FROM nation")
def migrated_columns(spark, sf_dir):
    return records.add_missing(v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"n_name": "x", "status": "draft", "revision": 0})


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS text, o_orderkey % 4 NOT IN (0, 1) AS items, o_orderkey % 5 > 2 AS number FROM orders")
def present_values(spark, sf_dir):
    n = F.col("o_orderkey")
    o = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(n % 3 == 0, F.when(n % 2 == 0, "")).otherwise("x").alias("t"), F.when(n % 4 == 0, F.array().cast("array<int>")).when(n % 4 != 1, F.array(F.lit(1))).alias("a"),
        F.when(n % 5 == 0, float("nan")).when(n % 5 == 1, float("inf")).when(n % 5 != 2, 1.0).alias("d"),
    )
    return o.select("o_orderkey", *[records.present(F.col(c), kind).alias(name) for c, kind, name in (("t", "string", "text"), ("a", "array", "items"), ("d", "number", "number"))])


@query("SELECT vec_id AS cell, 'a=' || CASE WHEN embedding[1] > 0 THEN '+' ELSE '-' END || ',c=' || CASE WHEN embedding[3] > 0 THEN '+' ELSE '-' END AS expression FROM embeddings")
def gene_maps(spark, sf_dir):
    sign = lambda i: F.when(F.element_at("v", i) > 0, "+").otherwise("-")
    rows = v.cells(spark, sf_dir).select("cell", F.array(F.lit(0), F.lit(2), F.lit(9), F.lit(-1)).alias("indices"), F.array(sign(1), sign(3), sign(1), sign(1)).alias("values"))
    out = spatial.gene_maps(rows, ["a", "b", "c"])
    return out.select("cell", F.array_join(F.transform(F.map_entries("expression"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("expression"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'YES' ELSE 'no' END AS urgent FROM nation")
def order_file(spark, sf_dir):
    to = _folder(spark, "order")
    records.primer_order(v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("urgent")), to)
    return records.benchmark_labels(spark, to)


@query("SELECT n_regionkey::INTEGER AS artifact_id, n_nationkey AS cell, CASE WHEN n_regionkey = 2 THEN 'new' ELSE n_name END AS label FROM nation")
def artifact_tables(spark, sf_dir):
    to = _folder(spark, "artifact")
    n = v.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("artifact_id"), F.col("n_nationkey").alias("cell"), F.col("n_name").alias("label"))
    records.save_artifact({"obs": n}, to)
    records.save_artifact({"obs": n.where("artifact_id = 2").withColumn("label", F.lit("new"))}, to)
    return spark.read.parquet(f"{to}/obs").select("artifact_id", "cell", "label")


@query(f"SELECT p_partkey AS gene, {r('CASE WHEN p_size > 3 AND p_retailprice > 950 THEN log2((p_size - 3) / (p_retailprice - 950)) ELSE 0.0 END', 'change')} FROM part")
def fold_changes(spark, sf_dir):
    return rounded(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), m.log2_fold_change(F.col("p_size") - 3, F.col("p_retailprice") - 950).alias("change")))
