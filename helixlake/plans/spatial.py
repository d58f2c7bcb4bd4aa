"""Single-cell and spatial queries."""

from pyspark.sql import functions as F

from helixlake.operators import spatial as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded
from helixlake.session import cut
from helixlake.sources import views as v

GENE = 3
_CDF = "(0.5 * (1 + (CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END) * (1 - ((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z})))))"


def cdf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    return _CDF.format(x=x, z=z, t=f"(1 / (1 + 0.3275911 * {z}))")


_TOTALS = f"""WITH {v.COUNTS}, totals AS (SELECT cell, sum(count)::BIGINT AS total_counts, count(*) FILTER (count > 0) AS n_genes,
  floor(coalesce(sum(CASE WHEN upper(gene) LIKE 'MT-%' THEN count ELSE 0 END) * 100.0 / nullif(sum(count), 0), 0.0) * 100 + 0.5) / 100 AS mito_percent FROM counts GROUP BY cell)"""
_KNN = f"""WITH {v.EXPRESSION}, pairs AS (SELECT a.cell AS i, b.cell AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.cell <> b.cell),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j)::INTEGER AS rank FROM pairs) WHERE rank <= 6)"""
_CENTRE = f"WITH {v.EXPRESSION}, centre AS (SELECT cluster, gene, sum(value) / count(DISTINCT cell) AS mean FROM expression GROUP BY ALL)"
_PAGA = f"""{_CENTRE}, d AS (SELECT p.cluster AS a, q.cluster AS b, sqrt(sum(power(p.mean - q.mean, 2))) AS d FROM centre p JOIN centre q ON p.gene = q.gene AND p.cluster < q.cluster GROUP BY ALL),
paga AS (SELECT a, b, 1 - d / (SELECT CASE WHEN max(d) = 0 THEN 1 ELSE max(d) END FROM d) AS weight FROM d)"""


def edges(spark, sf_dir):
    return op.knn(v.cells(spark, sf_dir), 6)


@query(f"{_TOTALS} SELECT cell, total_counts, n_genes, {r('mito_percent')} FROM totals")
def cell_totals(spark, sf_dir):
    return rounded(op.cell_totals(v.counts(spark, sf_dir)))


@query(f"""{_TOTALS}, f AS (SELECT *, mito_percent < 20 AND total_counts >= 30 AND n_genes >= 4 AS ok FROM totals)
SELECT count(*) AS total_cells, count(*) FILTER (ok) AS passed_cells, count(*) FILTER (NOT ok) AS filtered_cells, {r('coalesce(median(total_counts) FILTER (ok), 0.0)', 'median_counts')},
{r('coalesce(median(n_genes) FILTER (ok), 0.0)', 'median_genes')}, {r('coalesce(median(mito_percent) FILTER (ok), 0.0)', 'median_mito')} FROM f""")
def qc_summary(spark, sf_dir):
    return rounded(op.qc_summary(op.cell_totals(v.counts(spark, sf_dir)), 20.0, 30, 4))


@query(f"""{_TOTALS}, f AS (SELECT *, mito_percent < 20 AND total_counts >= 500 AND n_genes >= 200 AS qc_pass FROM totals), p AS (SELECT count(*) FILTER (qc_pass) AS passed FROM f)
SELECT cell, total_counts, n_genes, {r('mito_percent')}, qc_pass, passed = 0 AS qc_fallback FROM f CROSS JOIN p WHERE qc_pass OR passed = 0""")
def qc_or_all(spark, sf_dir):
    return rounded(op.qc_or_all(op.cell_totals(v.counts(spark, sf_dir))))


@query(f"WITH {v.COUNTS}, t AS (SELECT cell, sum(count) AS total FROM counts GROUP BY cell) SELECT cell, gene, {r('ln(1 + count * (10000.0 / total))', 'value')} FROM counts JOIN t USING (cell)")
def normalize_log1p(spark, sf_dir):
    return rounded(op.normalize_log1p(v.counts(spark, sf_dir)))


@query(f"""WITH {v.EXPRESSION}, n AS (SELECT count(DISTINCT cell) AS n FROM expression), st AS (SELECT gene, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)) AS variance FROM expression CROSS JOIN n GROUP BY gene),
tr AS (SELECT *, variance / greatest(avg(variance) OVER (ORDER BY mean, gene ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 1e-12) AS variance_norm, row_number() OVER (ORDER BY mean, gene)::INTEGER AS mean_rank FROM st),
rk AS (SELECT *, row_number() OVER (ORDER BY variance_norm DESC, mean_rank)::INTEGER AS rank FROM tr) SELECT gene, {r('mean')}, {r('variance')}, {r('variance_norm')}, mean_rank, rank, rank <= 20 AS is_hvg FROM rk""")
def hvg_rank(spark, sf_dir):
    return rounded(op.hvg(v.expression(spark, sf_dir), 20))


@query(f"{_KNN} SELECT i, j, {r('d')}, rank FROM edges")
def spatial_knn(spark, sf_dir):
    return rounded(edges(spark, sf_dir))


@query(f"""WITH {v.CELLS}, pairs AS (SELECT a.cell AS i, b.cell AS j, list_distance(a.v, b.v) AS d FROM cells a JOIN cells b ON a.cell <> b.cell)
SELECT i, j, {r('d')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j)::INTEGER AS rank FROM pairs) WHERE rank <= 15""")
def expression_knn(spark, sf_dir):
    return rounded(op.expression_knn(v.cells(spark, sf_dir)))


@query(f"{_KNN} SELECT c.n AS n_cells, e.n AS n_edges, {r('e.n / c.n::DOUBLE', 'avg_neighbors', 2)} FROM (SELECT count(*) AS n FROM cells) c, (SELECT count(*) AS n FROM edges) e")
def average_neighbors(spark, sf_dir):
    return op.average_neighbors(v.cells(spark, sf_dir), edges(spark, sf_dir))


_MORAN = f"""{_KNN}, g AS (SELECT gene, avg(value) AS mean, count(*)::DOUBLE AS n FROM expression GROUP BY gene), x AS (SELECT cell, gene, value - mean AS z FROM expression JOIN g USING (gene)),
den AS (SELECT gene, sum(z * z) AS den FROM x GROUP BY gene), num AS (SELECT a.gene, sum(a.z * b.z) AS num FROM edges e JOIN x a ON a.cell = e.i JOIN x b ON b.cell = e.j AND b.gene = a.gene GROUP BY a.gene),
w AS (SELECT sum(k)::DOUBLE AS w, sum((k * 2.0) * (k * 2.0)) AS s2 FROM (SELECT count(*) AS k FROM edges GROUP BY i)),
t AS (SELECT gene, n, w, n / w * num / den AS mi, -1.0 / (n - 1) AS ei, (n * n * 2 * w - n * s2 + 3 * w * w) / (w * w * (n * n - 1)) - (-1.0 / (n - 1)) * (-1.0 / (n - 1)) AS var FROM g JOIN den USING (gene) JOIN num USING (gene) CROSS JOIN w),
mz AS (SELECT gene, mi, ei, (mi - ei) / sqrt(greatest(var, 1e-12)) AS z FROM t), moran AS (SELECT gene, mi AS moran_i, ei AS expected_i, z, 2 * (1 - {cdf('abs(z)')}) AS p FROM mz)"""


@query(f"{_MORAN} SELECT gene, {r('moran_i')}, {r('expected_i')}, {r('z', digits=4)}, {r('p')}, p < 0.05 AND moran_i > 0.2 AS restricted FROM moran")
def morans_i(spark, sf_dir):
    out = op.morans_i(v.expression(spark, sf_dir), edges(spark, sf_dir))
    return rounded(rounded(out, "moran_i", "expected_i", "p"), "z", digits=4)


@query(f"{_MORAN} SELECT gene, {r('moran_i')} FROM (SELECT gene, moran_i FROM moran ORDER BY moran_i DESC, gene LIMIT 12)")
def moran_hotspots(spark, sf_dir):
    return rounded(op.hotspots(op.morans_i(v.expression(spark, sf_dir), edges(spark, sf_dir))).select("gene", "moran_i"))


@query(f"{_KNN} SELECT {r('avg(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END)', 'purity')} FROM edges e JOIN cells a ON a.cell = e.i JOIN cells b ON b.cell = e.j")
def neighbor_purity(spark, sf_dir):
    return rounded(op.neighbor_purity(v.cells(spark, sf_dir), edges(spark, sf_dir)))


@query(f"""{_KNN}, u AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM edges), l AS (SELECT p.cluster AS ca, q.cluster AS cb FROM u JOIN cells p ON p.cell = a JOIN cells q ON q.cell = b),
dd AS (SELECT sum(k * k)::DOUBLE AS dd FROM (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM l UNION ALL SELECT cb FROM l) GROUP BY c)), m AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (ca = cb) AS inner_ FROM l)
SELECT {r('inner_ / m - dd / (4.0 * m * m)', 'modularity')} FROM m, dd""")
def newman_modularity(spark, sf_dir):
    return rounded(op.modularity(v.cells(spark, sf_dir), edges(spark, sf_dir)))


@query(f"WITH {v.CELLS} SELECT cluster, count(*) AS size FROM cells GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return op.cluster_sizes(v.cells(spark, sf_dir))


@query(f"{_CENTRE} SELECT cluster, gene, {r('mean')} FROM centre")
def cluster_centroids(spark, sf_dir):
    return rounded(op.centroids(v.expression(spark, sf_dir)))


@query(f"{_PAGA} SELECT a, b, {r('weight')}, weight > 0.15 AS drawn FROM paga")
def paga_edges(spark, sf_dir):
    return rounded(op.paga_edges(v.expression(spark, sf_dir)))


def _times(spark, sf_dir):
    e = cut(op.paga_edges(v.expression(spark, sf_dir)))
    return e, cut(op.pseudotime(op.cluster_sizes(v.cells(spark, sf_dir)), e))


@query()
def paga_pseudotime(spark, sf_dir):
    return rounded(op.trajectory_layout(_times(spark, sf_dir)[1]))


@query()
def paga_branching(spark, sf_dir):
    e, t = _times(spark, sf_dir)
    return rounded(t.join(op.branching(e, t), "cluster", "left"))


@query()
def high_yield_clusters(spark, sf_dir):
    e, t = _times(spark, sf_dir)
    x = v.expression(spark, sf_dir)
    return op.high_yield(op.cluster_sizes(v.cells(spark, sf_dir)), t, op.branching(e, t), op.marker_genes(x), op.morans_i(x, edges(spark, sf_dir)))


@query(f"""{_CENTRE}, d AS (SELECT c.cell, c.cluster, m.cluster AS other, sqrt(sum((c.value - m.mean) * (c.value - m.mean))) AS d FROM expression c JOIN centre m ON m.gene = c.gene GROUP BY ALL),
s AS (SELECT cell, min(d) FILTER (cluster = other) AS a, min(d) FILTER (cluster <> other) AS b FROM d GROUP BY cell) SELECT {r('avg(CASE WHEN b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b, 1e-6) END)', 'silhouette')} FROM s""")
def centroid_silhouette(spark, sf_dir):
    return rounded(op.centroid_silhouette(v.cells(spark, sf_dir), v.expression(spark, sf_dir)))


@query(f"""WITH {v.EXPRESSION}, g AS (SELECT cluster, gene, sum(value) / count(DISTINCT cell) AS mean, count(*) FILTER (value > 0) / count(DISTINCT cell)::DOUBLE * 100 AS pct FROM expression GROUP BY ALL)
SELECT cluster, gene, {r('mean', 'mean_expression', 3)}, {r('pct', 'pct_expressed', 1)}, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean * pct DESC, gene)::INTEGER AS rank FROM g) WHERE rank <= 5""")
def marker_genes(spark, sf_dir):
    return op.marker_genes(v.expression(spark, sf_dir))


@query(f"WITH {v.EXPRESSION} SELECT c.cluster, c.size, {r('coalesce(s, 0.0) / size', 'mean_gene')} FROM (SELECT cluster, count(*) AS size FROM cells GROUP BY cluster) c LEFT JOIN (SELECT cluster, sum(value) AS s FROM expression WHERE gene = {GENE} GROUP BY cluster) g ON g.cluster = c.cluster")
def cluster_summary(spark, sf_dir):
    return rounded(op.cluster_summary(v.cells(spark, sf_dir), v.expression(spark, sf_dir), GENE))


@query(f"""WITH {v.EXPRESSION}, s AS (SELECT e.gene, count(*)::DOUBLE AS n, sum(o.value) AS sx, sum(e.value) AS sy, sum(o.value * o.value) AS sxx, sum(e.value * e.value) AS syy, sum(o.value * e.value) AS sxy
  FROM expression e JOIN expression o ON o.cell = e.cell AND o.gene = {GENE} WHERE e.gene <> {GENE} GROUP BY e.gene), c AS (SELECT gene, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM s)
SELECT gene, {r('r')} FROM (SELECT * FROM c ORDER BY abs(r) DESC, gene LIMIT 6)""")
def coexpression_top6(spark, sf_dir):
    return rounded(op.coexpression(v.expression(spark, sf_dir), GENE))


@query(f"WITH {v.CELLS}, s AS (SELECT coalesce(max(cluster) FILTER (cluster = 99), arg_min(cluster, cell)) AS cluster FROM cells) SELECT cell, {r('x')}, {r('y')}, {r('v[3]', 'z')}, true AS selected FROM cells WHERE cluster = (SELECT cluster FROM s)")
def view_points(spark, sf_dir):
    c = v.cells(spark, sf_dir)
    own = c.join(F.broadcast(op.selected_cluster(c, 99)), "cluster", "left_semi")
    return rounded(op.view_points(own, "embedding").withColumn("selected", F.lit(True)), "x", "y", "z")


@query("""WITH o AS (SELECT p_partkey AS ord, nullif(trim(CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END), '') AS label FROM part), f AS (SELECT label, row_number() OVER (ORDER BY min(ord))::INTEGER - 1 AS cluster FROM o WHERE label IS NOT NULL GROUP BY label)
SELECT ord, o.label, coalesce(cluster, 0) AS cluster FROM o LEFT JOIN f ON f.label = o.label""")
def cluster_ordinals(spark, sf_dir):
    obs = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_type")).alias("label"))
    return op.cluster_ordinals(obs).select("ord", "label", "cluster")
