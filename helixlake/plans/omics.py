"""Multi-omics and assay queries."""

from pyspark.sql import functions as F

from helixlake.operators import assay, omics as op
from helixlake.plans.registry import query
from helixlake.plans.spatial import cdf
from helixlake.plans.tools import r, rounded, values
from helixlake.sources import constants as k
from helixlake.sources import views as v

_LONG = f"WITH {v.OMICS}, long AS (SELECT gene, 'transcriptomics' AS layer, transcript AS value FROM omics UNION ALL SELECT gene, 'proteomics', protein FROM omics UNION ALL SELECT gene, 'metabolomics', metabolite FROM omics)"
_SIGNALS = f"""WITH {v.OMICS}, o AS (SELECT var_pop(transcript) AS vt, var_pop(protein) AS vp, var_pop(metabolite) AS vx, sum(abs(transcript - protein)) AS tp, sum(abs(protein - metabolite)) AS px, sum(abs(transcript - metabolite)) AS tx,
 coalesce(sum(abs(transcript)) FILTER (p_value < 0.05), 0.0) AS st, coalesce(sum(abs(protein)) FILTER (p_value < 0.05), 0.0) AS sp, coalesce(sum(abs(metabolite)) FILTER (p_value < 0.05), 0.0) AS sx,
 sum(greatest(transcript - protein, 0.0)) AS g1, sum(greatest(protein - metabolite, 0.0)) AS g2 FROM omics),
n AS (SELECT *, vt + vp + vx + 1e-10 AS v, tp + px + tx + 1e-10 AS d, st + sp + sx + 1e-10 AS s, g1 + g2 + 1e-10 AS g FROM o),
signals AS (SELECT 'Variance' AS head, 'transcriptomics' AS layer, vt / v AS weight, vt AS strength, 0.0 AS bottleneck FROM n UNION ALL SELECT 'Variance', 'proteomics', vp / v, vp, 0.0 FROM n UNION ALL SELECT 'Variance', 'metabolomics', vx / v, vx, 0.0 FROM n
 UNION ALL SELECT 'Discordance', 'transcriptomics', (tp + tx) / d / 2, tp + tx, 0.0 FROM n UNION ALL SELECT 'Discordance', 'proteomics', (tp + px) / d / 2, tp + px, 0.0 FROM n UNION ALL SELECT 'Discordance', 'metabolomics', (px + tx) / d / 2, px + tx, 0.0 FROM n
 UNION ALL SELECT 'Significance', 'transcriptomics', st / s, st, 0.0 FROM n UNION ALL SELECT 'Significance', 'proteomics', sp / s, sp, 0.0 FROM n UNION ALL SELECT 'Significance', 'metabolomics', sx / s, sx, 0.0 FROM n
 UNION ALL SELECT 'Bottleneck', 'transcriptomics', 0.1, g1, g1 / g FROM n UNION ALL SELECT 'Bottleneck', 'proteomics', g1 / g, g1, g1 / g FROM n UNION ALL SELECT 'Bottleneck', 'metabolomics', g2 / g, g2, g2 / g FROM n)"""


@query(f"{_LONG}, s AS (SELECT layer, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY layer) SELECT gene, layer, {r('CASE WHEN sd < 1e-10 THEN 0.0 ELSE (value - mean) / sd END', 'z')} FROM long JOIN s USING (layer)")
def omics_zscore(spark, sf_dir):
    return rounded(op.z_scores(v.omics(spark, sf_dir)))


@query(f"WITH {v.OMICS} SELECT gene, {r('fold_change', 'x')}, {r('least(greatest(-log10(greatest(p_value, 1e-5)), 0.0), 5.0)', 'y')}, CASE WHEN fold_change > 0 THEN 'up' ELSE 'down' END AS direction FROM omics WHERE p_value < 0.05 AND abs(fold_change) > 1.0")
def volcano_hits(spark, sf_dir):
    return rounded(op.volcano(v.omics(spark, sf_dir)))


@query(f"{_SIGNALS} SELECT head, layer, {r('weight')}, {r('strength', digits=3)}, {r('bottleneck')} FROM signals")
def layer_signal_heads(spark, sf_dir):
    return rounded(rounded(op.layer_signals(v.omics(spark, sf_dir)), "weight", "bottleneck"), "strength", digits=3)


@query(f"""{_SIGNALS}, t AS (SELECT layer, sum(weight * CASE head WHEN 'Variance' THEN 0.2 WHEN 'Discordance' THEN 0.25 WHEN 'Significance' THEN 0.25 ELSE 0.3 END) AS vote FROM signals GROUP BY layer)
SELECT arg_max(layer, vote) AS layer, {r('max(vote) / (sum(vote) + 1e-10)', 'confidence', 3)} FROM t""")
def dominant_layer(spark, sf_dir):
    return op.dominant_layer(v.omics(spark, sf_dir))


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {op.LAYERS[a]} AS x, {op.LAYERS[b]} AS y FROM omics" for a, b in (("transcriptomics", "proteomics"), ("proteomics", "metabolomics"), ("transcriptomics", "metabolomics")))


@query(f"""WITH {v.OMICS}, s AS (SELECT a, b, count(*)::DOUBLE AS n, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM ({_PAIRS}) GROUP BY a, b), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r + 1e-10)) AS t FROM s)
SELECT a, b, {r('r', digits=3)}, {r(f"greatest(1e-10, 2 * (1 - {cdf('abs(t)')}))", 'p')} FROM t""")
def layer_correlation(spark, sf_dir):
    return rounded(op.layer_correlation(v.omics(spark, sf_dir)))


_FLUX = "least(greatest(metabolite / (greatest(0.01, (transcript + protein) / 2) + 1), 0.0), 1.0)"
_BAL = "greatest(0.0, 1 - abs(transcript - protein) / ((CASE WHEN t1 = t0 THEN 1.0 ELSE t1 - t0 END) * 0.5))"
_YIELD = "greatest(0.0, (metabolite - m0) / (CASE WHEN m1 = m0 THEN 1.0 ELSE m1 - m0 END))"


@query(f"""WITH {v.OMICS}, s AS (SELECT min(transcript) AS t0, max(transcript) AS t1, min(metabolite) AS m0, max(metabolite) AS m1 FROM omics)
SELECT gene, {r(f'least(greatest({_FLUX} * 0.4 + {_BAL} * 0.3 + {_YIELD} * 0.3, 0.0), 1.0)', 'score', 3)}, {r(_FLUX, 'flux', 3)}, {r(_BAL, 'balance', 3)}, {r(_YIELD, 'metabolite_yield', 3)} FROM omics CROSS JOIN s""")
def metabolic_efficiency(spark, sf_dir):
    return op.metabolic_efficiency(v.omics(spark, sf_dir))


@query(f"WITH {v.OMICS}, o AS (SELECT CASE WHEN gene % 5 = 0 THEN NULL ELSE transcript END AS t, protein AS p, CASE WHEN gene % 3 = 0 THEN NULL ELSE metabolite END AS x FROM omics) SELECT {r('((count(*) - count(t)) + (count(*) - count(p)) + (count(*) - count(x))) / (count(*) * 3)::DOUBLE', 'missing_rate')} FROM o")
def missing_rate(spark, sf_dir):
    rows = v.omics(spark, sf_dir).withColumns({"transcript": F.when(F.col("gene") % 5 != 0, F.col("transcript")), "metabolite": F.when(F.col("gene") % 3 != 0, F.col("metabolite"))})
    return rounded(op.missing_rate(rows))


@query(f"""WITH {v.OMICS}, s AS (SELECT min(transcript) AS a0, max(transcript) AS a1, min(protein) AS b0, max(protein) AS b1, min(metabolite) AS c0, max(metabolite) AS c1 FROM omics)
SELECT gene, {', '.join(r(f'CASE WHEN {k}1 - {k}0 > 1e-6 THEN ({c} - {k}0) / ({k}1 - {k}0) * 2 - 1 ELSE 0.0 END', n) for k, c, n in (('a', 'transcript', 'x'), ('b', 'protein', 'y'), ('c', 'metabolite', 'z')))} FROM omics CROSS JOIN s""")
def unit_coordinates(spark, sf_dir):
    return rounded(op.unit_coordinates(v.omics(spark, sf_dir)))


_EFFECTS = values("effects", "gene, impact, metabolites", [(i, f, m) for i, (_, f, m) in enumerate(k.FLUX_EFFECTS, 1)])


@query(f"""WITH {v.OMICS}, {_EFFECTS}, changes AS (SELECT gene, transcript + (gene % 7 - 3) AS perturbed FROM omics UNION ALL SELECT -1, 1.0),
x AS (SELECT c.gene, c.perturbed, o.transcript, c.perturbed - o.transcript AS delta, abs(o.transcript - o.protein) AS apart, CASE WHEN abs(o.transcript - o.protein) > 1.5 THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END AS scaling, e.impact::DOUBLE AS impact, e.metabolites, o.gene IS NOT NULL AS found FROM changes c LEFT JOIN omics o USING (gene) LEFT JOIN effects e USING (gene)),
y AS (SELECT *, CASE WHEN impact IS NOT NULL THEN delta * scaling * impact * 8 ELSE delta * scaling * 3 END AS change, floor(CASE WHEN impact IS NOT NULL THEN delta * scaling * impact * 0.75::DOUBLE ELSE delta * scaling * 0.3::DOUBLE END * 100 + 0.5) / 100 AS shift FROM x)
SELECT gene, {r('coalesce(transcript, 0.0)', 'original')}, {r('perturbed')}, {r('delta')}, {r('apart', 'discordance')}, CASE WHEN found THEN scaling END AS scaling, CASE WHEN found THEN floor(change * 10 + 0.5) / 10 ELSE 0.0 END AS yield_change, {r('CASE WHEN found THEN greatest(least(1 - abs(delta) * 0.1::DOUBLE, 0.95::DOUBLE), 0.3::DOUBLE) ELSE 0.0 END', 'confidence')},
 CASE WHEN found THEN array_to_string(list_transform(coalesce(metabolites, ['General metabolite pool']), lambda m: m || CASE WHEN CASE WHEN impact IS NOT NULL THEN shift ELSE delta END > 0 THEN ' up' ELSE ' down' END), ', ') ELSE '' END AS shifts, CASE WHEN found THEN shift END AS shift FROM y""")
def omics_perturbation(spark, sf_dir):
    o = v.omics(spark, sf_dir)
    effects = spark.createDataFrame([(i, f, m) for i, (_, f, m) in enumerate(k.FLUX_EFFECTS, 1)], "gene long, impact double, metabolites array<string>")
    changes = o.select("gene", (F.col("transcript") + (F.col("gene") % 7 - 3)).alias("perturbed")).union(spark.createDataFrame([(-1, 1.0)], "gene long, perturbed double"))
    out = rounded(op.perturb(o, changes, effects), "original", "perturbed", "delta", "discordance", "confidence")
    return out.withColumn("shift", F.get("shifts", F.lit(0))["delta"]).withColumn("shifts", F.array_join(F.transform("shifts", lambda x: F.concat_ws(" ", x["metabolite"], x["direction"])), ", "))


@query()
def latent_factors(spark, sf_dir):
    return op.latent_factors(v.omics(spark, sf_dir))


@query(f"WITH {v.ASSAYS} SELECT count(*) AS n, {r('avg(yield)', 'mean', 2)}, {r('stddev_pop(yield)', 'std', 2)}, {r('min(yield)', 'min', 2)}, {r('max(yield)', 'max', 2)}, arg_max(sample, (yield, -sample)) AS best, arg_min(sample, (yield, sample)) AS worst FROM assays")
def assay_stats(spark, sf_dir):
    return rounded(assay.yield_stats(v.assays(spark, sf_dir)), digits=2)


@query(f"""WITH {v.ASSAYS}, s AS (SELECT strain, count(*) AS n, avg(yield) AS mean, stddev_pop(yield) AS std FROM assays GROUP BY strain), j AS (SELECT * FROM assays JOIN s USING (strain))
SELECT sample, 'sensor_anomaly' AS flag FROM j WHERE yield > 450000 UNION ALL SELECT sample, 'below_detection' FROM j WHERE yield < 0.01 AND biomass > 0.1 UNION ALL SELECT sample, 'outlier' FROM j WHERE n >= 3 AND std > 0 AND abs(yield - mean) > 1.7 * std""")
def assay_qc_flags(spark, sf_dir):
    return assay.qc_flags(v.assays(spark, sf_dir), "strain", 450_000.0, 1.7)


@query(f"""WITH {v.ASSAYS}, g AS (SELECT avg(yield / 100000) AS y, avg(biomass) AS b, avg(biomass * 3) AS s FROM assays), k AS (SELECT *, y / b AS od, y / s AS cv FROM g),
f AS (SELECT 1 AS ord, 'precursor loading' AS parameter, floor(s * 10 + 0.5) / 10 AS current, floor(s * 1.25 * 10 + 0.5) / 10 AS suggested, 8 + 20 * least(1.0, (3.6 - y) / 3.6) AS gain, 8.0 AS lo, 30.0 AS hi, y < 3.6 AS fires FROM k
 UNION ALL SELECT 2, 'promoter strength', 1000.0, 1500.0, 10 + 20 * (50 - od) / 50, 10.0, 28.0, b > 0 AND od < 50 FROM k UNION ALL SELECT 3, 'induction temperature', 37.0, 30.0, 8 + 10 * (1 - b), 8.0, 18.0, b > 0 AND b < 1 FROM k
 UNION ALL SELECT 4, 'carbon feeding rate', floor(s / 48 * 100 + 0.5) / 100, floor(s * 0.8 / 48 * 100 + 0.5) / 100, 6 + 10 * (5 - cv) / 5, 6.0, 16.0, s > 0 AND cv < 5 FROM k)
SELECT ord, parameter, current, suggested, {r('least(greatest(gain, lo), hi)', 'improvement', 1)} FROM f WHERE fires""")
def moo_suggestions(spark, sf_dir):
    rows = v.assays(spark, sf_dir).withColumns({"yield": F.col("yield") / 100000, "substrate": F.col("biomass") * 3})
    return assay.suggestions(rows, 3.0)


@query("""WITH i AS (SELECT o_orderkey AS iteration, o_totalprice AS result, o_totalprice > 150000 AS passed FROM orders) SELECT floor(avg(passed::INTEGER::DOUBLE) * 1000000 + 0.5) / 1000000 AS pass_rate,
floor((arg_max(result, iteration) - arg_min(result, iteration)) / count(*) * 1000000 + 0.5) / 1000000 AS improvement_rate, arg_max(iteration, (result, -iteration)) AS best FROM i""")
def iteration_rates(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("result"), (F.col("o_totalprice") > 150000).alias("passed"))
    return rounded(assay.iteration_rates(rows))


@query(f"SELECT least(floor(value / 10), 9)::INTEGER AS bin, count(*) AS n, {r('avg(value)', 'mean', 4)} FROM events GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return rounded(assay.histogram(v.table(spark, sf_dir, "events"), "value"), digits=4)


@query(f"""WITH p AS (SELECT l_partkey % 20 AS concentration, l_suppkey % 4 AS replicate, (l_orderkey % 1000)::DOUBLE AS time, l_extendedprice / 1000 AS signal, l_orderkey AS k, l_linenumber AS ln FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY concentration ORDER BY time, replicate, k, ln) AS n FROM p WHERE concentration > 0), s AS (SELECT concentration, count(*) AS n, sum(time) AS t, sum(signal) AS y, sum(time * time) AS tt, sum(time * signal) AS ty FROM f WHERE n <= 5 GROUP BY concentration)
SELECT concentration, {r('coalesce((n * ty - t * y) / nullif(n * tt - t * t, 0), 0.0)', 'rate', 4)} FROM s""")
def initial_rates(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("concentration"), F.struct(F.col("l_suppkey") % 4, "l_orderkey", "l_linenumber").alias("replicate"), (F.col("l_orderkey") % 1000).cast("double").alias("time"), (F.col("l_extendedprice") / 1000).alias("signal"))
    return rounded(assay.initial_rates(rows), digits=4)
