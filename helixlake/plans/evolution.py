"""Selection-campaign queries."""

from helixlake.functions.mathx import T_95
from helixlake.operators import evolution as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded
from helixlake.sources import views as v

WILD = "view"
_T = "[" + ", ".join(map(str, T_95)) + "]"
_FREQ = f"""WITH {v.READS},
grid AS (SELECT f.variant, f.family, t.round, t.replicate, t.total, s.n_variants FROM (SELECT DISTINCT variant, family FROM reads) f
  CROSS JOIN (SELECT round, replicate, sum(reads) AS total FROM reads GROUP BY ALL) t JOIN (SELECT round, count(DISTINCT variant) AS n_variants FROM reads GROUP BY ALL) s ON s.round = t.round),
freqs AS (SELECT g.variant, g.family, g.round, g.replicate, coalesce(x.reads, 0) AS reads, (coalesce(x.reads, 0) + 1.0) / (g.total + 1.0 * g.n_variants)::DOUBLE AS freq
  FROM grid g LEFT JOIN reads x ON x.variant = g.variant AND x.round = g.round AND x.replicate = g.replicate)"""


def _interval(source: str, by: str, value: str, prefix: str) -> str:
    t = f"CASE WHEN n - 1 <= 9 THEN {_T}[CAST(n - 1 AS INTEGER)] ELSE 1.96 END"
    return f"""SELECT {by}, a AS {prefix}_mean, CASE WHEN n < 2 THEN a ELSE greatest(0.0, a - {t} * sem) END AS {prefix}_lower,
      CASE WHEN n < 2 THEN a ELSE a + {t} * sem END AS {prefix}_upper, sem AS {prefix}_sem, n AS replicates
      FROM (SELECT {by}, avg({value}) AS a, count({value}) AS n, CASE WHEN count({value}) < 2 THEN 0.0 ELSE coalesce(stddev_samp({value}), 0.0) / sqrt(count({value})) END AS sem FROM {source} GROUP BY {by})"""


_VARIANT = f"{_FREQ}, ci AS ({_interval('freqs', 'variant, round', 'freq', 'freq')}), vf AS (SELECT ci.*, q.reads FROM ci JOIN (SELECT variant, round, sum(reads)::BIGINT AS reads FROM freqs GROUP BY ALL) q USING (variant, round))"
_DIVERSITY = f"""{_FREQ}, ps AS (SELECT *, freq / sum(freq) OVER (PARTITION BY round, replicate) AS p FROM freqs),
per AS (SELECT round, replicate, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0.0 END) AS h, max(p) AS top FROM ps GROUP BY ALL),
hs AS ({_interval('per', 'round', 'h', 'shannon')}), ts AS ({_interval('per', 'round', 'top', 'top')}),
obs AS (SELECT round, count(DISTINCT variant) AS observed FROM reads WHERE reads > 0 GROUP BY ALL)"""


@query(f"{_VARIANT} SELECT variant, round, {r('freq_mean')}, {r('freq_lower')}, {r('freq_upper')}, {r('freq_sem')}, replicates, reads FROM vf")
def variant_frequency(spark, sf_dir):
    return rounded(op.variant_frequency(v.reads(spark, sf_dir)))


@query(f"""{_DIVERSITY} SELECT round, {', '.join(r(f'{a}_{b}') for a in ('shannon', 'top') for b in ('mean', 'lower', 'upper', 'sem'))}, hs.replicates, {r('power(2.0, shannon_mean)', 'effective')}, coalesce(observed, 0) AS observed
FROM hs JOIN ts USING (round) LEFT JOIN obs USING (round)""")
def diversity_curve(spark, sf_dir):
    return rounded(op.diversity_curve(v.reads(spark, sf_dir)))


@query(f"{_FREQ} SELECT family, round, {r('mean / sum(mean) OVER (PARTITION BY round)', 'share')} FROM (SELECT family, round, avg(s) AS mean FROM (SELECT family, round, replicate, sum(freq) AS s FROM freqs GROUP BY ALL) GROUP BY ALL)")
def family_share(spark, sf_dir):
    return rounded(op.family_share(v.reads(spark, sf_dir)))


@query(f"""{_VARIANT}, steps AS (SELECT *, lag(freq_mean) OVER w AS before, first_value(freq_mean) OVER w AS first, row_number() OVER (PARTITION BY variant ORDER BY round DESC) AS back FROM vf WINDOW w AS (PARTITION BY variant ORDER BY round)),
sel AS (SELECT variant, coalesce(avg(CASE WHEN before > 0 AND freq_mean > 0 THEN ln(freq_mean / before) END), 0.0) AS selection FROM steps GROUP BY variant),
wild AS (SELECT max(freq_mean) AS wild FROM steps WHERE back = 1 AND variant = '{WILD}')
SELECT variant, {r("CASE WHEN wild > 0 THEN CASE WHEN freq_mean / wild > 0 THEN log2(freq_mean / wild) ELSE -10.0 END WHEN freq_mean > 0 THEN log2(freq_mean) ELSE -10.0 END", 'log2_vs_wild')},
  {r("CASE WHEN freq_mean > 0 THEN log2(freq_mean / greatest(first, 1e-9)) ELSE -10.0 END", 'log2_across')}, {r('selection')}, {r('freq_mean', 'final')}, {r('freq_lower', 'final_lower')}, {r('freq_upper', 'final_upper')}, reads AS final_reads
FROM steps JOIN sel USING (variant) CROSS JOIN wild WHERE back = 1 AND variant <> '{WILD}'""")
def enrichment_table(spark, sf_dir):
    return rounded(op.enrichment(v.reads(spark, sf_dir), WILD))


@query(f"{_VARIANT} SELECT variant, {r('peak')} FROM (SELECT variant, max(freq_mean) AS peak FROM vf WHERE variant <> '{WILD}' GROUP BY variant) ORDER BY peak DESC, variant LIMIT 6")
def top_variants(spark, sf_dir):
    return rounded(op.top_variants(v.reads(spark, sf_dir), WILD))


@query(f"""{_DIVERSITY}, d AS (SELECT round, shannon_mean, top_mean, lag(shannon_mean) OVER (ORDER BY round) AS before FROM hs JOIN ts USING (round))
SELECT round, {r('shannon_mean')}, {r('top_mean')}, {r('coalesce(shannon_mean - before, 0.0)', 'shannon_delta')} FROM d ORDER BY round DESC LIMIT 1""")
def campaign_summary(spark, sf_dir):
    return rounded(op.campaign_summary(v.reads(spark, sf_dir)))


@query(f"""WITH {v.VARIANTS}, g AS (SELECT family, count(*) AS n FROM variants WHERE activity >= 60 GROUP BY family),
t AS (SELECT count(*) AS families, sum(n)::DOUBLE AS n, max(n) AS top, sum(n * log2(n)) AS s FROM g), e AS (SELECT *, CASE WHEN families > 1 THEN (log2(n) - s / n) / log2(families) ELSE 0.0 END AS evenness FROM t)
SELECT families, {r('top / n', 'dominant_share')}, {r('evenness')}, CASE WHEN evenness >= 0.75 THEN 'broad' WHEN evenness >= 0.4 THEN 'focused' ELSE 'collapsed' END AS kind FROM e""")
def survivor_diversity(spark, sf_dir):
    return rounded(op.survivor_diversity(v.variants(spark, sf_dir).where("activity >= 60")))


@query(f"""WITH {v.VARIANTS}, s AS (SELECT * FROM variants WHERE activity >= 60)
SELECT variant, family, {r('count(*) OVER (PARTITION BY family) / (count(*) OVER ())::DOUBLE', 'density')} FROM s""")
def selection_density(spark, sf_dir):
    return rounded(op.selection_density(v.variants(spark, sf_dir).where("activity >= 60")))


@query("""WITH m AS (SELECT p_partkey AS variant, string_split(p_name, ' ') AS mutations FROM part)
SELECT mutation, count(*) AS count FROM (SELECT variant, unnest(list_distinct(mutations)) AS mutation FROM m) GROUP BY mutation HAVING count(*) >= 50""")
def mutation_persistence(spark, sf_dir):
    from pyspark.sql import functions as F

    parts = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), F.split("p_name", " ").alias("mutations"))
    return op.mutation_persistence(parts, 50)
