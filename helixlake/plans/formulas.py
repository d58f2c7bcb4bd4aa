"""Energetics, growth, expression and campaign queries."""

from pyspark.sql import functions as F

from helixlake.operators import formulas as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded, values
from helixlake.sources import constants as k
from helixlake.sources import views as v


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS dg0, 290 + l_linenumber * 5.0 AS t, CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE l_discount * (1 + l_tax) END AS p, CASE WHEN l_suppkey % 9 = 0 THEN 0.0 ELSE l_quantity / 50 END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, q = 0 AND p > 0 AS infinite, CASE WHEN NOT (q = 0 AND p > 0) THEN floor((dg0 + 8.314e-3 * t * ln(CASE WHEN p = 0 THEN 1e-10 ELSE p / q END)) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE END AS dg, {r('exp(-dg0 / (8.314e-3 * t))', 'keq', 4)} FROM x""")
def reaction_energies(spark, sf_dir):
    n = F.lit(0.0)
    x = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("dg0"), (290 + F.col("l_linenumber") * 5.0).alias("t"),
        F.array(F.when(F.col("l_partkey") % 5 == 0, n).otherwise(F.col("l_discount")), 1 + F.col("l_tax")).alias("p"), F.array(F.when(F.col("l_suppkey") % 9 == 0, n).otherwise(F.col("l_quantity") / 50)).alias("q"),
    )
    out = x.select("l_orderkey", "l_linenumber", op.delta_g(F.col("dg0"), F.col("t"), F.col("p"), F.col("q")).alias("dg"), op.equilibrium_constant(F.col("dg0"), F.col("t")).alias("keq"))
    endless = F.abs("dg") == float("inf")
    out = out.select("l_orderkey", "l_linenumber", endless.alias("infinite"), F.when(~endless, F.col("dg")).alias("dg"), "keq")
    return rounded(rounded(out, "dg"), "keq", digits=4)


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_discount * 10 AS o, l_tax * 100 AS fpp, l_extendedprice / 1000 AS product, l_quantity / 20 AS expression FROM lineitem),
y AS (SELECT *, CASE WHEN fpp > 4 THEN greatest(0.0, 1 - (fpp - 4) / 8) ELSE 1.0 END * CASE WHEN product > 30 THEN greatest(0.0, 1 - (product - 30) / 60) ELSE 1.0 END AS alive, least(1.0, expression / 2.0) AS burden, CASE WHEN o > 0 THEN o / (0.2 + o) ELSE 0.0 END AS air FROM x)
SELECT l_orderkey, l_linenumber, {r('0.4 * (s / (0.5 + s)) * air * alive * greatest(0.0, 1 - burden * 0.4)', 'mu')}, {r('1 - alive', 'toxicity')}, {r('burden')}, {r('CASE WHEN fpp <= 0 THEN 1.5 ELSE 1.5 * power(2.0, 2.0) / (power(2.0, 2.0) + power(fpp, 2.0)) END', 'feedback')} FROM y""")
def growth_rates(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"), (F.col("l_discount") * 10).alias("o"), (F.col("l_tax") * 100).alias("fpp"), (F.col("l_extendedprice") / 1000).alias("product"), (F.col("l_quantity") / 20).alias("expression"),
        F.lit(0.4).alias("mu_max"), F.lit(0.5).alias("ks"), F.lit(4.0).alias("fpp_limit"), F.lit(30.0).alias("product_limit"), F.lit(2.0).alias("burden_limit"),
    )
    return rounded(op.monod(x).withColumn("feedback", op.hill_feedback(F.col("fpp"), F.lit(1.5), F.lit(2.0), F.lit(2.0))).select("l_orderkey", "l_linenumber", "mu", "toxicity", "burden", "feedback"))


_WARM = "vmax * exp(-power(temperature - 37, 2) / 200) * exp(-power(ph - 7.4, 2) / 1.2) * (enzyme / 5) * {s} / (km + {s})"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 4 AS substrate, 10.0 + l_linenumber AS vmax, 12.0 AS km, 1 + l_discount * 50 AS enzyme, 30.0 + l_quantity / 3 AS temperature, 6.4 + l_tax * 25 AS ph FROM lineitem), y AS (SELECT *, {_WARM.format(s='substrate')} AS rate, {_WARM.format(s='km')} AS best FROM x)
SELECT l_orderkey, l_linenumber, {r('rate')}, {r('(2 + substrate / 100 * 34) * (rate / (vmax + 0.01))', 'atp_yield')}, {r('0.6 * rate * (enzyme / 10)', 'nadph_rate')}, {r('least(100.0, 50 + 40 * (rate / (vmax + 0.01)) * exp(-power(ph - 7.2, 2) / 2))', 'carbon_efficiency')}, {r('1 - abs(rate - best) / (vmax + 0.01)', 'flux_balance')},
 {r('least(1.0, greatest(0.0, (temperature - 42) / 8) + greatest(0.0, abs(ph - 7.4) - 0.5) / 2 + greatest(0.0, (substrate - 120) / 80))', 'stress')} FROM y""")
def simulation_readouts(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("substrate"), (10.0 + F.col("l_linenumber")).alias("vmax"), F.lit(12.0).alias("km"), (1 + F.col("l_discount") * 50).alias("enzyme"),
        (30.0 + F.col("l_quantity") / 3).alias("temperature"), (6.4 + F.col("l_tax") * 25).alias("ph"),
    )
    return rounded(op.readouts(x).select("l_orderkey", "l_linenumber", "rate", "atp_yield", "nadph_rate", "carbon_efficiency", "flux_balance", "stress"))


@query(f"SELECT l_orderkey, l_linenumber, {r('power(least(greatest(l_quantity / 40, 0.0), 1.0) * least(greatest(l_discount * 20 - 0.2, 0.0), 1.0) * least(greatest(l_tax * 20, 0.0), 1.0), 1 / 3.0::DOUBLE)', 'energy')} FROM lineitem")
def energy_index(spark, sf_dir):
    e = op.energy_index(F.col("l_quantity") / 40, F.col("l_discount") * 20 - 0.2, F.col("l_tax") * 20)
    return rounded(v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e.alias("energy")))


_UPPER = "regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


@query(f"""WITH e AS (SELECT doc_id AS id, {_UPPER} AS seq, 0.1 + doc_id % 50 AS kcat, doc_id % 997 * 0.01 AS flux FROM documents WHERE text IS NOT NULL), x AS (SELECT id, length(seq)::DOUBLE AS n, greatest(1.0, ceil(flux * 15e-12 / 1000 * 6.022e23 / 3600 / greatest(kcat, 0.01))) AS level, (length(seq) - length(translate(seq, 'CM', ''))) * 4 AS nadph_cost FROM e),
y AS (SELECT *, least(greatest(n * level / 36000 / 200000, 0.0), 1.0) AS ribosomes, least(greatest(n * 5 * level / (6.022e23::DOUBLE * 15e-12 * 1000) / 20, 0.0), 1.0) AS atp FROM x),
z AS (SELECT *, floor(least(greatest(0.3 * ribosomes + 0.1 * atp, 0.0), 1.0) * 100 * 1000 + 0.5) / 1000 AS penalty FROM y)
SELECT id, level, (n * 5)::BIGINT AS atp_cost, nadph_cost, {r('ribosomes * 100', 'ribosome_burden', 3)}, {r('least(greatest(0.4 * ribosomes + 0.3 * atp + 0.3 * CASE WHEN n > 0 THEN nadph_cost / (n * 4) ELSE 0.0 END, 0.0), 1.0)', 'drain', 3)}, penalty AS growth_penalty, penalty < 50 AS viable, CASE WHEN penalty < 5 THEN 'low' WHEN penalty < 20 THEN 'moderate' WHEN penalty < 50 THEN 'high' ELSE 'lethal' END AS advice FROM z""")
def metabolic_drain(spark, sf_dir):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.regexp_replace(up, "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("seq"), (0.1 + F.col("doc_id") % 50).alias("kcat"), (F.col("doc_id") % 997 * 0.01).alias("flux"))
    return op.metabolic_drain(d).withColumns({"atp_cost": F.col("atp_cost").cast("long"), "nadph_cost": F.col("nadph_cost").cast("long")})


_STRAINS = "strains AS (SELECT s_suppkey AS scenario, t.strain, CASE t.strain WHEN 'ecoli' THEN abs(s_acctbal) / 12000 ELSE (s_suppkey % 7) / 10.0 END AS growth, (s_suppkey * 13 % 100)::DOUBLE AS carbon, (s_suppkey * 17 % 9)::DOUBLE AS atp, (s_suppkey + CASE t.strain WHEN 'ecoli' THEN 0 ELSE 1 END) % 6 <> 0 AS feasible FROM supplier, (VALUES ('ecoli'), ('yeast')) t(strain))"
_EXCHANGE = f"""{_STRAINS}, {values('shared', 'metabolite, source, target, base', k.SHARED_METABOLITES)}, ex AS (SELECT a.scenario, metabolite, source, target, floor(base::DOUBLE * least(greatest(CASE WHEN a.feasible THEN greatest(a.growth, a.carbon / 100) ELSE 0.0 END * 1.6::DOUBLE, 0.0), 2.4::DOUBLE) * least(greatest(CASE WHEN b.feasible THEN greatest(b.growth, b.atp / 4) ELSE 0.0 END * 1.4::DOUBLE, 0.0), 2.0) * 1000 + 0.5) / 1000 AS flux
 FROM shared JOIN strains a ON a.strain = source JOIN strains b ON b.strain = target AND b.scenario = a.scenario)"""


def _exchange(spark, sf_dir):
    n = F.col("s_suppkey")
    s = v.table(spark, sf_dir, "supplier").select(n.alias("scenario"), F.explode(F.array(F.lit("ecoli"), F.lit("yeast"))).alias("strain"), "s_acctbal", "s_suppkey")
    own = F.col("strain") == "ecoli"
    rows = s.select("scenario", "strain", F.when(own, F.abs("s_acctbal") / 12000).otherwise(n % 7 / 10.0).alias("growth"), (n * 13 % 100).cast("double").alias("carbon"), (n * 17 % 9).cast("double").alias("atp"), ((n + F.when(own, 0).otherwise(1)) % 6 != 0).alias("feasible"))
    return op.exchange(rows, spark.createDataFrame(k.SHARED_METABOLITES, "metabolite string, source string, target string, base double").coalesce(1))


@query(f"WITH {_EXCHANGE} SELECT * FROM ex")
def metabolite_exchange(spark, sf_dir):
    return _exchange(spark, sf_dir)


@query(f"WITH {_EXCHANGE} SELECT scenario, target AS strain, {r('sum(flux * 0.018::DOUBLE)', 'bonus')} FROM ex GROUP BY ALL")
def feeding_bonus(spark, sf_dir):
    return rounded(op.feeding_bonus(_exchange(spark, sf_dir)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 120 AS position, 'ACDEFGHIKLMNPQRSTVWY'[(l_suppkey % 20 + 1)::INTEGER] AS residue, 100 AS length FROM lineitem), y AS (SELECT *, position / greatest(length, 1) AS f FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN f > 0.15 AND f < 0.35 THEN 2.4 ELSE 0.0 END::DOUBLE AS activity, (CASE WHEN f > 0.45 AND f < 0.7 THEN 2.0 ELSE 0.0 END + CASE WHEN residue IN ('A', 'S', 'T', 'N') THEN 1.2 ELSE 0.0 END)::DOUBLE AS stability, CASE WHEN f > 0.68 THEN 1.6 ELSE 0.0 END::DOUBLE AS expression, CASE WHEN residue IN ('Y', 'W', 'H', 'R') THEN 1.8 ELSE 0.0 END::DOUBLE AS specificity FROM y""")
def mutation_bonuses(spark, sf_dir):
    letter = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.col("l_suppkey") % 20 + 1).cast("int"), F.lit(1))
    x = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 120).alias("position"), letter.alias("to"), F.lit(100).alias("length"))
    return rounded(op.mutation_bonus(x).select("l_orderkey", "l_linenumber", "activity", "stability", "expression", "specificity"))


_SURVIVORS = "s AS (SELECT l_suppkey AS campaign, l_linenumber AS round, l_orderkey * 1000000 + l_partkey AS variant, CASE WHEN l_suppkey % 4 = 0 THEN 'one' WHEN l_suppkey % 4 = 1 AND l_orderkey % 7 <> 0 THEN 'one' ELSE 'f' || (l_partkey % 4) END AS family, CASE WHEN l_suppkey % 3 = 0 THEN 50.0 + l_linenumber * 0.5 ELSE l_extendedprice / 1000 END AS composite FROM lineitem)"


def _survivors(spark, sf_dir):
    s = F.col("l_suppkey")
    family = F.when((s % 4 == 0) | ((s % 4 == 1) & (F.col("l_orderkey") % 7 != 0)), "one").otherwise(F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")))
    return v.table(spark, sf_dir, "lineitem").select(s.alias("campaign"), F.col("l_linenumber").alias("round"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("variant"), family.alias("family"), F.when(s % 3 == 0, 50.0 + F.col("l_linenumber") * 0.5).otherwise(F.col("l_extendedprice") / 1000).alias("composite"))


@query(f"""WITH {_SURVIVORS}, l AS (SELECT campaign, round, max(composite) AS lead, row_number() OVER (PARTITION BY campaign ORDER BY round DESC) AS k FROM s GROUP BY campaign, round), a AS (SELECT campaign, max(lead) FILTER (k = 1) AS a, max(lead) FILTER (k = 2) AS b, max(round) AS last FROM l GROUP BY campaign),
f AS (SELECT campaign, family, count(*) AS n FROM s JOIN a USING (campaign) WHERE round = last GROUP BY ALL), g AS (SELECT campaign, max(n) / sum(n) AS share, count(*) AS families FROM f GROUP BY campaign), x AS (SELECT campaign, floor((a - coalesce(b, a)) * 100 + 0.5) / 100 AS slope, share, families FROM g JOIN a USING (campaign))
SELECT campaign, slope, {r('share')}, CASE WHEN slope < 1.1 AND share >= 0.68 THEN 'plateau' WHEN share >= 0.78 THEN 'premature-collapse' WHEN share <= 0.45 AND families >= 3 THEN 'broadening' ELSE 'productive-convergence' END AS state, floor(least(greatest((1 - share) * 50 + greatest(slope, 0.0) * 6, 0.0), 100.0) * 100 + 0.5) / 100 AS score FROM x""")
def campaign_convergence(spark, sf_dir):
    return rounded(op.convergence_state(_survivors(spark, sf_dir)), "share")


@query(f"""WITH {_SURVIVORS}, t AS (SELECT *, variant % 100 AS stability, variant % 11 = 0 AS burdened, row_number() OVER (PARTITION BY campaign ORDER BY composite DESC, variant, round) - 1 AS place FROM s), c AS (SELECT campaign, family, max(composite) AS best FROM t WHERE place < 6 GROUP BY ALL), d AS (SELECT campaign, count(DISTINCT family) AS families FROM t WHERE place < 6 GROUP BY campaign)
SELECT campaign, variant, round, CASE WHEN place < 6 THEN 'selected' ELSE 'rejected' END AS status, CASE WHEN place < 6 THEN CASE WHEN stability < 20 THEN 'marginal' WHEN place = 0 THEN 'leads' WHEN families > 1 AND place < families THEN 'diverse' ELSE 'survivor' END
 ELSE CASE WHEN stability < 20 THEN 'unstable' WHEN burdened THEN 'burdened' WHEN best > composite THEN 'duplicate' ELSE 'weaker' END END AS reason FROM t LEFT JOIN c USING (campaign, family) LEFT JOIN d USING (campaign)""")
def selection_reasons(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc("composite"), "variant", "round")) - 1
    s = _survivors(spark, sf_dir).withColumn("place", place).withColumns({"selected": F.col("place") < 6, "stability": F.col("variant") % 100, "flags": F.when(F.col("variant") % 11 == 0, F.array(F.lit("mutation burden"))).otherwise(F.array().cast("array<string>"))})
    keyed = s.withColumn("variant", F.struct("variant", "round"))
    return op.selection_reasons(keyed, 20.0).select("campaign", "variant.variant", "variant.round", "status", "reason")


@query(f"WITH {_SURVIVORS} SELECT campaign, variant, round, {r('composite')} FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY composite DESC, round DESC, variant) AS n FROM s WHERE variant % 3 <> 0) WHERE n = 1")
def lead_variants(spark, sf_dir):
    s = _survivors(spark, sf_dir).withColumn("status", F.when(F.col("variant") % 3 == 0, "rejected").when(F.col("variant") % 3 == 1, "selected").otherwise("wild-type"))
    return rounded(op.lead_variant(s).select("campaign", "variant", "round", "composite"))


@query("SELECT l_suppkey AS campaign, l_linenumber AS round, 'm' || (l_partkey % 20) AS mutation, min(l_orderkey) AS place, arg_max(l_partkey, (l_orderkey, l_partkey)) AS variant FROM lineitem GROUP BY ALL")
def distinct_mutations(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("campaign"), F.col("l_linenumber").alias("round"), F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string")).alias("mutation"), F.struct(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).alias("place"), F.col("l_partkey").alias("variant"))
    return op.dedup_mutations(x).withColumn("place", F.col("place.o"))


RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_GROUPS = ["AVLIMC", "FWYH", "STNQ", "DE", "KR", "GP"]


def _substitutions() -> dict[tuple[str, str], int]:
    """A substitution table by rule: 5 for the same residue, 1 within a group, else -2; a measured one is a parameter like it."""
    of = {a: i for i, g in enumerate(_GROUPS) for a in g}
    return {(a, b): 5 if a == b else 1 if of[a] == of[b] else -2 for a in RESIDUES for b in RESIDUES}


_SCORE = "CASE WHEN a = b THEN 5 WHEN " + " OR ".join(f"(contains('{g}', a) AND contains('{g}', b))" for g in _GROUPS) + " THEN 1 ELSE -2 END"


@query(f"WITH t AS (SELECT a, b, {_SCORE} AS score FROM (SELECT unnest(string_split('{RESIDUES}', '')) AS a) x, (SELECT unnest(string_split('{RESIDUES}', '')) AS b) y) SELECT a, b, {r('exp(score) / sum(exp(score)) OVER (PARTITION BY a)', 'odds')} FROM t")
def substitution_odds(spark, sf_dir):
    return rounded(op.substitution_odds(spark.createDataFrame([(a, b, float(s)) for (a, b), s in _substitutions().items()], "a string, b string, score double")))


@query(f"""WITH p AS (SELECT doc_id AS id, {_UPPER} AS original FROM documents WHERE text IS NOT NULL), q AS (SELECT id, original, translate(original, 'AVK', 'VSR') AS mutant FROM p), e AS (SELECT id, unnest(string_split(original, '')) AS a, unnest(string_split(mutant, '')) AS b FROM q WHERE original <> ''), d AS (SELECT id, sum(CASE WHEN a <> b THEN ({_SCORE}) * -0.3::DOUBLE ELSE 0.0 END) AS ddg FROM e GROUP BY id)
SELECT p.id, {r('coalesce(ddg, 0.0)', 'ddg', 1)} FROM p LEFT JOIN d ON d.id = p.id""")
def stability_changes(spark, sf_dir):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.regexp_replace(up, "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("original"))
    return rounded(op.stability_change(d.withColumn("mutant", F.translate("original", "AVK", "VSR")), _substitutions()), digits=1)


@query("SELECT l_orderkey AS target, l_linenumber AS design, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / 1000 - l_discount * 2 + abs(l_tax * 10 - 0.4) * 0.5, l_linenumber) AS rank FROM lineitem")
def design_ranks(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("design"), (F.col("l_extendedprice") / 1000).alias("nll"), F.col("l_discount").alias("cai"), (F.col("l_tax") * 10 - 0.4).alias("ddg"))
    return op.rank_designs(x).select("target", "design", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH c AS (SELECT user_id AS run, event_type AS gene, event_id AS time, value AS protein, 1 + user_id % 3 AS dna FROM events), t AS (SELECT run, gene, max(protein) AS top, arg_max(protein, time) AS final, any_value(dna) AS dna FROM c GROUP BY ALL)
SELECT t.run, t.gene, {r('top', 'max_protein')}, min(time) AS time_to_half, {r('final')}, {r('top / greatest(0.01, t.dna)', 'yield_per_dna')} FROM t LEFT JOIN c ON c.run = t.run AND c.gene = t.gene AND c.protein >= t.top * 0.5 GROUP BY t.run, t.gene, top, final, t.dna""")
def expression_summary(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("gene"), F.col("event_id").alias("time"), F.col("value").alias("protein"), (1 + F.col("user_id") % 3).cast("double").alias("dna"))
    return rounded(op.expression_summary(e))


@query("WITH e AS (SELECT user_id AS run, event_id AS time, value AS atp FROM events), s AS (SELECT run, arg_min(atp, time) AS start, max(time) AS last FROM e GROUP BY run) SELECT run, coalesce((SELECT min(time) FROM e WHERE e.run = s.run AND atp < start * 0.1), last) AS depleted FROM s")
def depletion_times(spark, sf_dir):
    return op.depletion_time(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("time"), F.col("value").alias("atp")))


@query("SELECT project, place, n AS iteration, ['Design', 'Build', 'Test', 'Learn'][(n - 1) % 4 + 1] AS phase FROM (SELECT o_custkey AS project, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def iteration_phases(spark, sf_dir):
    return op.next_phase(v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("place"))).withColumn("iteration", F.col("iteration").cast("long"))


_FACTOR_WEIGHTS = [(i, view, w) for i, row in enumerate([(0.5, 0.3, 0.2), (-0.1, 0.6, 0.4)]) for view, w in zip(("transcript", "protein", "metabolite"), row)]


@query(f"""WITH {v.OMICS}, {values('w', 'factor, layer, weight', _FACTOR_WEIGHTS)}, c AS (SELECT gene, 'transcript' AS layer, transcript AS value FROM omics UNION ALL SELECT gene, 'protein', CASE WHEN gene % 4 <> 0 THEN protein END FROM omics UNION ALL SELECT gene, 'metabolite', metabolite FROM omics),
z AS (SELECT gene, 0 AS factor, transcript + protein AS score FROM omics UNION ALL SELECT gene, 1, protein - metabolite FROM omics), t AS (SELECT layer, sum(value * value) AS total FROM c WHERE value IS NOT NULL GROUP BY layer)
SELECT z.factor, c.layer AS view_name, {r('sum(power(score * weight, 2)) / any_value(total)', 'share', 3)} FROM c JOIN z USING (gene) JOIN w ON w.factor = z.factor AND w.layer = c.layer JOIN t ON t.layer = c.layer WHERE value IS NOT NULL GROUP BY ALL""")
def variance_explained(spark, sf_dir):
    o = v.omics(spark, sf_dir)
    cells = o.select("gene", F.explode(F.array(*[F.struct(F.lit(c).alias("view"), (F.when(F.col("gene") % 4 != 0, F.col(c)) if c == "protein" else F.col(c)).alias("value")) for c in ("transcript", "protein", "metabolite")])).alias("s")).select("gene", "s.view", "s.value")
    scores = o.select("gene", F.explode(F.array(F.struct(F.lit(0).alias("factor"), (F.col("transcript") + F.col("protein")).alias("score")), F.struct(F.lit(1).alias("factor"), (F.col("protein") - F.col("metabolite")).alias("score")))).alias("s")).select("gene", "s.factor", "s.score")
    weights = spark.createDataFrame(_FACTOR_WEIGHTS, "factor int, view string, weight double").coalesce(1)
    return op.variance_explained(scores, weights, cells).withColumnRenamed("view", "view_name")
