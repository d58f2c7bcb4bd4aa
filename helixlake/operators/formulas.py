"""Formulas of energetics, growth, expression and campaigns, as columns over rows that hold their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

#: The gas constant in kJ/mol/K, and what is known of a yeast cell.
GAS = 8.314e-3
AVOGADRO, CELL_GRAMS, RIBOSOME_CAPACITY, TRANSLATION, ATP_BUDGET = 6.022e23, 15e-12, 200_000, 10, 20


def delta_g(standard: Column, temperature: Column, products: Column, reactants: Column) -> Column:
    """Free energy from its standard value and two arrays of concentrations; no array counts as 1.

    A quotient of 0, and 0 by 0, count as 1e-10; products without any reactant have an infinite energy.
    """
    product = lambda a: F.aggregate(a, F.lit(1.0), lambda acc, x: acc * x)
    above, below = product(products), product(reactants)
    q = F.when(below != 0, above / below).when(above > 0, float("inf")).when(above == 0, 0.0)
    return standard + GAS * temperature * F.log(F.when(q == 0, 1e-10).otherwise(q))


def equilibrium_constant(standard: Column, temperature: Column) -> Column:
    return F.exp(-standard / (GAS * temperature))


def hill_feedback(x: Column, vmax: Column, kd: Column, n: Column) -> Column:
    """Expression under negative feedback; all of it without any inhibitor."""
    return F.when(x <= 0, vmax).otherwise(vmax * F.pow(kd, n) / (F.pow(kd, n) + F.pow(x, n)))


def monod(rows: DataFrame) -> DataFrame:
    """Adds mu, toxicity and burden to (s, o, fpp, product, expression, mu_max, ks, fpp_limit, product_limit, burden_limit)."""
    c = F.col
    inhibited = lambda x, limit: F.when(c(x) > c(limit), F.greatest(F.lit(0.0), 1 - (c(x) - c(limit)) / (c(limit) * 2))).otherwise(1.0)
    alive = inhibited("fpp", "fpp_limit") * inhibited("product", "product_limit")
    burden = F.least(F.lit(1.0), c("expression") / c("burden_limit"))
    air = F.when(c("o") > 0, c("o") / (0.2 + c("o"))).otherwise(0.0)
    mu = c("mu_max") * (c("s") / (c("ks") + c("s"))) * air * alive * F.greatest(F.lit(0.0), 1 - burden * 0.4)
    return rows.withColumns({"mu": mu, "toxicity": 1 - alive, "burden": burden})


def _warm_rate(substrate: Column) -> Column:
    c = F.col
    vmax = c("vmax") * F.exp(-F.pow(c("temperature") - 37, 2) / 200) * F.exp(-F.pow(c("ph") - 7.4, 2) / 1.2) * (c("enzyme") / 5)
    return vmax * substrate / (c("km") + substrate)


def readouts(rows: DataFrame) -> DataFrame:
    """Adds rate, ATP yield, NADPH rate, carbon efficiency, flux balance and stress to (substrate, vmax, km, enzyme, temperature, ph)."""
    c = F.col
    rate = _warm_rate(c("substrate"))
    share = c("rate") / (c("vmax") + 0.01)
    stress = F.greatest(F.lit(0.0), (c("temperature") - 42) / 8) + F.greatest(F.lit(0.0), F.abs(c("ph") - 7.4) - 0.5) / 2 + F.greatest(F.lit(0.0), (c("substrate") - 120) / 80)
    return rows.withColumn("rate", rate).withColumns({
        "atp_yield": (2 + c("substrate") / 100 * 34) * share, "nadph_rate": 0.6 * c("rate") * (c("enzyme") / 10), "carbon_efficiency": F.least(F.lit(100.0), 50 + 40 * share * F.exp(-F.pow(c("ph") - 7.2, 2) / 2)),
        "flux_balance": 1 - F.abs(c("rate") - _warm_rate(c("km"))) / (c("vmax") + 0.01), "stress": F.least(F.lit(1.0), stress),
    })


def energy_index(*shares: Column) -> Column:
    """Cube root of the product of three shares, each held within 0 and 1."""
    held = F.lit(1.0)
    for x in shares:
        held = held * m.clamp(x, 0.0, 1.0)
    return F.pow(held, F.lit(1 / 3))


def metabolic_drain(enzymes: DataFrame) -> DataFrame:
    """(id, level, atp_cost, nadph_cost, ribosome_burden, drain, growth_penalty, viable, advice) of (id, seq, kcat, flux); an empty sequence costs nothing."""
    c, length = F.col, F.length("seq")
    nadph = (length - F.length(F.translate("seq", "CM", ""))) * 4
    per_second = c("flux") * CELL_GRAMS / 1000 * AVOGADRO / 3600
    level = F.greatest(F.lit(1.0), F.ceil(per_second / F.greatest(c("kcat"), F.lit(0.01))).cast("double"))
    x = enzymes.select("id", length.alias("n"), level.alias("level"), nadph.alias("nadph_cost"))
    ribosomes = m.clamp(c("n") * c("level") / (TRANSLATION * 3600) / RIBOSOME_CAPACITY, 0.0, 1.0)
    atp = m.clamp(c("n") * 5 * c("level") / (AVOGADRO * CELL_GRAMS * 1000) / ATP_BUDGET, 0.0, 1.0)
    penalty = m.js_round(m.clamp(0.3 * ribosomes + 0.1 * atp, 0.0, 1.0) * 100, 3)
    drain = m.js_round(m.clamp(0.4 * ribosomes + 0.3 * atp + 0.3 * m.ratio(c("nadph_cost").cast("double"), c("n") * 4), 0.0, 1.0), 3)
    advice = F.when(penalty < 5, "low").when(penalty < 20, "moderate").when(penalty < 50, "high").otherwise("lethal")
    return x.select("id", "level", (c("n") * 5).alias("atp_cost"), "nadph_cost", m.js_round(ribosomes * 100, 3).alias("ribosome_burden"), drain.alias("drain"), penalty.alias("growth_penalty"), (penalty < 50).alias("viable"), advice.alias("advice"))


def exchange(scenarios: DataFrame, shared: DataFrame) -> DataFrame:
    """(scenario, metabolite, source, target, flux): what two strains exchange.

    ``scenarios`` has (scenario, strain, growth, carbon, atp, feasible), a row per strain; ``shared`` (metabolite, source, target, base), a few rows.
    """
    scale = lambda rate, per: F.when(F.col("feasible"), F.greatest("growth", F.col(rate) / per)).otherwise(0.0)
    give = scenarios.select("scenario", F.col("strain").alias("source"), m.clamp(scale("carbon", 100) * 1.6, 0.0, 2.4).alias("give"))
    take = scenarios.select("scenario", F.col("strain").alias("target"), m.clamp(scale("atp", 4) * 1.4, 0.0, 2.0).alias("take"))
    j = give.join(F.broadcast(shared), "source").join(take, ["scenario", "target"])  # a few metabolites
    return j.select("scenario", "metabolite", "source", "target", m.js_round(F.col("base") * F.col("give") * F.col("take"), 3).alias("flux"))


def feeding_bonus(fluxes: DataFrame) -> DataFrame:
    """(scenario, strain, bonus): what a strain gains by the fluxes it takes in."""
    return fluxes.groupBy("scenario", F.col("target").alias("strain")).agg(F.sum(F.col("flux") * 0.018).alias("bonus"))


def mutation_bonus(mutations: DataFrame) -> DataFrame:
    """Adds activity, stability, expression and specificity bonuses to (position, to, length)."""
    at, to = F.col("position") / F.greatest("length", F.lit(1)), F.col("to")
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    return mutations.withColumns({
        "activity": when((at > 0.15) & (at < 0.35), 2.4), "stability": when((at > 0.45) & (at < 0.7), 2.0) + when(to.isin("A", "S", "T", "N"), 1.2),
        "expression": when(at > 0.68, 1.6), "specificity": when(to.isin("Y", "W", "H", "R"), 1.8),
    })


def convergence_state(rounds: DataFrame) -> DataFrame:
    """(campaign, slope, share, state, score) of survivors (campaign, round, variant, family, composite): how the last round stands.

    The slope compares the leads of the last two rounds, the share is the largest family's among the last round's survivors.
    """
    last = rounds.groupBy("campaign").agg(F.max("round").alias("last"))
    top = rounds.groupBy("campaign", "round").agg(F.max("composite").alias("lead"))
    order = Window.partitionBy("campaign").orderBy(F.desc("round"))
    leads = top.withColumn("k", F.row_number().over(order)).where("k <= 2").groupBy("campaign").agg(F.max(F.when(F.col("k") == 1, F.col("lead"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("lead"))).alias("b"))
    sizes = rounds.join(last, "campaign").where("round = last").groupBy("campaign", "family").count()
    shares = sizes.groupBy("campaign").agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("families"))
    share, slope = F.col("most") / F.col("all"), m.js_round(F.col("a") - F.coalesce("b", "a"), 2)
    state = F.when((F.col("slope") < 1.1) & (F.col("share") >= 0.68), "plateau").when(F.col("share") >= 0.78, "premature-collapse").when((F.col("share") <= 0.45) & (F.col("families") >= 3), "broadening").otherwise("productive-convergence")
    x = shares.join(leads, "campaign").select("campaign", slope.alias("slope"), share.alias("share"), "families")
    return x.select("campaign", "slope", "share", state.alias("state"), m.js_round(m.clamp((1 - F.col("share")) * 50 + F.greatest("slope", F.lit(0.0)) * 6, 0.0, 100.0), 2).alias("score"))


def selection_reasons(variants: DataFrame, floor: float) -> DataFrame:
    """(campaign, variant, status, reason) of (campaign, variant, family, stability, composite, flags, selected, place), place counting the selected from 0.

    Selected: marginal, leads, diverse or survivor; rejected: unstable, burdened, duplicate or weaker.
    """
    best = variants.where("selected").groupBy("campaign", "family").agg(F.max("composite").alias("best"))
    families = variants.where("selected").groupBy("campaign").agg(F.count_distinct("family").alias("families"))
    j = variants.join(best, ["campaign", "family"], "left").join(families, "campaign", "left")
    weak = F.col("stability") < floor
    won = F.when(weak, "marginal").when(F.col("place") == 0, "leads").when((F.col("families") > 1) & (F.col("place") < F.col("families")), "diverse").otherwise("survivor")
    lost = F.when(weak, "unstable").when(F.array_contains("flags", "mutation burden"), "burdened").when(F.col("best") > F.col("composite"), "duplicate").otherwise("weaker")
    return j.select("campaign", "variant", F.when(F.col("selected"), "selected").otherwise("rejected").alias("status"), F.when(F.col("selected"), won).otherwise(lost).alias("reason"))


def lead_variant(variants: DataFrame) -> DataFrame:
    """Per campaign the selected or wild-type variant with the best composite, the later round first among equals, then the smaller id."""
    order = Window.partitionBy("campaign").orderBy(F.desc("composite"), F.desc("round"), "variant")
    return variants.where(F.col("status").isin("selected", "wild-type")).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def dedup_mutations(candidates: DataFrame) -> DataFrame:
    """One candidate per campaign, round and mutation: the last one's values at the place of the first (campaign, round, mutation, place, variant)."""
    g = candidates.groupBy("campaign", "round", "mutation")
    return g.agg(F.min("place").alias("place"), F.max_by("variant", "place").alias("variant"))


def substitution_odds(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(a, b, odds): a softmax over each residue's row of a substitution table (a, b, score)."""
    row = Window.partitionBy("a")
    e = F.exp((F.col("score") - F.max("score").over(row)) / temperature)
    return scores.withColumn("e", e).select("a", "b", (F.col("e") / F.sum("e").over(row)).alias("odds"))


def stability_change(pairs: DataFrame, scores: dict[tuple[str, str], int], key: str = "id") -> DataFrame:
    """(key, ddg) of (key, original, mutant): -0.3 times the substitution score at every place that differs, over the shorter length."""
    table = F.create_map(*[F.lit(x) for (a, b), s in sorted(scores.items()) for x in (a + b, float(s))])
    n = F.least(F.length("original"), F.length("mutant"))
    letters = lambda c: F.slice(F.split(c, ""), F.lit(1), n)
    total = F.aggregate(F.arrays_zip(letters(F.col("original")).alias("a"), letters(F.col("mutant")).alias("b")), F.lit(0.0), lambda acc, p: acc + F.when(p["a"] != p["b"], F.coalesce(F.try_element_at(table, F.concat(p["a"], p["b"])), F.lit(0.0)) * -0.3).otherwise(0.0))
    return pairs.select(key, m.js_round(F.when(n > 0, total).otherwise(0.0), 3).alias("ddg"))


def rank_designs(designs: DataFrame) -> DataFrame:
    """Adds ``rank`` within a target to (target, design, nll, cai, ddg): likely sequences with common codons and little change first."""
    order = Window.partitionBy("target").orderBy(F.col("nll") - F.col("cai") * 2 + F.abs("ddg") * 0.5, "design")
    return designs.withColumn("rank", F.row_number().over(order))


def expression_summary(course: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(run, gene, max_protein, time_to_half, final, yield_per_dna) of (run, gene, time, protein, dna): time to half is the first at half the maximum."""
    top = course.groupBy("run", "gene").agg(F.max("protein").alias("max_protein"), F.max_by("protein", "time").alias("final"), F.first("dna").alias("dna"))
    half = course.join(top.select("run", "gene", "max_protein"), ["run", "gene"]).where(F.col("protein") >= F.col("max_protein") * 0.5).groupBy("run", "gene").agg(F.min("time").alias("time_to_half"))
    return top.join(half, ["run", "gene"], "left").select("run", "gene", "max_protein", "time_to_half", "final", (F.col("max_protein") / F.greatest(F.lit(0.01), "dna")).alias("yield_per_dna"))


def depletion_time(energy: DataFrame, share: float = 0.1) -> DataFrame:
    """(run, depleted) of (run, time, atp): the first time that ATP is below a share of its start, else the last time."""
    start = energy.groupBy("run").agg(F.min_by("atp", "time").alias("start"), F.max("time").alias("end"))
    low = energy.join(start, "run").where(F.col("atp") < F.col("start") * share).groupBy("run").agg(F.min("time").alias("t"))
    return start.join(low, "run", "left").select("run", F.coalesce("t", "end").alias("depleted"))


def next_phase(iterations: DataFrame) -> DataFrame:
    """Iterations (project, place, ...) with their number and phase, which go round."""
    n = F.row_number().over(Window.partitionBy("project").orderBy("place"))
    phases = F.array(*map(F.lit, ["Design", "Build", "Test", "Learn"]))
    return iterations.withColumn("iteration", n).withColumn("phase", F.get(phases, (F.col("iteration") - 1) % 4))


def variance_explained(scores: DataFrame, weights: DataFrame, cells: DataFrame) -> DataFrame:
    """(factor, view, share): squares that a factor's scores times its weights explain, of the squares there are; missing cells count on neither side.

    ``scores`` is (gene, factor, score), ``weights`` (factor, view, weight), a few rows, ``cells`` (gene, view, value) with nulls where missing.
    """
    have = cells.where("value IS NOT NULL")
    total = have.groupBy("view").agg(F.sum(F.col("value") * F.col("value")).alias("total"))
    part = have.join(scores, "gene").join(F.broadcast(weights), ["factor", "view"]).groupBy("factor", "view").agg(F.sum(F.pow(F.col("score") * F.col("weight"), 2)).alias("part"))
    return part.join(total, "view").select("factor", "view", m.js_round(F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(0.0), 3).alias("share"))
