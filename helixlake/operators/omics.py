"""Multi-omics statistics over rows (gene, transcript, protein, metabolite, fold_change, p_value); nulls are 0, a null p is 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

LAYERS = {"transcriptomics": "transcript", "proteomics": "protein", "metabolomics": "metabolite"}
#: Weights of the four layer signals.
HEADS = {"Variance": 0.2, "Discordance": 0.25, "Significance": 0.25, "Bottleneck": 0.3}
TINY = 1e-10


def filled(rows: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in (*LAYERS.values(), "fold_change")}
    return rows.withColumns(zero | {"p_value": F.coalesce("p_value", F.lit(1.0))})


def long_layers(rows: DataFrame) -> DataFrame:
    """(gene, layer, value): three rows per gene."""
    pairs = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(c).alias("value")) for k, c in LAYERS.items()])
    return filled(rows).select("gene", F.explode(pairs).alias("x")).select("gene", "x.layer", "x.value")


def z_scores(rows: DataFrame) -> DataFrame:
    """(gene, layer, z) with the population deviation, 0 where it is below 1e-10; statistics are aggregated, not windowed."""
    x = long_layers(rows)
    s = x.groupBy("layer").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return x.join(F.broadcast(s), "layer").select("gene", "layer", F.when(F.col("sd") < TINY, 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def volcano(rows: DataFrame, p: float = 0.05, fold: float = 1.0) -> DataFrame:
    """(gene, x, y, direction): significant genes at x = fold change, y = -log10 p within 0..5."""
    f = filled(rows).where((F.col("p_value") < p) & (F.abs("fold_change") > fold))
    y = m.clamp(-F.log10(F.greatest("p_value", F.lit(1e-5))), 0.0, 5.0)
    return f.select("gene", F.col("fold_change").alias("x"), y.alias("y"), F.when(F.col("fold_change") > 0, "up").otherwise("down").alias("direction"))


def layer_signals(rows: DataFrame) -> DataFrame:
    """(head, layer, weight, strength, bottleneck): four signals for each of three layers, from one pass."""
    t, p, x = F.col("transcript"), F.col("protein"), F.col("metabolite")
    sig = F.col("p_value") < 0.05
    one = filled(rows).agg(
        F.coalesce(F.var_pop(t), F.lit(0.0)).alias("vt"), F.coalesce(F.var_pop(p), F.lit(0.0)).alias("vp"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("vx"),
        *(F.coalesce(F.sum(F.abs(a - b)), F.lit(0.0)).alias(n) for a, b, n in ((t, p, "tp"), (p, x, "px"), (t, x, "tx"))),
        *(F.coalesce(F.sum(F.when(sig, F.abs(a))), F.lit(0.0)).alias(n) for a, n in ((t, "st"), (p, "sp"), (x, "sx"))),
        F.coalesce(F.sum(F.greatest(t - p, F.lit(0.0))), F.lit(0.0)).alias("g1"), F.coalesce(F.sum(F.greatest(p - x, F.lit(0.0))), F.lit(0.0)).alias("g2"),
    )
    c = F.col
    var, disc, sigs, gap = (c("vt") + c("vp") + c("vx") + TINY, c("tp") + c("px") + c("tx") + TINY, c("st") + c("sp") + c("sx") + TINY, c("g1") + c("g2") + TINY)
    zero, names = F.lit(0.0), list(LAYERS)
    rows_of = [("Variance", names[i], v / var, v, zero) for i, v in enumerate((c("vt"), c("vp"), c("vx")))]
    rows_of += [("Discordance", names[i], v / disc / 2, v, zero) for i, v in enumerate((c("tp") + c("tx"), c("tp") + c("px"), c("px") + c("tx")))]
    rows_of += [("Significance", names[i], v / sigs, v, zero) for i, v in enumerate((c("st"), c("sp"), c("sx")))]
    rows_of += [("Bottleneck", names[0], F.lit(0.1), c("g1"), c("g1") / gap), ("Bottleneck", names[1], c("g1") / gap, c("g1"), c("g1") / gap), ("Bottleneck", names[2], c("g2") / gap, c("g2"), c("g2") / gap)]
    made = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(n).alias("layer"), w.alias("weight"), s.alias("strength"), b.alias("bottleneck")) for h, n, w, s, b in rows_of])
    return one.select(F.explode(made).alias("r")).select("r.*")


def dominant_layer(rows: DataFrame) -> DataFrame:
    """One row: the layer with the largest weighted vote (earlier layers win ties) and its share of all votes."""
    vote = F.element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("head"))
    v = layer_signals(rows).groupBy("layer").agg(F.sum(F.col("weight") * vote).alias("vote"))
    place = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(LAYERS) for x in (n, -k)]), F.col("layer"))
    return v.agg(F.max_by("layer", F.struct("vote", place)).alias("layer"), m.js_round(F.max("vote") / (F.sum("vote") + TINY), 3).alias("confidence"))


def layer_correlation(rows: DataFrame) -> DataFrame:
    """(a, b, r, p): correlation between layers, rounded to 3 digits, and its approximate two-tailed p."""
    pairs = [("transcriptomics", "proteomics"), ("proteomics", "metabolomics"), ("transcriptomics", "metabolomics")]
    f = filled(rows)
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(LAYERS[a]).alias("x"), F.col(LAYERS[b]).alias("y")) for a, b in pairs])
    x = f.select(F.explode(made).alias("q")).select("q.*")
    s = x.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cv"))
    den = F.sqrt(F.col("vx") * F.col("vy")) * F.col("n")
    r = F.when((F.col("n") < 3) | (den < TINY), 0.0).otherwise(F.try_divide(F.col("cv") * F.col("n"), den))
    t = r * F.sqrt((F.col("n") - 2) / (1 - r * r + TINY))
    p = F.when(F.col("n") < 3, 1.0).otherwise(F.greatest(F.lit(TINY), m.two_tailed_p(t)))
    return s.select("a", "b", m.js_round(r, 3).alias("r"), p.alias("p"))


def metabolic_efficiency(rows: DataFrame) -> DataFrame:
    """(gene, score, flux, balance, metabolite_yield): 0.4, 0.3 and 0.3 of use, concordance and yield, to 3 digits."""
    f = filled(rows)
    s = f.agg(F.min("transcript").alias("t0"), F.max("transcript").alias("t1"), F.min("metabolite").alias("m0"), F.max("metabolite").alias("m1"))
    span = lambda a, b: F.when(F.col(b) == F.col(a), 1.0).otherwise(F.col(b) - F.col(a))
    t, p, x = F.col("transcript"), F.col("protein"), F.col("metabolite")
    flux = m.clamp(x / (F.greatest(F.lit(0.01), (t + p) / 2) + 1), 0.0, 1.0)
    balance = F.greatest(F.lit(0.0), 1 - F.abs(t - p) / (span("t0", "t1") * 0.5))
    made = F.greatest(F.lit(0.0), (x - F.col("m0")) / span("m0", "m1"))
    score = m.clamp(flux * 0.4 + balance * 0.3 + made * 0.3, 0.0, 1.0)
    return f.crossJoin(F.broadcast(s)).select("gene", m.js_round(score, 3).alias("score"), m.js_round(flux, 3).alias("flux"), m.js_round(balance, 3).alias("balance"), m.js_round(made, 3).alias("metabolite_yield"))


def missing_rate(rows: DataFrame) -> DataFrame:
    """Share of null cells over the three layers."""
    gone = sum((F.count_if(F.col(c).isNull()) for c in LAYERS.values()), F.lit(0))
    return rows.agg(m.ratio(gone.cast("double"), F.count("*") * 3).alias("missing_rate"))


def unit_coordinates(rows: DataFrame) -> DataFrame:
    """(gene, x, y, z): the three layers scaled to -1..1, 0 where a layer is flat."""
    f = filled(rows)
    s = f.agg(*[F.min(c).alias(f"{c}0") for c in LAYERS.values()], *[F.max(c).alias(f"{c}1") for c in LAYERS.values()])
    return f.crossJoin(F.broadcast(s)).select("gene", *[m.min_max(F.col(c), F.col(f"{c}0"), F.col(f"{c}1")).alias(n) for c, n in zip(LAYERS.values(), "xyz")])


def efficiency_by_gene(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by gene, else a point's own ``efficiency``."""
    return points.join(scores.select("gene", "score"), "gene", "left").select("gene", F.coalesce("score", "efficiency").alias("value"))


def perturb(rows: DataFrame, changes: DataFrame, effects: DataFrame) -> DataFrame:
    """(gene, original, perturbed, delta, discordance, scaling, yield_change, confidence, shifts): what new expressions do.

    ``changes`` is (gene, perturbed), ``effects`` (gene, impact, metabolites) with the few genes whose flux is known.
    The protein follows at 0.5 where transcript and protein are over 1.5 apart, else at 0.85; a known gene moves the
    yield by 8 % a unit times its impact and each of its metabolites, others the yield by 3 % and the general pool.
    A metabolite's random share of 0.5 to 1 is its mean, 0.75. Genes that aren't in the rows have zeros and no confidence.
    """
    x = changes.join(filled(rows).select("gene", "transcript", "protein"), "gene", "left").join(effects, "gene", "left")
    found, delta = F.col("transcript").isNotNull(), F.col("perturbed") - F.col("transcript")
    apart = F.abs(F.col("transcript") - F.col("protein"))
    scaling = F.when(apart > 1.5, 0.5).otherwise(0.85)
    known = F.col("impact").isNotNull()
    change = F.when(known, delta * scaling * F.col("impact") * 8).otherwise(delta * scaling * 3)
    shift = m.js_round(F.when(known, delta * scaling * F.col("impact") * 0.75).otherwise(delta * scaling * 0.3), 2)
    names = F.coalesce("metabolites", F.array(F.lit("General metabolite pool")))
    shifts = F.transform(names, lambda n: F.struct(n.alias("metabolite"), shift.alias("delta"), F.when(F.when(known, shift).otherwise(delta) > 0, "up").otherwise("down").alias("direction")))
    return x.select(
        "gene", F.coalesce("transcript", F.lit(0.0)).alias("original"), "perturbed", F.when(found, delta).alias("delta"), F.when(found, apart).alias("discordance"), F.when(found, scaling).alias("scaling"),
        F.when(found, m.js_round(change, 1)).otherwise(0.0).alias("yield_change"), F.when(found, m.clamp(1 - F.abs(delta) * 0.1, 0.3, 0.95)).otherwise(0.0).alias("confidence"),
        F.when(found, shifts).otherwise(F.slice(shifts, 1, 0)).alias("shifts"),
    )


def latent_factors(rows: DataFrame, k: int = 2, rounds: int = 200) -> DataFrame:
    """(gene, factor, score): alternating least squares of the z-scored layers, weights renewed from aggregates of all genes.

    The k by 3 weights are the only state between rounds; every round is one aggregation over the genes.
    """
    import numpy as np

    z = z_scores(rows).groupBy("gene").pivot("layer", list(LAYERS)).agg(F.first("z"))
    x = [F.col(n) for n in LAYERS]
    second = np.array(z.agg(*[F.coalesce(F.sum(a * b), F.lit(0.0)) for a in x for b in x]).first(), float).reshape(3, 3)  # 9 sums suffice for the rounds
    w = np.eye(3)[:k]
    for _ in range(rounds):
        inner = np.linalg.pinv(w @ w.T)
        right = inner @ w @ second
        new = np.linalg.pinv(right @ w.T @ inner) @ right
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        done = np.abs(new - w).max() < 1e-10
        w = new
        if done:
            break
    proj = np.linalg.pinv(w @ w.T) @ w
    scores = F.array(*[sum((F.lit(float(proj[i, j])) * x[j] for j in range(3)), F.lit(0.0)) for i in range(k)])
    return z.select("gene", F.posexplode(scores).alias("factor", "score"))
