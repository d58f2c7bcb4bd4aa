"""Proteins: conservation profiles over families of sequences, sites for mutagenesis, contacts in space, binding affinity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

#: Residues, charges of those that have one, kT at 298.15 K in kcal/mol, and the constants of the energy terms.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
CHARGES = {"D": -1.0, "E": -1.0, "H": 0.1, "K": 1.0, "R": 1.0}
KT = 1.987e-3 * 298.15
WIDTH, WELL, SEPARATION, COULOMB, SUBSTRATE_CHARGE, INNER, OUTER, SURFACE, ENTROPY = 0.5, 0.15, 3.5, 332.0, -0.3, 4.0, 80.0, 0.0072, 1.5
#: A site's neighbours on either side whose conservation its own is averaged with.
BESIDE = 1


def positions(sequences: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, position, residue) of sequences (keep, sequence): a row a residue, letters that are none left out but counted."""
    each = sequences.select(*keep, F.posexplode(F.split("sequence", "")).alias("position", "residue"))
    return each.where(F.length("residue") == 1).where(F.instr(F.lit(RESIDUES), F.col("residue")) > 0)


def profile(placed: DataFrame) -> DataFrame:
    """(family, position, n, conservation) of placed residues (family, position, residue): 1 less the entropy's share of that of twenty residues alike."""
    counts = placed.groupBy("family", "position", "residue").agg(F.count("*").alias("k"))
    g = counts.groupBy("family", "position").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    entropy = F.log2("n") - F.col("s") / F.col("n")
    return g.select("family", "position", "n", m.clamp(1 - entropy / math.log2(20), 0.0, 1.0).alias("conservation"))


def smoothed(profile_: DataFrame, beside: int = BESIDE) -> DataFrame:
    """The profile with ``around``, the mean conservation of a position and those up to ``beside`` places away."""
    w = Window.partitionBy("family").orderBy("position").rangeBetween(-beside, beside)
    return profile_.withColumn("around", F.avg("conservation").over(w))


def site_scores(sequences: DataFrame, conserved: DataFrame) -> DataFrame:
    """(id, position, residue, conservation, structural, surface, composite) of sequences (family, id, sequence, catalytic).

    ``catalytic`` is the list of places of catalytic residues, which are no sites themselves. ``conserved`` is (family, position,
    conservation). A good site is of middling conservation, far along the chain from catalytic ones, and on the surface: near an
    end, or at one of the two of four places that a helix turns outwards.
    """
    n = F.length("sequence")
    own = sequences.select("family", "id", "catalytic", n.alias("n"), "sequence")
    p = positions(own, ["family", "id", "catalytic", "n"]).where(~F.coalesce(F.array_contains("catalytic", F.col("position")), F.lit(False)))
    near = F.coalesce(F.array_min(F.transform("catalytic", lambda c: F.abs(F.col("position") - c))), F.col("n"))
    structural = m.clamp(1 / (1 + F.least(near, F.col("n")) / 5), 0.0, 1.0)
    share = F.col("position") / F.col("n")
    surface = F.when((share < 0.15) | (share > 0.85), 0.7).otherwise(0.3) + F.when(F.col("position") % 4 < 2, 0.3).otherwise(0.0)
    j = p.join(conserved.select("family", "position", "conservation"), ["family", "position"])
    composite = (1 - F.abs(F.col("conservation") - 0.5) * 2) * (1 - structural) * surface
    return j.select("id", "position", "residue", *[m.js_round(c, 3).alias(name) for c, name in ((F.col("conservation"), "conservation"), (structural, "structural"), (m.clamp(surface, 0.0, 1.0), "surface"), (composite, "composite"))])


def top_sites(sequences: DataFrame, conserved: DataFrame, k: int = 8, most: int = 4_000_000) -> DataFrame:
    """:func:`site_scores` of the ``k`` best sites of each row of ``sequences`` alone, where residues don't leave their row.

    ``conserved`` has a row a family and place, as many as the families' longest sequences have letters; beyond ``most`` all
    residues are joined with it.
    """
    import numpy as np
    import pyarrow as pa

    known = conserved.select("family", "position", "conservation").limit(most + 1).toArrow()
    if known.num_rows > most:
        return site_scores(sequences, conserved)
    places, values, names = (known[c].to_numpy() for c in ("position", "conservation", "family"))
    by_family = {}
    for name in {x for x in names if x is not None}:
        own = names == name
        by_family[name] = line = np.full(int(places[own].max()) + 1, np.nan)
        line[places[own]] = values[own]
    residue = np.isin(np.arange(128), np.frombuffer(RESIDUES.encode(), np.uint8))
    third = lambda x: np.floor(x * 1000.0 + 0.5) / 1000.0

    def best(letters: np.ndarray, line: np.ndarray, catalytic: list) -> tuple:
        n, use = len(letters), min(len(letters), len(line))
        p, conservation = np.arange(use), line[:use]
        near = np.full(use, n)
        for c in catalytic:
            near = np.minimum(near, np.abs(p - c))
        there = residue[np.minimum(letters[:use], 127)] & ~np.isnan(conservation) & ~np.isin(p, catalytic)
        structural = np.clip(1 / (1 + near / 5), 0.0, 1.0)
        share = p / n
        surface = np.where((share < 0.15) | (share > 0.85), 0.7, 0.3) + np.where(p % 4 < 2, 0.3, 0.0)
        composite = third((1 - np.abs(conservation - 0.5) * 2) * (1 - structural) * surface)
        p = np.flatnonzero(there)
        low = -composite[p]
        if len(p) > k:
            p = p[low <= np.partition(low, k - 1)[k - 1]]
        p = p[np.argsort(-composite[p], kind="stable")][:k]
        return p, letters[p], third(conservation[p]), third(structural[p]), third(np.clip(surface[p], 0.0, 1.0)), composite[p]

    def score(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part, rows, found = b.slice(start, 1024), [], []
                for i, (family, text, catalytic) in enumerate(zip(*(part[c].to_pylist() for c in ("family", "sequence", "catalytic")))):
                    if text and family in by_family:
                        found.append(best(np.frombuffer(text.encode("utf-32-le"), "<u4"), by_family[family], [c for c in catalytic or () if c is not None]))
                        rows += [i] * len(found[-1][0])
                if rows:
                    p, letters, *scores = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(rows)), pa.array(p, pa.int32()), pa.array([chr(x) for x in letters]), *map(pa.array, scores)], ["id", "position", "residue", "conservation", "structural", "surface", "composite"])

    kind = sequences.schema["id"].dataType.simpleString()
    return sequences.select("family", "id", "sequence", "catalytic").mapInArrow(score, f"id {kind}, position int, residue string, conservation double, structural double, surface double, composite double")


def best_sites(scores: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` sites of each sequence with the highest composite, the first along the chain on ties, with rank, effect and confidence."""
    order = Window.partitionBy("id").orderBy(F.desc("composite"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    channel = (F.col("structural") > 0.3) & (F.col("structural") < 0.6)
    effect = F.when(channel, "beneficial").when(F.col("conservation") > 0.7, "deleterious").otherwise("neutral")
    return ranked.withColumns({"effect": effect, "confidence": m.js_round(0.6 + (1 - F.col("conservation")) * 0.3, 3)})


def contacts(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(pose, a, b, distance) of points (pose, id, x, y, z) no farther apart than ``cutoff``, by a grid of cells of that size.

    Points of ``b`` are sent to the cells around theirs, 27 in all, so each pair meets in one cell and only near points meet. Points
    with a null or non-finite coordinate meet none.
    """
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e15" for c in "xyz")
    cell = lambda c: F.floor(F.col(c) / cutoff)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = a.where(finite).select("pose", F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    q = b.where(finite).select("pose", F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        q = q.withColumn("d", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d")
    square = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "yz"), (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")))
    return p.join(q, ["pose", "cx", "cy", "cz"]).select("pose", "a", "b", F.sqrt(square).alias("distance")).where(F.col("distance") <= cutoff)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(x))


def binding_affinity(enzymes: DataFrame, residues: DataFrame) -> DataFrame:
    """(enzyme, kd, energy, distance, orientation, vdw, electrostatic, overall, verdict) from catalytic residues (enzyme, residue, distance, optimal, angle, optimal_angle, pka, pka_shift).

    ``enzymes`` has (enzyme, ph). Terms are means over the residues: a Gaussian of the distance, the squared cosine of the angle, a 6-12
    potential, and charges screened by distance; the energy also has their desolvation, buried surface and lost entropy.
    Without residues the dissociation constant is 1000 and nothing else is known.
    """
    c = F.col
    r = F.greatest(c("distance"), F.lit(0.5))
    off, turn = c("distance") - c("optimal"), F.cos(F.radians(c("angle") - c("optimal_angle")))
    sixth = F.pow(SEPARATION / r, F.lit(6.0))
    charge = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CHARGES.items() for x in pair]), c("residue")), F.lit(0.0))
    bound = 1 / (1 + F.pow(F.lit(10.0), c("ph") - (c("pka") + c("pka_shift"))))
    charged = charge * (1 - bound) + (charge + 1) * bound
    terms = residues.join(enzymes.select("enzyme", "ph"), "enzyme").select("enzyme", F.exp(-off * off / (2 * WIDTH * WIDTH)).alias("d"), (turn * turn).alias("o"), (WELL * (sixth * sixth - 2 * sixth)).alias("v"), (COULOMB * charged * SUBSTRATE_CHARGE / (4 * r * r)).alias("e"))
    g = terms.groupBy("enzyme").agg(*[F.avg(x).alias(x) for x in "dove"])
    d, o = m.clamp("d", 0.0, 1.0), m.clamp("o", 0.0, 1.0)
    vdw, electric = _sigmoid(c("v") * 5), _sigmoid(c("e") * 2)
    energy = m.js_round(c("v") + c("e") - c("e") * (1 / INNER - 1 / OUTER) * INNER - SURFACE * 200 * d * (0.5 + 0.5 * o) + ENTROPY, 3)
    raw = F.exp(energy / KT) * 1000
    overall = m.js_round(m.clamp(0.35 * d + 0.25 * o + 0.2 * vdw + 0.2 * electric, 0.0, 1.0), 3)
    j = enzymes.select("enzyme").join(g, "enzyme", "left")
    none = c("d").isNull()
    or_zero = lambda x: F.when(none, 0.0).otherwise(x)
    out = j.select("enzyme", F.when(none, 1000.0).otherwise(F.greatest(F.lit(0.001), F.when(raw < 1e12, m.js_round(raw, 3)).otherwise(raw))).alias("kd"), or_zero(energy).alias("energy"), *[or_zero(m.js_round(x, 3)).alias(name) for x, name in ((d, "distance"), (o, "orientation"), (vdw, "vdw"), (electric, "electrostatic"))], or_zero(overall).alias("overall"), none.alias("none"))
    verdict = F.when(c("none"), "unknown").when(c("overall") > 0.8, "excellent").when(c("overall") > 0.6, "good").when(c("overall") > 0.4, "moderate").otherwise("poor")
    return out.withColumn("verdict", verdict).drop("none")
