"""Flux balance and thermodynamics: scenarios as rows, one small linear program each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.sources import constants as k

#: Carbons of biomass and product, growth per biomass flux.
CARBON_BIOMASS, CARBON_PRODUCT, GROWTH = 4.6, 6.0, 0.061


def maximize(c: np.ndarray, balances: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """max c.x with balances.x = 0 and 0 <= x <= upper, by the simplex method; zero is feasible, so no first phase is needed.

    Least-index pivoting, since the balances make every start degenerate.
    """
    rows = np.vstack([balances, -balances, np.eye(len(c))])
    tableau = np.hstack([rows, np.eye(len(rows)), np.concatenate([np.zeros(2 * len(balances)), upper])[:, None]])
    cost, basis = np.concatenate([c, np.zeros(len(rows) + 1)]), np.arange(len(c), len(c) + len(rows))
    for _ in range(8000):
        entering = np.flatnonzero(cost[:-1] > 1e-9)
        if not len(entering):
            break
        j = entering[0]
        up = np.flatnonzero(tableau[:, j] > 1e-9)
        ratio = tableau[up, -1] / tableau[up, j]
        ties = up[ratio <= ratio.min() + 1e-12]
        i = ties[np.argmin(basis[ties])]
        tableau[i] /= tableau[i, j]
        others = np.arange(len(tableau)) != i
        tableau[others] -= np.outer(tableau[others, j], tableau[i])
        cost = cost - cost[j] * tableau[i]
        basis[i] = j
    x = np.zeros(len(c) + len(rows))
    x[basis] = tableau[:, -1]
    return x[: len(c)]


def solve(scenarios: DataFrame, objective: str = "biomass", knockouts: tuple[str, ...] = (), prices: bool = True) -> DataFrame:
    """Fluxes of the small host network for (scenario, glucose, oxygen), and with ``prices`` again for uptakes moved up and down for shadow prices, else null.

    Returns (scenario, growth, biomass, product, atp_yield, carbon_efficiency, feasible, shadow_glucose, shadow_oxygen).
    Uptakes are clamped to 0..25, a knocked-out reaction has upper bound 0. Scenarios are independent rows.
    """
    import pandas as pd

    names = [r[0] for r in k.ECOLI_REACTIONS]
    balances = np.array([[b.get(n, 0.0) for n in names] for b in k.ECOLI_BALANCES], float)
    c = np.array([k.ECOLI_OBJECTIVES[objective].get(n, 0.0) for n in names], float)
    at = {n: i for i, n in enumerate(names)}

    def fluxes(glucose: float, oxygen: float) -> np.ndarray:
        upper = np.array([u if u is not None else min(max({"GLCpts": glucose, "O2tx": oxygen}[n], 0.0), 25.0) for n, _, u in k.ECOLI_REACTIONS], float)
        upper[[at[n] for n in knockouts if n in at]] = 0.0
        return maximize(c, balances, upper)

    def run(frames):
        half_up = lambda v, d: np.floor(v * 10**d + 0.5) / 10**d
        for frame in frames:
            out = []
            for scenario, glucose, oxygen in zip(frame.scenario, frame.glucose.clip(0, 25), frame.oxygen.clip(0, 25)):
                x = fluxes(glucose, oxygen)
                g = lambda n: x[at[n]]  # noqa: B023, E731
                glc = g("GLCpts")
                atp = (g("GAPD") + g("PYK") - g("PFK") + g("PDH") * 0.5) / glc if glc > 1e-9 else 0.0
                carbon = (g("BIOMASS") * CARBON_BIOMASS + g("PRODUCT") * CARBON_PRODUCT) / (glc * 6) * 100 if glc > 1e-9 else 0.0
                grow = lambda a, b: half_up(fluxes(a, b)[at["BIOMASS"]] * GROWTH, 4)
                if not prices:
                    out.append((scenario, half_up(g("BIOMASS") * GROWTH, 4), half_up(g("BIOMASS"), 4), half_up(g("PRODUCT"), 4), half_up(atp, 2), half_up(min(max(carbon, 0), 100), 1), bool(c @ x > 1e-6), None, None))
                    continue
                e = max(0.05, glucose * 0.01)
                by_glucose = (grow(glucose + e, oxygen) - grow(max(0.0, glucose - e), oxygen)) / (2 * e)
                by_oxygen = (grow(glucose, oxygen + e) - grow(glucose, max(0.0, oxygen - e))) / (2 * e)
                out.append((scenario, half_up(g("BIOMASS") * GROWTH, 4), half_up(g("BIOMASS"), 4), half_up(g("PRODUCT"), 4), half_up(atp, 2), half_up(min(max(carbon, 0), 100), 1), bool(c @ x > 1e-6), half_up(by_glucose, 4), half_up(by_oxygen, 4)))
            yield pd.DataFrame(out, columns=["scenario", "growth", "biomass", "product", "atp_yield", "carbon_efficiency", "feasible", "shadow_glucose", "shadow_oxygen"])

    kind = scenarios.schema["scenario"].dataType.simpleString()
    spread = scenarios.select("scenario", "glucose", "oxygen").repartition(4 * scenarios.sparkSession.sparkContext.defaultParallelism, "scenario")  # a row is milliseconds of work, files may be few
    return spread.mapInPandas(run, f"scenario {kind}, growth double, biomass double, product double, atp_yield double, carbon_efficiency double, feasible boolean, shadow_glucose double, shadow_oxygen double")


def closed_form(scenarios: DataFrame, objective: str = "biomass") -> DataFrame:
    """The same network without knockouts as an expression: the steady state forces PDH = 2 glucose = oxygen."""
    pdh = F.least(m.clamp("glucose", 0.0, 25.0) * 2, m.clamp("oxygen", 0.0, 25.0))
    flux, none = F.round(pdh, 12), F.lit(0.0)
    b, p = (none, flux) if objective == "product" else (flux, none)
    glc = pdh / 2
    carbon = m.ratio((b * CARBON_BIOMASS + p * CARBON_PRODUCT) * 100, glc * 6)
    return scenarios.select("scenario", m.js_round(b * GROWTH, 4).alias("growth"), m.js_round(b, 4).alias("biomass"), m.js_round(p, 4).alias("product"), m.js_round(m.clamp(carbon, 0.0, 100.0), 1).alias("carbon_efficiency"), (pdh > 1e-6).alias("feasible"))


def subsystem_sums(fluxes: DataFrame) -> DataFrame:
    """(subsystem, total) of absolute fluxes, two decimals, and the reaction that carries most."""
    return fluxes.groupBy("subsystem").agg(m.js_round(F.sum(F.abs("flux")), 2).alias("total"), F.max_by("reaction", F.struct(F.abs("flux"), -F.col("reaction"))).alias("largest"))


def top_fluxes(fluxes: DataFrame, n: int = 6) -> DataFrame:
    return fluxes.orderBy(F.desc(F.abs("flux")), "reaction").limit(n)


def thermo_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(k.THERMO_STEPS, "pathway string, place int, step string, dg double, atp int")


def waterfall(steps: DataFrame) -> DataFrame:
    """Steps with the running sum of free energy along each pathway."""
    w = Window.partitionBy("pathway").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("cumulative", F.sum("dg").over(w))


def thermo_totals(steps: DataFrame, celsius: float = 25.0) -> DataFrame:
    """Per pathway: total energy and ATP, share of the combustion enthalpy (2870 kJ/mol) in 0..1, entropy, the limiting step."""
    g = steps.groupBy("pathway").agg(F.sum("dg").alias("dg"), F.sum("atp").alias("atp"), F.max_by("step", F.struct("dg", -F.col("place"))).alias("limiting"))
    return g.select("pathway", "dg", "atp", m.clamp(-F.col("dg") / 2870, 0.0, 1.0).alias("efficiency"), (-F.col("dg") / (celsius + 273.15)).alias("entropy"), "limiting")


def concerns(steps: DataFrame, most: int = 4) -> DataFrame:
    """Unfavourable steps of each pathway, the first few by place."""
    n = F.row_number().over(Window.partitionBy("pathway").orderBy("place"))
    return steps.where("dg > 0").withColumn("n", n).where(F.col("n") <= most).drop("n")
