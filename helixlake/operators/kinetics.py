"""Kinetics and control: integrations as folds over steps, signals as windows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

FALL_BACK_TAIL = 5


def velocities(rows: DataFrame) -> DataFrame:
    """Adds ``velocity`` to (s, vmax, km, ki, i)."""
    return rows.withColumn("velocity", m.michaelis_menten(F.col("vmax"), F.col("km"), F.col("s"), F.col("ki"), F.col("i")))


def enzyme_course(runs: DataFrame, steps: int) -> DataFrame:
    """(run, step, substrate, product): a single enzyme by fourth-order Runge-Kutta, a fold over the steps inside the plan.

    Runs have s0, p0, vmax, km, formation, degradation and duration; both concentrations stay at 0 or above.
    """
    dt = F.col("duration") / steps
    v = lambda s: m.michaelis_menten(F.col("vmax"), F.col("km"), F.greatest(s, F.lit(0.0)))
    d, g = F.col("formation"), F.col("degradation")

    def step(acc, i):
        s, p = acc["s"], acc["p"]
        k1 = d - v(s)
        k2 = d - v(s + dt * k1 / 2)
        k3 = d - v(s + dt * k2 / 2)
        k4 = d - v(s + dt * k3)
        made = v(s)
        q1 = made - g * p
        q2 = made - g * (p + dt * q1 / 2)
        q3 = made - g * (p + dt * q2 / 2)
        q4 = made - g * (p + dt * q3)
        s_ = F.greatest(F.lit(0.0), s + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4))
        p_ = F.greatest(F.lit(0.0), p + dt / 6 * (q1 + 2 * q2 + 2 * q3 + q4))
        return F.struct(s_.alias("s"), p_.alias("p"), F.concat(acc["path"], F.array(F.struct(i.alias("step"), s_.alias("substrate"), p_.alias("product")))).alias("path"))

    start = F.struct(F.col("s0").alias("s"), F.col("p0").alias("p"), F.array(F.struct(F.lit(0).alias("step"), F.col("s0").alias("substrate"), F.col("p0").alias("product"))).alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["path"])
    return runs.select("run", F.explode(path).alias("x")).select("run", "x.*")


class Reactor(NamedTuple):
    """Fed-batch culture: growth, feed, transfer and toxicity constants, and those of the feedback on the pathway enzyme.

    Fixed values: they must equal the workbench's for equal courses.
    """

    mu_max: float = 0.4
    ks: float = 0.15
    yxs: float = 0.45
    kla: float = 250.0
    o_sat: float = 8.0
    feed_conc: float = 400.0
    feed_rate: float = 0.02
    k_fpp: float = 12.0
    k_ads: float = 0.08
    fpp_loss: float = 0.15
    fpp_toxic: float = 120.0
    product_toxic: float = 25.0
    tolerance: float = 0.6
    v_max: float = 1.0
    kd: float = 50.0
    n: float = 2.0


def _rates(s: np.ndarray, air: np.ndarray, p: Reactor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives, toxicity and burden of states (biomass, substrate, product, oxygen, intermediate, enzyme) by run."""
    x, sub, prod, oxy, fpp, ads = s
    base = p.mu_max * sub / (p.ks + sub) * np.where(oxy > 0, oxy / (0.2 + oxy), 0.0)
    harm = lambda c, t: np.where(c > t, np.maximum(0, 1 - (c - t) / (2 * t)), 1.0)
    keep = harm(fpp, p.fpp_toxic) * harm(prod, p.product_toxic)
    burden = np.minimum(1, ads / p.tolerance)
    mu = base * keep * np.maximum(0, 1 - burden * 0.4)
    grow = mu * x
    target = np.where(fpp <= 0, p.v_max, p.v_max * p.kd**p.n / (p.kd**p.n + np.maximum(fpp, 0) ** p.n))
    return np.stack([grow, -grow / p.yxs + p.feed_rate * (p.feed_conc - sub) / 2, p.k_ads * ads * fpp * x, p.kla * air * (p.o_sat - oxy) - grow * 0.18, p.k_fpp * x - ads * fpp * p.fpp_loss - fpp * 0.02, (target - ads) * 0.3]), 1 - keep, burden


def bioreactor(runs: DataFrame, steps: int = 100, dt: float = 1.0, reactor: Reactor = Reactor()) -> DataFrame:
    """(run, time, biomass, substrate, product, oxygen, fpp, enzyme, toxicity, burden): Runge-Kutta with a controller on oxygen.

    Runs have setpoint, kp, ki and kd; all runs of a batch advance together as arrays. The integral is
    held within 5, the airflow within 0..3, oxygen under 1.2 saturations, the enzyme under 2.
    """
    import pandas as pd

    def within(s):
        s = np.maximum(s, 0)
        s[3], s[5] = np.minimum(s[3], reactor.o_sat * 1.2), np.minimum(s[5], 2.0)
        return s

    def simulate(frames):
        for frame in frames:
            n = len(frame)
            s = np.repeat(np.array([[0.5], [20.0], [0.0], [reactor.o_sat], [10.0], [reactor.v_max * 0.8]]), n, axis=1)
            total, before, out = np.zeros(n), np.zeros(n), []
            kp, ki, kd, goal = (frame[c].to_numpy(float) for c in ("kp", "ki", "kd", "setpoint"))
            for i in range(steps):
                error = goal - s[3] / reactor.o_sat
                total = np.clip(total + error * dt, -5, 5)
                air = np.clip(1 + kp * error + ki * total + kd * (error - before) / dt, 0, 3)
                before = error
                k1 = _rates(s, air, reactor)[0]
                k2 = _rates(within(s + k1 * dt / 2), air, reactor)[0]
                k3 = _rates(within(s + k2 * dt / 2), air, reactor)[0]
                k4 = _rates(within(s + k3 * dt), air, reactor)[0]
                s = within(s + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4))
                _, toxicity, burden = _rates(s, air, reactor)
                out.append(pd.DataFrame({"run": frame["run"], "time": (i + 1) * dt, "biomass": s[0], "substrate": s[1], "product": s[2], "oxygen": s[3] / reactor.o_sat, "fpp": s[4], "enzyme": s[5], "toxicity": toxicity, "burden": burden}))
            yield pd.concat(out)

    kind = runs.schema["run"].dataType.simpleString()
    return runs.select("run", "setpoint", "kp", "ki", "kd").mapInPandas(simulate, f"run {kind}, time double, biomass double, substrate double, product double, oxygen double, fpp double, enzyme double, toxicity double, burden double")


def burden(course: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Per run: burden index, protein cost, ATP drain, growth penalty, viability and grade."""
    g = course.groupBy("run").agg(F.avg("enzyme").alias("a"), F.avg("burden").alias("b"), F.max("toxicity").alias("t"))
    cost, penalty = F.least(F.lit(1.0), F.col("a") * 0.15), F.col("b") * 0.4
    index = (cost + penalty + F.col("t")) / 3
    grade = F.when(index < 0.2, "low").when(index < 0.4, "moderate").when(index < 0.6, "high").otherwise("critical")
    return g.select("run", m.js_round(index, 3).alias("burden_index"), m.js_round(cost, 3).alias("protein_cost"), m.js_round(F.col("a") * 2.5, 2).alias("atp_drain"), m.js_round(penalty, 3).alias("growth_penalty"), ((index < tolerance) & (F.col("t") < 0.8)).alias("viable"), grade.alias("grade"))


def convergence(signal: DataFrame, setpoint: float) -> DataFrame:
    """Per run (run, step, value): settling step, overshoot in per cent, steady error, convergence rate, crossings, root mean square error, stability.

    Settled is the step after the last one more than 5 % of the setpoint off (null under five steps); the steady error averages the
    last tenth, five steps at least. The rate is the falling slope of the log error over the first half of
    the steps that are more than 0.001 off, 0 if there are ten or fewer. Runs of under five steps have nothing else.
    """
    e = F.col("value") - setpoint
    w = Window.partitionBy("run").orderBy("step")
    n = F.count("*").over(Window.partitionBy("run"))
    x = signal.select("run", "step", "value", e.alias("e"), F.lag(e).over(w).alias("before"), n.alias("n"))
    tail = F.col("step") > F.col("n") - F.greatest(F.lit(FALL_BACK_TAIL), F.floor(F.col("n") * 0.1))
    g = x.groupBy("run").agg(
        F.max("n").alias("n"), F.max(F.when(F.abs("e") > setpoint * 0.05, F.col("step"))).alias("last_off"), F.max("value").alias("top"),
        F.abs(F.avg(F.when(tail, F.col("e")))).alias("steady"), F.count_if(F.col("e") * F.col("before") < 0).alias("crossings"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
    )
    off = x.where(F.abs("e") > 0.001).select("run", F.log(F.abs("e") + 1e-10).alias("y"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("run")).alias("many"))
    half = off.where((F.col("many") > 10) & (F.col("k") <= F.floor(F.col("many") * 0.5)))
    rates = half.groupBy("run").agg((-F.regr_slope("y", F.col("k").cast("double"))).alias("rate"))
    g = g.join(rates, "run", "left")
    short = F.col("n") < 5
    settled = F.when(short, None).when(F.col("last_off").isNull(), F.col("n")).otherwise(F.least(F.col("last_off") + 1, F.col("n")))
    over = F.when(~short & (F.col("top") > setpoint), (F.col("top") - setpoint) / setpoint * 100).otherwise(0.0)
    rest = lambda c: F.when(short, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return g.select(
        "run", settled.alias("settling"), m.js_round(over, 1).alias("overshoot"), m.js_round(rest(F.col("steady")), 3).alias("steady_error"), m.js_round(rest(F.col("rate")), 3).alias("convergence_rate"),
        F.when(short, 0).otherwise(F.col("crossings")).cast("long").alias("crossings"), m.js_round("rmse", 4).alias("rmse"), (~short & (F.col("steady") < 0.08) & (F.col("crossings") < F.col("n") * 0.2)).alias("stable"),
    )


def equilibrium_runs(signal: DataFrame, tolerance: float, least: int) -> DataFrame:
    """(run, start, length) of stretches in which at least ``least`` consecutive relative changes stay below the tolerance."""
    w = Window.partitionBy("run").orderBy("step")
    change = F.abs(F.col("value") - F.lag("value").over(w)) / F.greatest(F.abs(F.lag("value").over(w)), F.lit(1e-9))
    x = signal.withColumn("calm", F.coalesce(change < tolerance, F.lit(False)))
    x = x.withColumn("island", F.sum((~F.col("calm")).cast("int")).over(w)).where("calm")
    return x.groupBy("run", "island").agg(F.min("step").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def gate_response(grid: DataFrame, k: float = 0.5, n: float = 2.0, step: float = 0.05) -> DataFrame:
    """AND, OR, NAND and NOT of two inputs (a, b), each passed through a repressing Hill curve first, and every gate's noise.

    NOT represses the repressed level of ``a`` once more. Noise is the larger change of the output when one
    input rises by ``step``, to 1 at most.
    """
    level = lambda x: m.hill_repression(x, k, n)
    gates = {"and": lambda x, y: x * y, "or": lambda x, y: x + y - x * y, "nand": lambda x, y: 1 - x * y, "not": lambda x, y: level(x)}
    a, b = level(F.col("a")), level(F.col("b"))
    up_a, up_b = (level(F.least(F.lit(1.0), F.col(c) + step)) for c in "ab")
    noise = {f"{name}_noise": F.greatest(F.abs(f(up_a, b) - f(a, b)), F.abs(f(a, up_b) - f(a, b))) for name, f in gates.items()}
    return grid.select("a", "b", *[f(a, b).alias(f"{name}_gate") for name, f in gates.items()], *[c.alias(name) for name, c in noise.items()])


def concentration_sums(readings: DataFrame, *by: str) -> DataFrame:
    """(by, s, n, total, squares) of readings (s, rate, and a weight ``w`` if there is one): all that a fit needs."""
    w = F.col("w") if "w" in readings.columns else F.lit(1)
    return readings.groupBy(*by, "s").agg(F.sum(w).cast("double").alias("n"), F.sum(w * F.col("rate")).alias("total"), F.sum(w * F.col("rate") * F.col("rate")).alias("squares"))


def least_squares(s, n, total, squares, rounds: int = 200) -> tuple[float, float, float]:
    """(vmax, km, r2) by damped least squares (Levenberg-Marquardt) from sums per concentration."""
    y = total / n
    v, km, damping = max(y.max(), 1e-9) * 1.2, max(np.median(s), 1e-9), 1e-2
    error = lambda a, b: (squares - 2 * total * (a * s / (b + s)) + n * (a * s / (b + s)) ** 2).sum()
    for _ in range(rounds):
        j = np.stack([s / (km + s), -v * s / (km + s) ** 2], axis=1)
        h, g = (j * n[:, None]).T @ j, j.T @ (total - n * v * s / (km + s))
        try:
            step = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        a, b = max(v + step[0], 1e-9), max(km + step[1], 1e-9)
        if error(a, b) < error(v, km):
            done = abs(step).max() < 1e-10
            v, km, damping = a, b, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    spread = squares.sum() - total.sum() ** 2 / n.sum()
    return v, km, 1 - error(v, km) / spread if spread > 0 else 0.0


def fit_michaelis_menten(readings: DataFrame, rounds: int = 200) -> DataFrame:
    """(sample, vmax, km, r2) of (sample, s, rate): Spark sums per concentration, and a task fits on the few sums of a sample."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v, km, r2 = least_squares(*(pdf[c].to_numpy(float) for c in ("s", "n", "total", "squares")), rounds)
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "vmax": [v], "km": [km], "r2": [r2]})

    kind = readings.schema["sample"].dataType.simpleString()
    return concentration_sums(readings, "sample").groupBy("sample").applyInPandas(fit, f"sample {kind}, vmax double, km double, r2 double")


def bootstrap_fit(readings: DataFrame, resamples: int = 50, rounds: int = 50) -> DataFrame:
    """(sample, vmax_low, vmax_high, km_low, km_high): 95 % percentile intervals of the fit by resampling the readings.

    A resample counts every reading as often as a hash of it and of the resample's number says (Poisson with
    mean 1), so it is the same on every run, and sums per concentration are all that is shuffled.
    """
    import pandas as pd

    key = F.xxhash64(*readings.columns)
    u = lambda r: F.pmod(F.xxhash64("key", r), F.lit(1 << 20)) / float(1 << 20)
    poisson = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)
    weight = lambda p: sum((F.when(p > t, 1).otherwise(0) for t in poisson), F.lit(0))
    each = readings.select("sample", "s", "rate", key.alias("key"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("w", weight(u(F.col("r")))).where("w > 0").drop("key")
    kind = readings.schema["sample"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v, km, _ = least_squares(*(pdf[c].to_numpy(float) for c in ("s", "n", "total", "squares")), rounds)
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "vmax": [v], "km": [km]})

    fits = concentration_sums(each, "sample", "r").groupBy("sample", "r").applyInPandas(fit, f"sample {kind}, vmax double, km double")
    lists = fits.groupBy("sample").agg(F.sort_array(F.collect_list("vmax")).alias("v"), F.sort_array(F.collect_list("km")).alias("k"))  # as long as there are resamples
    n = F.size("v")
    low, high = F.floor(0.025 * n).cast("int"), F.least(n - 1, F.floor(0.975 * n).cast("int"))
    return lists.select("sample", F.get("v", low).alias("vmax_low"), F.get("v", high).alias("vmax_high"), F.get("k", low).alias("km_low"), F.get("k", high).alias("km_high"))
