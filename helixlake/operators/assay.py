"""Design-build-test-learn statistics over assay rows (sample, strain, condition, yield, biomass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

#: Column names that an assay file may use for each field, the first found wins.
ALIASES = {
    "sample_id": ["sample_id", "sample", "id"],
    "yield": ["yield_mg_l", "yield", "titer", "titre"],
    "biomass": ["biomass_od600", "od600", "biomass", "od"],
    "substrate": ["substrate_consumed_mm", "substrate_consumed", "substrate"],
}


def number(x: Column) -> Column:
    """A finite number, or null for blanks, na and nan; a per cent sign is dropped."""
    v = F.trim(F.replace(x, F.lit("%"), F.lit("")))
    d = v.try_cast("double")
    return F.when(~F.lower(v).isin("", "na", "nan", "inf", "infinity", "-inf", "-infinity", "+inf", "+infinity") & ~F.isnan(d), d)


def read_assay(spark: SparkSession, path: str) -> DataFrame:
    """Assay CSV (quotes doubled inside quotes, a BOM or CRLF are fine) to (sample_id, yield, biomass, substrate).

    Headers are matched in lower case with spaces as underscores; rows without a yield are dropped, a
    file without a yield column is an error, a missing sample id becomes the row's place.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = {c.strip().lstrip("﻿").lower().replace(" ", "_"): c for c in raw.columns}
    found = {k: next((have[a] for a in names if a in have), None) for k, names in ALIASES.items()}
    if found["yield"] is None:
        raise ValueError(f"no yield column among {raw.columns}")
    own = lambda k: number(F.col(f"`{found[k]}`")) if found[k] else F.lit(None).cast("double")
    sample = F.col(f"`{found['sample_id']}`") if found["sample_id"] else F.lit(None).cast("string")
    return raw.select(F.coalesce(sample, F.concat(F.lit("row-"), F.monotonically_increasing_id())).alias("sample_id"), own("yield").alias("yield"), own("biomass").alias("biomass"), own("substrate").alias("substrate")).where("yield IS NOT NULL")


def yield_stats(rows: DataFrame) -> DataFrame:
    """n, mean, population deviation, extremes and their samples (the first in sample order)."""
    best = F.max_by("sample", F.struct("yield", -F.col("sample")))
    worst = F.min_by("sample", F.struct("yield", F.col("sample")))
    return rows.agg(F.count("*").alias("n"), F.avg("yield").alias("mean"), F.stddev_pop("yield").alias("std"), F.min("yield").alias("min"), F.max("yield").alias("max"), best.alias("best"), worst.alias("worst"))


def qc_flags(rows: DataFrame, by: str, theoretical_max: float, sigma: float = 3.0) -> DataFrame:
    """(sample, flag): sensor_anomaly above the maximum, below_detection under 0.01 despite growth, outlier beyond 3 deviations of its group."""
    s = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("yield").alias("mean"), F.stddev_pop("yield").alias("std"))
    y = F.col("yield")
    flags = F.array(
        F.when(y > theoretical_max, "sensor_anomaly"),
        F.when((y < 0.01) & (F.col("biomass") > 0.1), "below_detection"),
        F.when((F.col("n") >= 3) & (F.col("std") > 0) & (F.abs(y - F.col("mean")) > sigma * F.col("std")), "outlier"),
    )
    return rows.join(s, by).select("sample", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("flag"))


def suggestions(rows: DataFrame, last_result: float) -> DataFrame:
    """(ord, parameter, current, suggested, improvement): what to change next by the means; one fallback if nothing fires.

    Fixed values: the reference points 50 mg/L/OD, OD 1.0 and 5 mg/mmol, and the bands of improvement.
    """
    g = rows.agg(F.avg("yield").alias("y"), F.avg("biomass").alias("b"), F.avg("substrate").alias("s"))
    y, b, s, target = F.col("y"), F.col("b"), F.col("s"), float(last_result) * 1.2 if last_result > 0 else 0.0
    now = F.when(s > 0, s).otherwise(10.0)

    def row(place, when, name, current, wanted, gain):
        r = F.struct(F.lit(place).alias("ord"), F.lit(name).alias("parameter"), m.c(current).cast("double").alias("current"), m.c(wanted).cast("double").alias("suggested"), m.js_round(gain, 1).alias("improvement"))
        return F.when(F.coalesce(when, F.lit(False)), r)

    gap = F.least(F.lit(1.0), m.ratio(F.lit(target) - y, F.lit(target)))
    per_od, conversion = m.ratio(y, b), m.ratio(y, s)
    made = F.array(
        row(1, F.lit(target > 0) & (y < target), "precursor loading", m.js_round(now, 1), m.js_round(now * 1.25, 1), m.clamp(8 + 20 * gap, 8.0, 30.0)),
        row(2, (b > 0) & (per_od < 50), "promoter strength", 1000.0, 1500.0, m.clamp(10 + 20 * (50 - per_od) / 50, 10.0, 28.0)),
        row(3, (b > 0) & (b < 1.0), "induction temperature", 37.0, 30.0, m.clamp(8 + 10 * (1 - b), 8.0, 18.0)),
        row(4, (s > 0) & (conversion < 5), "carbon feeding rate", m.js_round(s / 48, 2), m.js_round(s * 0.8 / 48, 2), m.clamp(6 + 10 * (5 - conversion) / 5, 6.0, 16.0)),
    )
    fired = F.filter(made, lambda r: r.isNotNull())
    fallback = F.array(row(5, F.lit(True), "fermentation duration", 48.0, 72.0, F.lit(7.5)))
    return g.where("y IS NOT NULL").select(F.explode(F.when(F.size(fired) > 0, fired).otherwise(fallback)).alias("r")).select("r.*")


def feedback(rows: DataFrame, last_result: float, theoretical_max: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pipeline of a feedback step: statistics, quality flags, suggestions."""
    own = rows.withColumn("all_rows", F.lit(1))
    return yield_stats(rows), qc_flags(own, "all_rows", theoretical_max), suggestions(rows, last_result)


def iteration_rates(iterations: DataFrame) -> DataFrame:
    """Pass rate, improvement over the number of iterations, and the best one, of (iteration, result, passed)."""
    return iterations.agg(
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
        m.ratio(F.max_by("result", "iteration") - F.min_by("result", "iteration"), F.count("*")).alias("improvement_rate"),
        F.max_by("iteration", F.struct("result", -F.col("iteration"))).alias("best"),
    )


def histogram(rows: DataFrame, value: str, bins: int = 10, width: float = 10.0) -> DataFrame:
    """(bin, n, mean): equal bins from 0, everything above in the last."""
    return rows.groupBy(F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def initial_rates(plate: DataFrame, points: int = 5) -> DataFrame:
    """(concentration, rate): slope over the first ``points`` readings by time of each concentration, pooled over replicates; blanks are skipped."""
    own = plate.where("concentration > 0 AND signal IS NOT NULL")
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("concentration").orderBy("time", "replicate"))).where(F.col("k") <= points)
    s = first.groupBy("concentration").agg(F.count("*").alias("n"), F.sum("time").alias("t"), F.sum("signal").alias("y"), F.sum(F.col("time") * F.col("time")).alias("tt"), F.sum(F.col("time") * F.col("signal")).alias("ty"))
    return s.select("concentration", m.ratio(F.col("n") * F.col("ty") - F.col("t") * F.col("y"), F.col("n") * F.col("tt") - F.col("t") * F.col("t")).alias("rate"))


def r_squared(rows: DataFrame, seen: str, fitted: str) -> DataFrame:
    mean = rows.agg(F.avg(seen).alias("mean"))
    rest = F.pow(F.col(seen) - F.col(fitted), F.lit(2.0))
    total = F.pow(F.col(seen) - F.col("mean"), F.lit(2.0))
    return rows.crossJoin(F.broadcast(mean)).agg((1 - m.ratio(F.sum(rest), F.sum(total))).alias("r2"))
