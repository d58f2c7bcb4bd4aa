"""Column functions of the workbench's arithmetic; every division is guarded, every rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % critical values of Student's t for 1 to 9 degrees of freedom, then the normal's.
T_95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262]
Z_95 = 1.96
#: Abramowitz and Stegun 7.1.26, the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def c(x: Column | str | float) -> Column:
    """A column by name, a column, or a literal."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column | str, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c(x) * scale + 0.5) / scale


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def ratio(a: Column | str, b: Column | str, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or either is null."""
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(otherwise))


def safe_log2(x: Column | str, floor: float = -10.0) -> Column:
    return F.when(c(x) > 0, F.log2(c(x))).otherwise(F.lit(floor))


def log2_fold_change(value: Column | str, baseline: Column | str) -> Column:
    """log2(value / baseline), 0 unless both are positive."""
    return F.when((c(value) > 0) & (c(baseline) > 0), F.log2(F.try_divide(c(value), c(baseline)))).otherwise(F.lit(0.0))


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(ERF_P) * z)
    a1, a2, a3, a4, a5 = ERF
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-z * z)
    return F.lit(0.5) * (1 + F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (1 - tail))


def two_tailed_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def t_critical(df: Column) -> Column:
    """95 % critical value by degrees of freedom."""
    table = F.array(*[F.lit(t) for t in T_95])
    return F.when(df <= len(T_95), F.try_element_at(table, df.cast("int"))).otherwise(F.lit(Z_95))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where a variance vanishes or fewer than 3 pairs are there."""
    den = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0)))
    return F.when((n >= 3) & (den > 1e-10), F.try_divide(n * sxy - sx * sy, den)).otherwise(F.lit(0.0))


def shannon_bits(p: Column) -> Column:
    """One term of an entropy: sum it."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def hill_repression(x: Column, k: float, n: float) -> Column:
    return F.lit(k**n) / (F.lit(k**n) + F.pow(x, F.lit(n)))


def hill_activation(x: Column, k: float, n: float) -> Column:
    return F.pow(x, F.lit(n)) / (F.lit(k**n) + F.pow(x, F.lit(n)))


def michaelis_menten(vmax: Column, km: Column, s: Column, ki: Column | None = None, inhibitor: Column | None = None) -> Column:
    """Velocity; a competitive inhibitor counts if its constant and its concentration are both non-zero."""
    apparent = km if ki is None else F.when((F.coalesce(ki, F.lit(0.0)) != 0) & (F.coalesce(inhibitor, F.lit(0.0)) != 0), km * (1 + F.try_divide(inhibitor, ki))).otherwise(km)
    return ratio(vmax * s, apparent + s)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def min_max(x: Column, low: Column, high: Column, otherwise: float = 0.0) -> Column:
    """Scaled to -1..1; ``otherwise`` where the range is at most 1e-6."""
    return F.when(high - low > 1e-6, F.try_divide(x - low, high - low) * 2 - 1).otherwise(F.lit(otherwise))
