"""Formulas of growth assays as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from auxograph.functions.values import clip, col

#: Grams of dry cells per litre at an optical density of 1.
DRY_WEIGHT_RATE = 0.4
#: A series that spans no more than this is flat.
FLAT_RANGE = math.exp(0.1)


def gompertz(t, y0, amplitude, mu_max, lag, clip_exp: float = 50.0) -> Column:
    """Modified Gompertz curve; with an amplitude of 0 it stays at ``y0``."""
    t, y0, a, mu, lam = (col(x) if isinstance(x, (str, Column)) else F.lit(float(x)) for x in (t, y0, amplitude, mu_max, lag))
    inner = clip(F.try_divide(mu * F.lit(math.e), a) * (lam - t) + 1, -clip_exp, clip_exp)
    return F.when(a == 0, y0).otherwise(y0 + a * F.exp(-F.exp(inner)))


def dry_weight(od: str | Column, rate: float = DRY_WEIGHT_RATE) -> Column:
    """Optical density to grams of dry cells per litre."""
    return col(od) * F.lit(rate)


def moles(mass: str | Column, molar_mass: str | Column) -> Column:
    """Grams to moles; null where the molar mass is 0 or unknown."""
    return F.try_divide(col(mass).cast("double"), col(molar_mass).cast("double"))


def millimoles(mass_per_litre: str | Column, molar_mass: str | Column) -> Column:
    """Grams to millimoles per litre; 0 where the molar mass is unknown."""
    return F.coalesce(moles(mass_per_litre, molar_mass) * 1000, F.lit(0.0))


def flux(mmol: str | Column, max_time: str | Column) -> Column:
    """Millimoles per hour until the maximum; 0 where there is no such time."""
    return F.when(col(max_time) > 0, col(mmol) / col(max_time)).otherwise(F.lit(0.0))


def capped_bound(bound: str | Column, limit: float = 10_000, cap: int = 1_000) -> Column:
    """A flux bound as an integer; beyond ``limit``, and where infinite, it is ``cap``."""
    b = col(bound).cast("double")
    return F.when(F.isnan(b) | (b > limit), F.lit(cap)).otherwise(b.cast("int"))


def exchange_name(name: str | Column) -> Column:
    """A metabolite's name as a key: without any ``_e``, underscores as spaces, in lower case."""
    return F.lower(F.trim(F.translate(F.replace(col(name), F.lit("_e"), F.lit("")), "_", " ")))


def exact_ln(c: Column) -> Column:
    """The natural logarithm of a number, rounded as the C library does it (Java's own: ``java.lang.Math``).

    ``F.ln`` takes Java's strict logarithm, which is another in the last digit of 1.3 % of values (0.02 % here); such a digit
    decides which of two equal maxima of smoothed logarithms is the first after rounding.
    """
    number = F.coalesce(c.cast("double"), F.lit(float("nan")))
    return F.java_method(F.lit("java.lang.Math"), F.lit("log"), number).cast("double")
