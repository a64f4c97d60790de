"""Parametric mean value functions scored against observed ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import special as S

PERIOD = 2 * math.pi / 5

# Families with their parameter sets (p1, p2, p3, p4).
PARAMETER_SETS = [
    ("crow_amsaa", 1.2, 1.5, None, None),
    ("crow_amsaa", 1.0, 2.0, None, None),
    ("crow_amsaa", 0.8, 2.5, None, None),
    ("goel_okumoto", 30.0, 0.4, None, None),
    ("goel_okumoto", 50.0, 0.6, None, None),
    ("goel_okumoto", 70.0, 0.9, None, None),
    ("musa_okumoto", 30.0, 0.05, None, None),
    ("musa_okumoto", 50.0, 0.08, None, None),
    ("musa_okumoto", 70.0, 0.12, None, None),
    ("yamada_s", 80.0, 0.3, None, None),
    ("yamada_s", 100.0, 0.5, None, None),
    ("yamada_s", 120.0, 0.7, None, None),
    ("rayleigh", 80.0, 0.3, None, None),
    ("rayleigh", 100.0, 0.5, None, None),
    ("rayleigh", 120.0, 0.7, None, None),
    ("logistic", 80.0, 0.5, 4.0, None),
    ("logistic", 100.0, 0.7, 5.0, None),
    ("logistic", 120.0, 1.0, 7.0, None),
    ("gompertz", 80.0, 0.5, 4.0, None),
    ("gompertz", 100.0, 0.7, 5.0, None),
    ("gompertz", 120.0, 1.0, 7.0, None),
    ("sinusoidal", 5.0, 3.0, PERIOD, 0.0),
    ("sinusoidal", 6.0, 2.0, PERIOD, math.pi / 4),
    ("sinusoidal", 4.0, 4.0, PERIOD, math.pi / 2),
    ("fourier", 1.0, None, None, None),
    ("fourier", 2.0, None, None, None),
    ("fourier", 3.0, None, None, None),
    ("gaussian_mixture", 1.0, None, None, None),
]
# Constant term, sine terms (weight, harmonic) and cosine terms of each Fourier set.
FOURIER_SETS = {
    1: (5.0, [(3.0, 1), (2.0, 1)], [(2.0, 1), (1.0, 1)]),
    2: (6.0, [(2.0, 1), (1.0, 2)], [(1.0, 1), (1.0, 2)]),
    3: (4.0, [(4.0, 1), (1.0, 2)], [(2.0, 1), (0.5, 2)]),
}
# Weight, centre and spread of the mixture components.
MIXTURE = [(3.0, 3.0, 0.4), (2.0, 7.0, 0.8)]


def _fourier(t: Column, which: int) -> tuple[Column, Column]:
    constant, sines, cosines = FOURIER_SETS[which]
    m, rate = constant * t, F.lit(constant)
    for weight, k in sines:
        w = k * PERIOD
        m, rate = m + weight / w * (1 - F.cos(w * t)), rate + weight * F.sin(w * t)
    for weight, k in cosines:
        w = k * PERIOD
        m, rate = m + weight / w * F.sin(w * t), rate + weight * F.cos(w * t)
    return m, rate


def _mixture(t: Column) -> tuple[Column, Column]:
    m, rate = F.lit(0.0), F.lit(0.0)
    for weight, centre, spread in MIXTURE:
        z = (t - centre) / spread
        m = m + weight * S.normal_cdf(z)
        rate = rate + weight / spread / math.sqrt(2 * math.pi) * F.exp(-0.5 * z * z)
    return m, rate


def family_values(family: Column, t: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Mean value function and intensity of a row's family at time t > 0."""
    decay, gauss = F.exp(-b * t), F.exp(-b * t * t)
    growth = 1 + c * decay
    forms = {
        "crow_amsaa": (F.pow(t / b, a), a / b * F.pow(t / b, a - 1)),
        "goel_okumoto": (a * (1 - decay), a * b * decay),
        "musa_okumoto": (F.log(1 + b * a * t) / b, a / (1 + b * a * t)),
        "yamada_s": (a * (1 - (1 + b * t) * decay), a * b * b * t * decay),
        "rayleigh": (a * (1 - gauss), 2 * a * b * t * gauss),
        "logistic": (a / growth, a * b * c * decay / (growth * growth)),
        "gompertz": (a * F.exp(-c * decay), a * b * c * decay * F.exp(-c * decay)),
        "sinusoidal": (a * t + b / c * (F.cos(d) - F.cos(c * t + d)), a + b * F.sin(c * t + d)),
        "gaussian_mixture": _mixture(t),
    }
    m, rate = None, None
    for name, (value, slope) in forms.items():
        hit = family == name
        m = F.when(hit, value) if m is None else m.when(hit, value)
        rate = F.when(hit, slope) if rate is None else rate.when(hit, slope)
    for which in FOURIER_SETS:
        value, slope = _fourier(t, which)
        hit = (family == "fourier") & (a == which)
        m, rate = m.when(hit, value), rate.when(hit, slope)
    return m, rate


def _parameter_array() -> Column:
    names = ("family", "p1", "p2", "p3", "p4")
    return F.array(
        *[
            F.struct(*[F.lit(v).cast("string" if i == 0 else "double").alias(names[i]) for i, v in enumerate(row)])
            for row in PARAMETER_SETS
        ]
    )


def with_families(curves: DataFrame) -> DataFrame:
    """Every curve point with every parameter set, its model value ``m_model`` and intensity ``rate_model``."""
    rows = curves.withColumn("_p", F.explode(_parameter_array())).select("*", "_p.*").drop("_p")
    m, rate = family_values(*[F.col(c) for c in ("family", "t", "p1", "p2", "p3", "p4")])
    return rows.withColumn("m_model", m).withColumn("rate_model", rate)


def score_families(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Squared error of every parameter set against observed curves (keys, t, m)."""
    err = F.col("m") - F.col("m_model")
    return with_families(curves).groupBy(*keys, "family", "p1", "p2").agg(F.sum(err * err).alias("sse"))


def best_family(curves: DataFrame, keys: list[str]) -> DataFrame:
    scored = score_families(curves, keys)
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("family", "p1", "p2", "sse"), F.struct("sse", "family", "p1")).alias("b"))
    return best.select(*keys, "b.*")
