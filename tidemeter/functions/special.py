"""Special functions as column expressions, plus tail probabilities for aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Cody's rational approximations of erf (|x| <= 0.5) and erfc (0.5..4, above 4);
# numerator and denominator coefficients, constant term last.
ERF_SMALL = (
    [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3],
)
ERFC_MIDDLE = (
    [
        2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1,
        2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
    ],
    [
        1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
        3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
    ],
)
ERFC_LARGE = (
    [
        1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
        1.60837851487422766e-2, 6.58749161529837803e-4,
    ],
    [
        1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
        2.33520497626869185e-3,
    ],
)
# Wichura's AS 241 normal quantile, central region and the two tails, constant term last.
PPF_CENTRE = (
    [
        2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
        1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
    ],
    [
        5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
        5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
    ],
)
PPF_TAIL = (
    [
        7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
        3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
    ],
    [
        1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
        6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
    ],
)
PPF_FAR = (
    [
        2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
        2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
    ],
    [
        2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
        1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
    ],
)


def _horner(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _ratio(pair: tuple[list[float], list[float]], x: Column) -> Column:
    return _horner(pair[0], x) / _horner(pair[1], x)


def erfc(x: Column) -> Column:
    """Complementary error function, accurate in both tails."""
    a = F.abs(x)
    sq = x * x
    inner = F.lit(1.0) - x * _ratio(ERF_SMALL, sq)
    middle = F.exp(-sq) * _ratio(ERFC_MIDDLE, a)
    inv = F.lit(1.0) / sq
    large = F.exp(-sq) * (F.lit(1.0 / math.sqrt(math.pi)) - inv * _ratio(ERFC_LARGE, inv)) / a
    upper = F.when(a <= 4.0, middle).otherwise(large)
    return F.when(a <= 0.46875, inner).when(x > 0, upper).otherwise(F.lit(2.0) - upper)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * erfc(-z * F.lit(math.sqrt(0.5)))


def normal_sf(z: Column) -> Column:
    return F.lit(0.5) * erfc(z * F.lit(math.sqrt(0.5)))


def normal_ppf(p: Column) -> Column:
    """Normal quantile for 0 < p < 1."""
    q = p - 0.5
    centre = q * _ratio(PPF_CENTRE, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5.0, _ratio(PPF_TAIL, r - 1.6)).otherwise(_ratio(PPF_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def lgamma(x: Column) -> Column:
    """Log gamma for x > 0: shifted Stirling series."""
    shift = 7
    y = x + F.lit(float(shift))
    product = x
    for i in range(1, shift):
        product = product * (x + F.lit(float(i)))
    inv = F.lit(1.0) / y
    sq = inv * inv
    series = inv * _horner([1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12], sq)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square for whole degrees of freedom: a finite sum of df/2 terms."""
    half = x / 2
    df = df.cast("int")

    def sum_terms(first: Column, start: Column, n: Column) -> Column:
        # term_{i+1} = term_i * half / (start + i)
        return F.aggregate(
            F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            F.struct(first.alias("term"), F.lit(0.0).alias("total")),
            lambda acc, i: F.struct(
                (acc["term"] * half / (start + i)).alias("term"), (acc["total"] + acc["term"]).alias("total")
            ),
            lambda acc: acc["total"],
        )

    even = F.exp(-half) * sum_terms(F.lit(1.0), F.lit(0.0), (df / 2).cast("int"))
    odd = erfc(F.sqrt(half)) + F.exp(-half) * sum_terms(
        F.sqrt(half) * F.lit(2 / math.sqrt(math.pi)), F.lit(0.5), ((df - 1) / 2).cast("int")
    )
    return F.when(x <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(odd)


def kolmogorov_sf(n: Column, d: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov tail 2*sum (-1)^(j-1) exp(-2 j^2 n d^2)."""
    x = n * d * d
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x),
    )
    return F.when(x < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_regularised(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    part = front * _beta_fraction(aa, bb, xx) / aa
    return np.where(swap, 1 - part, part)


@pandas_udf(DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution; one call per aggregated row."""
    ok = f.notna() & (df1 > 0) & (df2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        a, b, x = df1[ok].to_numpy(float), df2[ok].to_numpy(float), f[ok].to_numpy(float)
        out[ok] = beta_regularised(b / 2, a / 2, b / (b + a * x))
    return out.where(out.notna(), None)


def kolmogorov_exact_cdf(n: int, d: float) -> float:
    """P(D_n < d) by the matrix method of Marsaglia, Tsang and Wang."""
    s = d * d * n
    if s > 7.24 or (s > 3.76 and n > 99):
        return 1 - 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s)
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    i, j = np.indices((m, m))
    mat = np.where(i - j + 1 >= 0, 1.0, 0.0)
    powers = h ** np.arange(1, m + 1)
    mat[:, 0] -= powers
    mat[m - 1, :] -= powers[::-1]
    mat[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0.0
    inverse_factorial = np.concatenate(([1.0], 1.0 / np.cumprod(np.arange(1.0, m + 1))))
    mat *= inverse_factorial[np.clip(i - j + 1, 0, m)]
    result, exponent = np.eye(m), 0
    base, base_exp, power = mat, 0, n
    while power:
        if power & 1:
            result, exponent = result @ base, exponent + base_exp
        base, base_exp = base @ base, 2 * base_exp
        for_scale = base[k - 1, k - 1]
        if for_scale > 1e140:
            base, base_exp = base * 1e-140, base_exp + 140
        if result[k - 1, k - 1] > 1e140:
            result, exponent = result * 1e-140, exponent + 140
        power >>= 1
    value = result[k - 1, k - 1]
    for step in range(1, n + 1):
        value = value * step / n
        if value < 1e-140:
            value, exponent = value * 1e140, exponent - 140
    return min(1.0, max(0.0, value * 10.0**exponent))


def kolmogorov_series_sf(n: float, d: float) -> float:
    """P(D_n > d) by the limit series with the three corrections of Pelz and Good; far out by the shifted leading term."""
    z = math.sqrt(n) * d
    if z < 0.04:
        return 1.0
    if z > 3:
        return 2 * math.exp(-2 * (z + 1 / (6 * math.sqrt(n))) ** 2)
    z2, z4, z6 = z**2, z**4, z**6
    k = np.arange(-60, 61)
    half, whole = (math.pi * (k + 0.5)) ** 2, (math.pi * k) ** 2
    at_half, at_whole = np.exp(-half / (2 * z2)), np.exp(-whole / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = root / z * at_half.sum()
    k1 = root / (6 * z4) * ((half - z2) * at_half).sum()
    k2 = root / (72 * z4 * z**3) * ((6 * z6 + 2 * z4 + (2 * z4 - 5 * z2) * half + (1 - 2 * z2) * half**2) * at_half).sum()
    k2 -= root / (36 * z**3) * (whole * at_whole).sum()
    third = (5 - 30 * z2) * half**3 + (212 * z4 - 60 * z2) * half**2 + (135 * z4 - 96 * z6) * half - (30 * z6 + 90 * z2 * z6)
    k3 = root / (6480 * z4 * z6) * (third * at_half).sum() + root / (216 * z6) * ((3 * z2 * whole - whole**2) * at_whole).sum()
    return min(1.0, max(0.0, 1 - (k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)))


EXACT_KS_LIMIT = 2000


@pandas_udf(DoubleType())
def ks_sf(n: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided one-sample KS p-value: exact up to ``EXACT_KS_LIMIT`` points, then the corrected limit series, which agrees there."""

    def tail(size: float, stat: float) -> float | None:
        if size != size or stat != stat or size < 1:
            return None
        if size <= EXACT_KS_LIMIT:
            return 1 - kolmogorov_exact_cdf(int(size), stat)
        return kolmogorov_series_sf(size, stat)

    return pd.Series([tail(a, b) for a, b in zip(n.astype(float), d.astype(float))], dtype=float)
