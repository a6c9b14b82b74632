"""The normal quantile and tail probabilities of the F distribution, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, and what stands for zero in a continued fraction.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
TINY = 1e-300

#: Coefficients, constant first, of the rational approximations of algorithm AS 241 (PPND16): for probabilities near a
#: half, further away, and in the far tails.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AWAY = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    def polynomial(values: tuple[float, ...]) -> Column:
        out = F.lit(values[-1])
        for value in values[-2::-1]:
            out = out * x + F.lit(value)
        return out

    return polynomial(coefficients[0]) / polynomial(coefficients[1])


def normal_deviate(p: str | Column) -> Column:
    """The deviate with this probability below it; null outside of (0, 1), where there is none."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    middle = q * _ratio(MIDDLE, 0.180625 - q * q)
    outer = F.signum(q) * F.when(r <= 5, _ratio(AWAY, r - 1.6)).otherwise(_ratio(TAIL, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(outer))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: the series of Stirling at x + 8, taken back by the product of the eight factors between."""
    far = x + 8
    product = reduce(lambda a, b: a * b, (x + k for k in range(8)))
    inverse = 1 / (far * far)
    series = reduce(lambda out, term: out * inverse + F.lit(term), reversed(STIRLING[:-1]), F.lit(STIRLING[-1])) / far
    return (far - 0.5) * F.ln(far) - far + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the regularised incomplete beta function, for x < (a + 1) / (a + b + 2), by the method of Lentz; its terms fade within a few square roots of the larger parameter."""
    guard = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    first = 1 / guard(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))

    def step(state: Column, j: Column) -> Column:
        m = F.floor(j / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        top = F.when(j % 2 == 0, even).otherwise(odd)
        d, c = 1 / guard(1 + top * state["d"]), guard(1 + top / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    terms = F.sequence(F.lit(2), F.lit(80) + F.least(F.lit(100_000), F.ceil(8 * F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(terms, start, step)["value"]


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); null where a or b isn't positive."""
    near = x < (a + 1) / (a + b + 2)
    low_a, low_b, low_x = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    part = front * _beta_fraction(low_a, low_b, low_x) / low_a
    return F.when((a > 0) & (b > 0), F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, part).otherwise(1 - part))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) with df1 and df2 degrees of freedom; of t with df2, f is its square and df1 is 1. Null for a null or NaN f and without degrees of freedom."""
    f, df1, df2 = (c.cast("double") for c in (f, df1, df2))
    return F.when(~F.isnan(f), beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))
