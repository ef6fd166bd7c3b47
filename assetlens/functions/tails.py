"""Tail probabilities as column expressions: p-values of correlations, normal and chi-square statistics, one per row.

Series and continued fractions run a fixed number of steps inside a higher-order function, so a p-value is part of the plan as any other column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a series or continued fraction.
STEPS = 400


def _let(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of values, each computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), f), F.lit(0))


def _away(x: Column) -> Column:
    """x, but never so near to zero that its inverse overflows."""
    return F.when(F.abs(x) < 1e-290, F.lit(1e-290)).otherwise(x)


def _run(start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], result: str) -> Column:
    state = lambda d: F.struct(*[v.cast("double").alias(k) for k, v in d.items()])
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state(start), lambda s, i: state(step(s, i.cast("double"))), lambda s: s[result])


def log_gamma(a: Column) -> Column:
    """ln gamma(a), a > 0: Stirling's series ten places further on."""
    z = a + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    back = sum((F.log(a + k) for k in range(1, 10)), F.log(a))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function."""

    def tail(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - v["g"])
        low = _run({"term": 1 / a, "total": 1 / a}, lambda s, i: {"term": s["term"] * x / (a + i), "total": s["total"] + s["term"] * x / (a + i)}, "total")

        def turn(s: Column, i: Column) -> dict[str, Column]:
            b = s["b"] + 2
            d = 1 / _away(i * (a - i) * s["d"] + b)
            c = _away(b + i * (a - i) / s["c"])
            return {"b": b, "c": c, "d": d, "h": s["h"] * d * c}

        first = 1 / _away(x + 1 - a)
        high = _run({"b": x + 1 - a, "c": F.lit(1e290), "d": first, "h": first}, turn, "h")
        return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * low)).otherwise(front * high)

    return _let({"a": a, "x": x, "g": log_gamma(a)}, tail)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""

    def share(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        step = lambda s, num: (1 / _away(1 + num * s[0]), _away(1 + num / s[1]))

        def turn(s: Column, m: Column) -> dict[str, Column]:
            d, c = step((s["d"], s["c"]), m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            h = s["h"] * d * c
            d, c = step((d, c), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            return {"c": c, "d": d, "h": h * d * c}

        first = 1 / _away(1 - (a + b) * x / (a + 1))
        return v["front"] * _run({"c": F.lit(1.0), "d": first, "h": first}, turn, "h") / a

    def either(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        turned = x > (a + 1) / (a + b + 2)
        value = _let({"a": F.when(turned, b).otherwise(a), "b": F.when(turned, a).otherwise(b), "x": F.when(turned, 1 - x).otherwise(x), "front": v["front"]}, share)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turned, 1 - value).otherwise(value)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return _let({"a": a, "b": b, "x": x, "front": front}, either)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, from t with n - 2 degrees of freedom; null for fewer than three."""
    return F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).otherwise(beta_share((n - 2) / 2, F.lit(0.5), 1 - r * r))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal statistic; a negative one (as a continuity correction can leave it) gives 1."""
    return F.when(z <= 0, F.when(z.isNotNull(), 1.0)).otherwise(gamma_tail(F.lit(0.5), z * z / 2))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-square; null without degrees of freedom."""
    return F.when(x.isNull() | (df < 1), F.lit(None).cast("double")).otherwise(gamma_tail(df / 2, x / 2))
