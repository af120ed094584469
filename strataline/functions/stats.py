"""Distribution functions as Columns, with the same formulas as SQL text.

Normal tail: Hart's rational form (plain arithmetic, stays in generated code).
Student t and chi-square: incomplete beta and gamma functions, one formula for
all degrees of freedom, worked out for whole Arrow batches of group results at
once. The SQL twins use finite sums instead.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hart's numerator and denominator coefficients, highest power first.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _horner_sql(coefs, x):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc})*{x}+{c!r}"
    return f"({acc})"


def norm_tail(z: Column) -> Column:
    """P(Z > |z|)."""
    x = F.abs(z)
    dens = F.exp(-x * x / 2)
    near = dens * _horner(HART_NUM, x) / _horner(HART_DEN, x)
    far = dens / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    return F.when(x < 7.07106781186547, near).otherwise(far)


def norm_tail_sql(z: str) -> str:
    x = f"abs({z})"
    dens = f"exp(-{x}*{x}/2)"
    near = f"{dens}*{_horner_sql(HART_NUM, x)}/{_horner_sql(HART_DEN, x)}"
    far = f"{dens}/({x}+1/({x}+2/({x}+3/({x}+4/({x}+0.65::DOUBLE)))))/2.506628274631::DOUBLE"
    return f"(CASE WHEN {x} < 7.07106781186547 THEN {near} ELSE {far} END)"


def norm_p(z: Column) -> Column:
    """Two-sided normal p-value."""
    return 2 * norm_tail(z)


def norm_p_sql(z: str) -> str:
    return f"(2*{norm_tail_sql(z)})"


def z_quantile(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def _until_stable(step, start: np.ndarray) -> np.ndarray:
    """Modified Lentz steps until no value changes; steps grow with the root of the degrees of freedom, values with the groups."""
    f, k = start, 0
    while True:
        k += 1
        f, change = step(f, k)
        if not (np.abs(change - 1) > 2e-15).any() or k > 10_000_000:
            return f


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    state = [c, d]

    def step(f, m):
        change = np.ones_like(f)
        for u in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            state[1] = 1 / guard(1 + u * state[1])
            state[0] = guard(1 + u / state[0])
            change = change * state[0] * state[1]
        return f * change, change

    return _until_stable(step, d)


def _lgamma(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in a.tolist()])


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided Student t p-value by the incomplete beta function, one formula for all degrees of freedom >= 1; else NaN."""
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & (df >= 1)
    t, n = np.abs(t[ok]), df[ok]
    a, half = n / 2, np.full(len(n), 0.5)
    # The ratio of gamma functions half a step apart, without cancellation for large a.
    ratio = np.where(a < 50, _lgamma(np.minimum(a, 50) + 0.5) - _lgamma(np.minimum(a, 50)), 0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)) if len(a) else a
    x, y = n / (n + t * t), t * t / (n + t * t)
    with np.errstate(divide="ignore"):
        front = np.exp(-a * np.log1p(t * t / n) + 0.5 * np.log(y) + ratio - 0.5 * math.log(math.pi))
    tail = x < (a + 1) / (a + 2.5)
    p = np.empty(len(n))
    p[tail] = front[tail] * _beta_fraction(a[tail], half[tail], x[tail]) / a[tail]
    p[~tail] = 1 - front[~tail] * _beta_fraction(half[~tail], a[~tail], y[~tail]) * 2
    out[ok] = np.clip(p, 0, 1)
    return out


def chi_square_q(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) by the incomplete gamma function, one formula for all degrees of freedom >= 1; else NaN."""
    out = np.full(len(x), np.nan)
    ok = ~np.isnan(x) & (df >= 1)
    z, a = np.maximum(x[ok], 0.0) / 2, df[ok] / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        small = a * np.log(z) - z - _lgamma(a) if len(a) else a
        large = -a * ((z - a) / a - np.log1p((z - a) / a)) + 0.5 * np.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a**3)
    front = np.exp(np.where(a < 50, small, large))
    q, low, far = np.ones(len(z)), (z > 0) & (z < a + 1), (z >= a + 1) & np.isfinite(z)
    term = [1 / a[low]]

    def series(f, k):
        term[0] = term[0] * z[low] / (a[low] + k)
        return f + term[0], 1 + term[0] / f

    q[low] = 1 - front[low] * _until_stable(series, term[0])
    zz, aa, tiny = z[far], a[far], 1e-300
    b0 = zz + 1 - aa
    state = [np.full(len(zz), 1 / tiny), 1 / b0]

    def fraction(f, k):
        u, b = -k * (k - aa), b0 + 2 * k
        state[1] = 1 / np.where(np.abs(u * state[1] + b) < tiny, tiny, u * state[1] + b)
        state[0] = np.where(np.abs(b + u / state[0]) < tiny, tiny, b + u / state[0])
        return f * state[0] * state[1], state[0] * state[1]

    q[far] = front[far] * _until_stable(fraction, state[1])
    q[np.isinf(z)] = 0.0
    out[ok] = np.clip(q, 0, 1)
    return out


def student_quantile(df: np.ndarray, confidence: float) -> np.ndarray:
    """The t that two-sided probability 1 - confidence lies beyond, by bisection on :func:`student_p`."""
    kinds, back = np.unique(df, return_inverse=True)
    low, high = np.zeros(len(kinds)), np.full(len(kinds), 1e6)
    for _ in range(110):
        mid = np.where(high > 4 * low + 1, np.sqrt((low + 1e-3) * high), (low + high) / 2)
        beyond = student_p(mid, kinds) > 1 - confidence
        low, high = np.where(beyond, mid, low), np.where(beyond, high, mid)
    return np.where(kinds >= 1, (low + high) / 2, np.nan)[back]


def _floats(*series: pd.Series) -> list[np.ndarray]:
    return [s.to_numpy(dtype=float, na_value=np.nan) for s in series]


def _filled(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype(object).where(~np.isnan(values), None)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided Student t p-value; null below one degree of freedom."""
    return F.pandas_udf(lambda t, n: _filled(student_p(*_floats(t, n))), T.DoubleType())(t.cast("double"), df.cast("double"))


def t_p_sql(t: str, df: str) -> str:
    """Finite sums over the degrees of freedom; needs ``t`` and ``df`` to be plain column names."""
    th = f"atan(abs({t})/sqrt({df}::DOUBLE))"
    c2 = f"pow(cos({th}),2)"
    even = f"(1+coalesce(list_sum(list_transform(range(1,(({df}-2)//2+1)::BIGINT), lambda k: exp(lgamma(k+0.5)-lgamma(k+1.0)-0.5723649429247001)*pow({c2},k))),0))"
    odd = f"(1+coalesce(list_sum(list_transform(range(1,(({df}-3)//2+1)::BIGINT), lambda k: exp(lgamma(k+1.0)-lgamma(k+1.5)-0.1207822376352452)*pow({c2},k))),0))"
    return (f"(CASE WHEN {df} < 1 THEN NULL WHEN {df} = 1 THEN 1-2*{th}/pi() "
            f"WHEN {df} % 2 = 1 THEN greatest(0.0, 1-2/pi()*({th}+sin({th})*cos({th})*{odd})) "
            f"ELSE greatest(0.0, 1-sin({th})*{even}) END)")


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-square; null below one degree of freedom."""
    return F.pandas_udf(lambda x, n: _filled(chi_square_q(*_floats(x, n))), T.DoubleType())(x.cast("double"), df.cast("double"))


def chi2_sf_sql(x: str, df: str) -> str:
    """Finite sums over the degrees of freedom."""
    gx = f"greatest({x},0.0)"
    even = (f"list_sum(list_transform(range(0,({df}//2)::BIGINT), lambda k: "
            f"CASE WHEN k=0 THEN exp(-{gx}/2) WHEN {gx}<=0 THEN 0 ELSE exp(-{gx}/2+k*ln(greatest({gx},1e-300)/2)-lgamma(k+1.0)) END))")
    odd = (f"coalesce(list_sum(list_transform(range(1,(({df}-1)//2+1)::BIGINT), lambda k: "
           f"CASE WHEN {gx}<=0 THEN 0 ELSE exp(-{gx}/2+(k-0.5)*ln(greatest({gx},1e-300)/2)-lgamma(k+0.5)) END)),0)")
    return (f"(CASE WHEN {df} < 1 THEN NULL WHEN {df} % 2 = 0 THEN least({even},1.0) "
            f"ELSE least({norm_p_sql(f'sqrt({gx})')}+{odd},1.0) END)")


def t_quantile(df: Column, confidence: float = 0.95) -> Column:
    """Two-sided t quantile; null below one degree of freedom."""
    return F.pandas_udf(lambda n: _filled(student_quantile(*_floats(n), confidence)), T.DoubleType())(df.cast("double"))


#: Degrees of freedom up to which the check SQL reads a table; beyond, five terms of the expansion are exact to double precision.
SQL_TABLE = 400


@cache
def _table(confidence: float) -> list[float]:
    return student_quantile(np.arange(1.0, SQL_TABLE + 1), confidence).tolist()


def t_quantile_sql(df: str, confidence: float = 0.95) -> str:
    table = "[" + ",".join(repr(v) + "::DOUBLE" for v in _table(confidence)) + "]"
    z = z_quantile(confidence)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    large = f"({z!r}" + "".join(f" + {v!r}/pow({df},{k})" for k, v in enumerate(terms, 1)) + ")"
    return f"(CASE WHEN {df} < 1 THEN NULL WHEN {df} <= {SQL_TABLE} THEN ({table})[{df}] ELSE {large} END)"
