"""Effect-size arithmetic as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

D_TO_LOG_ODDS = math.pi / math.sqrt(3)


def _cells(cs, cf, ts, tf, correction=0.5):
    zero = (cs == 0) | (cf == 0) | (ts == 0) | (tf == 0)
    add = F.when(zero, F.lit(correction)).otherwise(F.lit(0.0))
    return [c + add for c in (cs, cf, ts, tf)]


def log_odds_ratio(cs: Column, cf: Column, ts: Column, tf: Column) -> Column:
    """ln odds ratio; half a count is added to every cell only when one is empty."""
    a, b, c, d = _cells(cs, cf, ts, tf)
    return F.log((c / d) / (a / b))


def log_odds_se(cs: Column, cf: Column, ts: Column, tf: Column) -> Column:
    a, b, c, d = _cells(cs, cf, ts, tf)
    return F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def d_to_log_odds(d: Column) -> Column:
    return d * D_TO_LOG_ODDS


def log_odds_to_d(x: Column) -> Column:
    return x / D_TO_LOG_ODDS


def risk_ratio_to_log_odds(rr: Column, baseline: Column) -> Column:
    """Null where the baseline or the implied treatment risk is not a usable probability."""
    treated = rr * baseline
    ok = (baseline > 0) & (baseline < 1) & (treated < 1) & (treated > 0)
    return F.when(ok, F.log((treated / (1 - treated)) / (baseline / (1 - baseline))))


def log_odds_to_risk_ratio(x: Column, baseline: Column) -> Column:
    ratio = F.exp(x)
    return ratio / (1 - baseline + baseline * ratio)


def se_from_n(effect: Column, n: Column, kind: Column) -> Column:
    return (
        F.when(kind == "cohens_d", F.sqrt(4 / n + effect * effect / (2 * n)))
        .when(kind == "correlation", F.when(n > 3, 1 / F.sqrt(n - 3)).otherwise(F.lit(float("inf"))))
        .otherwise(F.sqrt(4 / n))
    )


def pooled_sd(n1: Column, s1: Column, n2: Column, s2: Column) -> Column:
    return F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))


def hedges_correction(n: Column) -> Column:
    return F.when(n <= 2, F.lit(1.0)).otherwise(1 - 3 / (4.0 * (n - 2) - 1))
