"""Distribution functions against numeric integration, pooling against hand-computed cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline import session
from strataline.functions import effects, stats
from strataline.operators import bias, meta, reports, scale, sensitivity
from strataline.sources import readers


def integrate(f, a, b, n=20000):
    h = (b - a) / n
    return h / 3 * (f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, n)))


def t_tail(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * integrate(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, t)


def chi_tail(x, df):
    c = -df / 2 * math.log(2) - math.lgamma(df / 2)
    return 1 - integrate(lambda u: math.exp(c + (df / 2 - 1) * math.log(u) - u / 2) if u > 0 else 0.0, 1e-12, x)


def test_tails(spark):
    cases = [(0.3, 2, 1.0), (1.7, 3, 7.3), (1.96, 8, 4.0), (2.5, 29, 30.0), (1.1, 150, 160.0), (1.1, 400, 420.0), (0.9, 1000, 990.0)]
    df = spark.createDataFrame(cases, "t double, d long, x double")
    for r in df.select("t", "d", "x", stats.t_p(F.col("t"), F.col("d")).alias("tp"), stats.chi2_sf(F.col("x"), F.col("d")).alias("cp"),
                       stats.norm_p(F.col("t")).alias("np")).collect():
        assert r.tp == pytest.approx(t_tail(r.t, r.d), abs=1e-8)
        assert r.cp == pytest.approx(chi_tail(r.x, r.d), abs=2e-6)
        assert r.np == pytest.approx(math.erfc(r.t / math.sqrt(2)), abs=1e-13)


def test_t_quantile(spark):
    df = spark.createDataFrame([(1,), (4,), (200,), (500,)], "d long")
    for r in df.select("d", stats.t_quantile(F.col("d")).alias("q")).collect():
        assert r.d == 1 or t_tail(r.q, r.d) == pytest.approx(0.05, abs=1e-7)
        assert r.d != 1 or r.q == pytest.approx(12.7062047, abs=1e-6)


def studies(spark, rows, group="g"):
    return spark.createDataFrame([(group, f"s{i + 1}", float(e), float(s)) for i, (e, s) in enumerate(rows)], "g string, study_id string, effect double, se double")


def test_pooled_value(spark):
    p = meta.pool(studies(spark, [(.5, .1), (.6, .1), (.4, .2)]), ["g"])
    r = meta.fixed_effects(p, ["g"]).first()
    assert round(r.pooled_effect, 3) == 0.533 and r.p_value < .05


def test_heterogeneous_and_auto(spark):
    r = meta.heterogeneity(studies(spark, [(.1, .1), (.9, .1)]), ["g"]).first()
    assert r.i2 > 50 and r.q > 0
    assert meta.auto_model(meta.pool(studies(spark, [(.1, .05), (.9, .05)]), ["g"]), ["g"]).first().model == "random"


def test_funnel_and_failsafe(spark):
    s = studies(spark, [(.5, .1), (.5, .2), (.5, .05), (.45, .15), (.55, .15)])
    assert not bias.eggers_test(s, ["g"]).first().significant
    assert bias.failsafe_n(meta.pool(studies(spark, [(.8, .1), (.9, .1)]), ["g"]), ["g"]).first().failsafe > 0


def test_equal_precision_gives_degenerate_egger(spark):
    r = bias.eggers_test(studies(spark, [(.5, .5), (.6, .5), (.7, .5)]), ["g"]).first()
    assert not r.significant and r.p_value == 1.0


def test_reversal(spark):
    s = studies(spark, [(-.2, .1), (-.3, .1), (.5, .05), (.6, .05)]).withColumn("segment", F.when(F.col("effect") < 0, "A").otherwise("B"))
    rows = meta.reversals(meta.pool(s, ["g"]), meta.stratified(s, ["g"], "segment"), ["g"], "segment").collect()
    assert [r.segment for r in rows] == ["A"]


def dl(rows):
    w = [1 / s ** 2 for _, s in rows]
    m = sum(a * e for a, (e, _) in zip(w, rows)) / sum(w)
    q = sum(a * (e - m) ** 2 for a, (e, _) in zip(w, rows))
    c = sum(w) - sum(a * a for a in w) / sum(w)
    tau2 = max(0.0, (q - (len(rows) - 1)) / c)
    w = [1 / (s ** 2 + tau2) for _, s in rows]
    return sum(a * e for a, (e, _) in zip(w, rows)) / sum(w), 1 / math.sqrt(sum(w))


@pytest.mark.parametrize("spread", [0.01, 0.5, 3.0])
def test_leave_one_out_and_prefixes_equal_direct_computation(spark, spread):
    rnd = random.Random(7)
    rows = [(rnd.gauss(0, spread), math.exp(rnd.uniform(-6, 1))) for _ in range(40)]
    s = studies(spark, rows)
    got = {r.study_id: r for r in sensitivity.leave_one_out(s, meta.pool(s, ["g"]), ["g"]).collect()}
    for i in range(len(rows)):
        e, se = dl(rows[:i] + rows[i + 1:])
        assert got[f"s{i + 1}"].pooled_effect == pytest.approx(e, rel=1e-9, abs=1e-11)
        assert got[f"s{i + 1}"].standard_error == pytest.approx(se, rel=1e-9)
    timed = s.withColumn("day", F.expr("cast(substring(study_id, 2) as int)"))
    for r in sensitivity.cumulative(timed, ["g"], "day").collect():
        assert r.pooled_effect == pytest.approx(dl(rows[:r.n_studies])[0], rel=1e-9, abs=1e-11)


def test_outlier_changes_most(spark):
    s = studies(spark, [(.5, .1), (.5, .1), (5.0, .1)])
    got = {r.study_id: abs(r.effect_change) for r in sensitivity.leave_one_out(s, meta.pool(s, ["g"]), ["g"]).collect()}
    assert got["s3"] > got["s1"]


def test_rank_correlation_with_ties(spark):
    rnd = random.Random(3)
    pts = [("a", rnd.randrange(12), rnd.randrange(9)) for _ in range(70)] + [("b", i, -i) for i in range(10)]
    sign = lambda v: (v > 0) - (v < 0)
    want = {}
    for g in "ab":
        p = [(x, y) for k, x, y in pts if k == g]
        num = sx = sy = 0
        for i in range(len(p)):
            for j in range(i):
                a, b = sign(p[i][0] - p[j][0]), sign(p[i][1] - p[j][1])
                num, sx, sy = num + a * b, sx + a * a, sy + b * b
        want[g] = num / math.sqrt(sx * sy)
    got = bias.rank_correlation(spark.createDataFrame(pts, "g string, x int, y int"), ["g"], "x", "y").collect()
    assert {r.g: pytest.approx(want[r.g], abs=1e-12) == r.tau for r in got} == {"a": True, "b": True}


def test_decision_bands(spark):
    p = [(.0005, "Very High"), (.005, "High"), (.03, "Moderate"), (.08, "Low"), (.15, "Very Low")]
    df = spark.createDataFrame([(x, 20.0 * (i + 1), .2, .8) for i, (x, _) in enumerate(p)], "p_value double, i2 double, ci_lower double, ci_upper double")
    rows = sorted(reports.traffic_light(df.withColumn("g", F.col("p_value")), ["g"]).collect(), key=lambda r: r.g)
    assert [r.confidence for r in rows] == [b for _, b in p]
    assert [r.colour for r in rows] == ["green", "green", "green", "yellow", "yellow"]
    assert rows[0].heterogeneity.startswith("Low") and rows[3].heterogeneity.startswith("High")


def test_effect_conversions(spark):
    r = spark.range(1).select(effects.d_to_log_odds(F.lit(1.0)).alias("a"), effects.log_odds_ratio(F.lit(0), F.lit(10), F.lit(5), F.lit(5)).alias("b"),
                              effects.risk_ratio_to_log_odds(F.lit(20.0), F.lit(0.1)).alias("c")).first()
    assert r.a == pytest.approx(1.8138, abs=1e-4) and r.b == pytest.approx(math.log((5.5 / 5.5) / (0.5 / 10.5))) and r.c is None


def _t_tail(t, df):
    """Two-sided p-value by the finite sums for whole degrees of freedom."""
    th, c2 = math.atan(t / math.sqrt(df)), 1 / (1 + t * t / df)
    s = p = 1.0
    if df % 2:
        for k in range(1, (df - 3) // 2 + 1):
            p *= c2 * 2 * k / (2 * k + 1)
            s += p
        return 1 - 2 / math.pi * (th + (math.sin(th) * math.cos(th) * s if df > 1 else 0))
    for k in range(1, (df - 2) // 2 + 1):
        p *= c2 * (2 * k - 1) / (2 * k)
        s += p
    return 1 - math.sin(th) * s


def test_distributions_at_many_degrees_of_freedom():
    df = np.array([1.0, 2, 3, 10, 199, 200, 201, 202, 1_000, 5_001, 100_000])
    for t in (0.0, 0.3, 1.0, 1.72, 1.75, 2.5, 5.0):
        got = stats.student_p(np.full(len(df), t), df)
        assert got == pytest.approx([_t_tail(t, int(n)) for n in df], abs=1e-11)
    for n in (2, 4, 200, 202, 1_000, 5_000):
        for share in (0.05, 0.9, 1.0, 1.1, 2.0):
            x = n * share
            want = sum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(n // 2))
            assert stats.chi_square_q(np.array([x]), np.array([float(n)]))[0] == pytest.approx(want, abs=1e-11)
    q = stats.student_quantile(df, 0.95)
    assert q == pytest.approx([12.70620474, 4.30265273, 3.18244631, 2.22813885, 1.97195654, 1.97189622, 1.97183647, 1.97177728, 1.96233908, 1.96043856, 1.95998771], abs=2e-7)
    assert stats.student_p(q, df) == pytest.approx([0.05] * len(df), abs=1e-11)
    assert np.isnan(stats.student_p(np.array([1.0, np.nan]), np.array([0.0, 5.0]))).all()
    assert stats.chi_square_q(np.array([0.0, np.inf, 1e8]), np.array([3.0, 3.0, 1e8])) == pytest.approx([1, 0, 0.49998], abs=1e-5)


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(_Cluster)
    _Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        session.shared_folder(_Cluster)
    table = scale.settle(spark.range(3))
    assert table.count() == 3 and session.forget_intermediates(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(table.inputFiles()[0])


def test_files_and_headers(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", "x")], "study_id string, n string, g string").write.mode("append").option("header", True).partitionBy("g").csv(folder)
    spark.createDataFrame([("a", "y")], "study_id string, g string").write.mode("append").option("header", True).partitionBy("g").csv(folder)
    spark.createDataFrame([("torn", "z")], "value string, g string").write.mode("append").partitionBy("g").text(folder)
    lines = readers.file_lines(spark, folder).withColumn("source_file", F.regexp_extract("path", "g=([^/]+)/", 1))
    rows = readers.status_report(readers.checked_lines(lines, "study_id", ["n"], F.col("fields")["n"].cast("int") > 1)).collect()
    assert {(r.source_file, r.rows, r.valid_rows, r.status) for r in rows} == {("x", 1, 0, "Warning"), ("y", 1, 0, "Error"), ("z", 1, 0, "Error")}
    found = readers.experiment_files(spark, folder, "*.{csv,txt}").collect()
    assert len(found) == 3 and {r.suffix for r in found} == {".csv", ".txt"}
