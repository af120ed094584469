"""Sliced and blocked work gives what whole-group work gives, also for hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import feedback as fb, graph, plot, quality, retrieval, scale, vectors


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}", i, rnd.randrange(400), rnd.random()) for i in range(5000)]
    return spark.createDataFrame(rows, "k string, i int, v int, x double").cache()


def test_running_in_slices(hot):
    got = scale.running(hot, ["k"], ["v", "i"], {"n": F.lit(1).cast("long"), "s": F.col("x")})
    cut = scale.sliced(hot.repartition(4), ["k"], ["v", "i"])
    spans = cut.filter("k = 'hot'").groupBy("_slice").agg(F.min(F.struct("v", "i")).alias("a"), F.max(F.struct("v", "i")).alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
    w = Window.partitionBy("k").orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumns({"n2": F.count(F.lit(1)).over(w), "s2": F.sum("x").over(w)}).select("i", "n2", "s2")
    j = got.join(want, "i")
    assert j.count() == 5000 and j.filter((F.col("n") != F.col("n2")) | (F.abs(F.col("s") - F.col("s2")) > 1e-9)).count() == 0


def test_blocked_frames(hot):
    rows = scale.numbered(hot, ["k"], ["v", "i"])
    cut = scale.blocked(rows, ["k"], "rn", back=19, ahead=2, size=64)
    w = lambda *k: Window.partitionBy(*k).orderBy("rn").rowsBetween(-19, 2)
    a = cut.withColumn("m", F.avg("x").over(w("k", "_block"))).filter("_own")
    b = rows.withColumn("m2", F.avg("x").over(w("k"))).select("i", "m2")
    j = a.join(b, "i")
    assert j.count() == 5000 and j.filter(F.abs(F.col("m") - F.col("m2")) > 1e-12).count() == 0


def test_quantiles(hot):
    got = {r.k: (r.a, r.b) for r in scale.quantiles(hot, ["k"], "x", {"a": 0.25, "b": 0.5}).collect()}
    pdf = hot.toPandas()
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(tuple(np.percentile(g["x"], [25, 50])), abs=1e-12)


def test_large_tables_have_as_many_slices_as_their_rows_ask_for(hot, monkeypatch):
    monkeypatch.setattr(scale, "SLICE_ROWS", 100)
    assert scale.sliced(hot, ["k"], ["v", "i"]).select("_slice").distinct().count() > 30
    got = scale.numbered(hot, ["k"], ["v", "i"])
    w = Window.partitionBy("k").orderBy("v", "i")
    want = hot.select("i", F.row_number().over(w).cast("long").alias("rn2"))
    assert got.join(want, "i").filter("rn = rn2").count() == 5000


def test_outliers_leave_rows_where_they_are_read(hot):
    out = quality.iqr_outliers(hot, ["k"], "x", 0.1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    fence = {}
    for k, g in hot.toPandas().groupby("k"):
        a, b = np.percentile(g["x"], [25, 75])
        fence[k] = a - 0.1 * (b - a), b + 0.1 * (b - a)
    want = {r.i for r in hot.collect() if not fence[r.k][0] <= r.x <= fence[r.k][1]}
    assert {r.i for r in out.collect()} == want


def test_previous_values(spark):
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(6)] + [("b", 9, "z")], "s string, p int, t string")
    got = {(r.s, r.p): r.prev for r in scale.with_previous(df, ["s"], ["p"], "t", 3).collect()}
    assert got[("a", 0)] == [] and got[("a", 5)] == ["t2", "t3", "t4"] and got[("a", 1)] == ["t0"] and got[("b", 9)] == []


@pytest.mark.parametrize("rows", [4, 40, 10_000])
def test_vector_search_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", rows)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(1)
    base, ask = rng.normal(size=(150, 4)), rng.normal(size=(13, 4))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "qid long, vec array<double>")
    got = {}
    for r in retrieval.vector_top_k(q, b, 5, dim=4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(ask) @ unit(base).T
    for i in range(13):
        assert [x for _, x in sorted(got[i])] == np.argsort(-s[i])[:5].tolist()
    g = lambda df, key: df.withColumn("g", F.col(key) % 3)
    got = {}
    for r in retrieval.vector_top_k(g(q, "qid"), g(b, "id"), 5, dim=4, group="g").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    for i in range(13):
        same = [j for j in np.argsort(-s[i]).tolist() if j % 3 == i % 3]
        assert [x for _, x in sorted(got[i])] == same[:5]
    with pytest.raises(Exception, match="components"):
        retrieval.vector_top_k(q, b, 5, dim=3).collect()


def test_bm25_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 3)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") + "x" for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    post = retrieval.postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stats = retrieval.term_statistics(post).cache()
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["ax bx", "cx", "ax ax hx", "zz", "dx ex fx gx"])], "qid long, query string")
    idf = {r.term: (r.idf, r.avgdl) for r in stats.collect()}
    want = {}
    for q, t in asked.collect():
        for d, text in enumerate(texts):
            w = text.split()
            hit = [x for x in t.split() if x in w]
            if hit:
                gain = sum(idf[x][0] * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / idf[x][1])) for x in hit)
                want.setdefault(q, []).append((-round(gain, 9), d))
    got = {}
    for r in retrieval.bm25_top_k(asked, post, stats, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc, r.score))
    for q, hits in want.items():
        best = [(d, -s) for s, d in sorted(hits)[:4] if -s > 0]
        assert [(d, pytest.approx(s, abs=1e-8)) for _, d, s in sorted(got.get(q, []))] == best
    assert "zz" not in idf and 3 not in got


def test_adaptive_weights_equal_the_sequence(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(rnd.choice(["keyword", "keyword", "mixed"]), i, float(rnd.choice([1, 1, 2, 3, 5])), rnd.choice([0.2, 0.4, 0.5, 0.8]) if i % 300 < 150 else 0.3) for i in range(900)]
    state, seen = {"keyword": 0.3, "mixed": 0.5}, {"keyword": [], "mixed": []}
    for kind, _, rating, w in rows:
        seen[kind].append((rating / 5, w))
        last = seen[kind][-20:]
        if len(seen[kind]) >= 5 and round(sum(r for r, _ in last) / len(last), 9) < 0.6:
            hi, lo = [r for r, w in last if w > 0.5], [r for r, w in last if w <= 0.5]
            if hi and lo:
                up = round(sum(hi) / len(hi), 9) > round(sum(lo) / len(lo), 9)
                state[kind] = min(1.0, state[kind] + 0.1) if up else max(0.0, state[kind] - 0.1)
            else:
                state[kind] = 1 - state[kind]
    monkeypatch.setattr(retrieval, "blocked", lambda df, keys, pos, back=0, ahead=0: scale.blocked(df, keys, pos, back, ahead, size=50))
    df = spark.createDataFrame(rows, "kind string, i int, rating double, semantic_weight double")
    got = {r.kind: r.semantic_weight for r in retrieval.adaptive_weights(df, "kind", "i").collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in state.items()}


def test_learned_weights_equal_the_sequence(spark):
    rnd = random.Random(2)
    rows = [(s, i, rnd.choice(["unified", "graph", "hybrid"]), *[rnd.randrange(1, 6) for _ in range(5)], rnd.random() < 0.3) for i in range(400) for s in (1, 2)]
    names = "story long, seq long, approach string, overall long, consistency long, creativity long, character_authenticity long, plot_coherence long, selected_best boolean"
    want = {1: dict(fb.START), 2: dict(fb.START)}
    for r in rows:
        want[r[0]] = fb.step(want[r[0]], r[2], sum(r[3:8]) / 5, r[8])
    for r in fb.learned_weights(spark.createDataFrame(rows, names)).collect():
        assert r.n == 400 and (r.unified, r.graph, r.hybrid) == pytest.approx(tuple(want[r.story].values()), abs=1e-12)
        assert r.unified + r.graph + r.hybrid == pytest.approx(1)


def test_unmet_pairs(spark):
    nodes = spark.createDataFrame([(f"c{i}", "CHARACTER", f"n{i}", 1) for i in range(7)], "id string, type string, name string, first_appearance int")
    met = [("c0", f"c{i}") for i in range(1, 7)] + [("c1", "c2"), ("c3", "c1"), ("c1", "c4")]
    edges = spark.createDataFrame([(f"e{i}", a, b, "ALLIES_WITH", 0.5, 1) for i, (a, b) in enumerate(met)], "edge_id string, src string, dst string, relation string, strength double, chapter int")
    known = {tuple(sorted(p)) for p in met}
    want = [(f"c{i}", f"c{j}") for i in range(7) for j in range(i + 1, 7) if (f"c{i}", f"c{j}") not in known]
    for n in (1, 3, 6, 50):
        assert [(r.a, r.b) for r in plot.unmet_pairs(nodes, edges, 5, n).collect()] == want[:n]


def test_paths_against_search(spark):
    rnd = random.Random(9)
    e = {(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}"): round(rnd.uniform(.4, 1), 3) for _ in range(26)}
    e = {k: v for k, v in e.items() if k[0] != k[1]}
    edges = spark.createDataFrame([(f"{i:03}", a, b, "ALLIES_WITH", w, 1) for i, ((a, b), w) in enumerate(e.items())], "edge_id string, src string, dst string, relation string, strength double, chapter int")

    def walk(path, w, top):
        if len(path) > 2:
            yield tuple(path), w
        if len(path) <= top:
            for (a, b), s in e.items():
                if a == path[-1] and b not in path:
                    yield from walk(path + [b], w * s, top)

    every = {p: w for i in range(9) for p, w in walk([f"n{i}"], 1.0, 4)}
    starts = spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")
    got = {tuple(r.path) for r in graph.indirect_paths(starts, edges).collect()}
    assert got == {p for p, w in every.items() if len(p) <= 4 and round(w, 9) >= 0.3}
    pairs = spark.createDataFrame([("n0", "n5"), ("n3", "n1")], "a string, b string")
    got = {tuple(r.path): r.weight for r in graph.hidden_connections(pairs, edges).collect()}
    want = {p: w for p, w in every.items() if (p[0], p[-1]) in {("n0", "n5"), ("n3", "n1")}}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_postings_of_repeated_keys(spark):
    """Rows of one key and length count together, a null key too; others are counted where they are read."""
    from collections import Counter

    from strataline.operators import retrieval

    rows = [(1, "a b a"), (1, "a c c"), (1, "a"), (2, "b  B\tc"), (None, "x y"), (None, "y x"), (3, ""), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter()
    for d, x in rows:
        ws = (x or "").lower().split()
        for w in ws:
            want[d, len(ws), w] += 1
    got = retrieval.postings(docs).collect()
    assert len(got) == len(want) and {(r.doc, r.dl, r.term): r.tf for r in got} == want
    assert "hashpartitioning" not in retrieval.postings(docs.filter("doc_id = 2"))._jdf.queryExecution().executedPlan().toString()


def test_no_task_gathers_an_index_bucket(spark, tmp_path):
    import glob

    from strataline.sources import sinks

    post = spark.createDataFrame([(i, 3, f"t{i % 7}", 1) for i in range(400)], "doc long, dl int, term string, tf long").repartition(4)
    one = spark.createDataFrame([("t1", 1, 2.0)], "term string, df long, idf double")
    sinks.save_index(post, one, one, str(tmp_path), 2)
    assert all(len(glob.glob(f"{tmp_path}/postings/bucket={b}/*.parquet")) == 4 for b in (0, 1))
    assert sorted(map(tuple, sinks.load_index(spark, str(tmp_path))[0].collect())) == sorted(map(tuple, post.collect()))


def test_paths_carry_the_names_of_their_nodes(spark):
    edges = spark.createDataFrame([(f"e{a}{b}", a, b, "KNOWS", 0.9) for a, b in ("ab", "bc", "cd", "bx")], "edge_id string, src string, dst string, relation string, strength double")
    names = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C1"), ("c", "C2"), ("d", None), ("e", "E")], "id string, name string")
    out = graph.indirect_paths(names.filter("id = 'a'").select("id"), edges, 3, 0.3, names)
    # x has no name row, so its path goes, as with a join of every node; two rows of c give two.
    got = sorted((r.path, r.names) for r in out.collect())
    assert got == [(["a", "b", "c"], ["A", "B", "C1"]), (["a", "b", "c"], ["A", "B", "C2"]),
                   (["a", "b", "c", "d"], ["A", "B", "C1", None]), (["a", "b", "c", "d"], ["A", "B", "C2", None])]
