"""Bounds that drop work before it is shipped, hubs in parts, decisions in event time: against brute force."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import graph, retrieval, vectors
from strataline.streaming import jobs


def clustered(rng, n, dim, centres=12, spread=0.05):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def frames(spark, base, ask, extra=None):
    b = spark.createDataFrame([(i, v.tolist(), *(extra[0][i] if extra else ())) for i, v in enumerate(base)], "id long, vec array<double>" + (", at double, g int" if extra else ""))
    q = spark.createDataFrame([(i, v.tolist(), *(extra[1][i] if extra else ())) for i, v in enumerate(ask)], "qid long, vec array<double>" + (", at double, g int" if extra else ""))
    return q, b


def ranked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.qid].append(r.id)
    return dict(out)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_blocks_that_cannot_count_are_not_shipped(spark, monkeypatch, metric):
    """On clustered vectors fewer than half of the block pairs pass the bound, and the result stays exact, ties and repeats included."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(4)
    base, ask = clustered(rng, 1500, 6), None
    base[100:140] = base[100]
    ask = np.concatenate([base[::17], np.zeros((2, 6))])
    q, b = frames(spark, base, ask)
    s = vectors.scores(base, ask, metric)
    want = {i: sorted(range(len(base)), key=lambda j: (-s[i, j], j))[:7] for i in range(len(ask))}
    assert ranked(vectors.vector_top_k(q, b, 7, metric, dim=6).collect()) == want
    asked, held = vectors.usable(q.filter("qid < 85"), "qid", 6, None, None), vectors.usable(b, "id", 6, None, None)
    pivots = vectors.pivots_of(held, metric, 6)
    qb, bb = vectors.blocks(asked, pivots, metric, 20), vectors.blocks(held, pivots, metric, 60)
    first = vectors.nearest_blocks(qb, bb, metric)
    seeds = vectors._searched(first, qb, bb, 7, metric, 6, None)
    rest = vectors.reaching_blocks(qb, bb, vectors._floors(qb, first, seeds, 7), metric).count()
    every = qb.count() * bb.count()
    print(f"{metric}: {rest + qb.count()} of {every} block pairs shipped")
    assert rest + qb.count() < every / 2


def test_groups_and_ages(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 15)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(5)
    base, ask = clustered(rng, 300, 3, 4), clustered(rng, 40, 3, 4)
    extra = [[(float(rng.integers(0, 50)), int(rng.integers(0, 3))) for _ in x] for x in (base, ask)]
    q, b = frames(spark, base, ask, extra)
    s = vectors.scores(base, ask, "cosine")
    want = {}
    for i in range(len(ask)):
        (t, g) = extra[1][i]
        able = [j for j in range(len(base)) if extra[0][j][1] == g and 0 <= t - extra[0][j][0] <= 10]
        if able:
            want[i] = sorted(able, key=lambda j: (-s[i, j], j))[:4]
    assert ranked(vectors.vector_top_k(q, b, 4, dim=3, group="g", max_age=10.0).collect()) == want


def test_vector_search_without_rows(spark):
    q, b = frames(spark, np.ones((2, 3)), np.ones((2, 3)))
    assert vectors.vector_top_k(q.limit(0), b, 2, dim=3).count() == 0 and vectors.vector_top_k(q, b.limit(0), 2, dim=3).count() == 0
    assert vectors.vector_top_k(q, b.withColumn("vec", F.lit(None).cast("array<double>")), 2, dim=3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for metric in ("cosine", "l2"):
        for _ in range(50):
            q, x = (rng.normal(size=(9, 5)) * rng.choice([0.01, 1, 100]) + rng.normal(size=5) * rng.choice([0, 3]) for _ in range(2))
            if metric == "cosine":
                q, x = vectors.unit(q), vectors.unit(x)
            ball = lambda m: (m.mean(0)[None], np.array([np.linalg.norm(m - m.mean(0), axis=1).max()]))
            assert vectors.scores(x, q, metric).max() <= vectors.bounds(*ball(q), *ball(x), metric)[0, 0]


def test_bm25_blocks_below_the_floor_are_left_out(spark, monkeypatch):
    """Rare words of few documents set high floors, so the many blocks of common words are not visited; all first hits are the same."""
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 10)
    rnd = random.Random(8)
    texts = [" ".join(["common", *rnd.choices("abcdefgh", k=rnd.randint(2, 9)), *([f"rare{i % 9}"] * (3 if i < 60 else 0))]) for i in range(400)]
    post = retrieval.postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    stats = retrieval.term_statistics(post).cache()
    queries = spark.createDataFrame([(i, f"common rare{i}") for i in range(9)] + [(20, "a b"), (21, "none"), (22, "common")], "qid long, query string")
    seen = []
    inner = retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))
    got = defaultdict(list)
    for r in retrieval.bm25_top_k(queries, post, stats, 3).collect():
        got[r.qid].append((r["rank"], r.doc))
    idf = {r.term: (r.idf, r.avgdl) for r in stats.collect()}
    for i, text in queries.collect():
        scored = []
        for d, t in enumerate(texts):
            w = t.split()
            gain = sum(idf[x][0] * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / idf[x][1])) for x in text.split() if x in w)
            if round(gain, 9) > 0:
                scored.append((-round(gain, 9), d))
        assert [d for _, d in sorted(got[i])] == [d for _, d in sorted(scored)[:3]]
    blocks = 40
    assert seen[0] <= 11 * retrieval.FIRST_BLOCKS and seen[0] + seen[1] < 11 * blocks / 2, seen


def test_stored_index_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(path)
    first = retrieval.stored_index(spark.read.parquet(path))
    again = retrieval.stored_index(spark.read.parquet(path))
    assert sorted(first[0].inputFiles()) == sorted(again[0].inputFiles())
    assert sorted(map(tuple, first[1].select("term", "df").collect())) == sorted(map(tuple, again[1].select("term", "df").collect())) == [("a", 1), ("b", 2), ("c", 1)]
    spark.createDataFrame([(3, "d")], "doc_id long, text string").write.mode("append").parquet(path)
    assert {r.term for r in retrieval.stored_index(spark.read.parquet(path))[1].collect()} == {"a", "b", "c", "d"}


def test_hub_is_expanded_in_parts(spark):
    """A star of a million edges: the largest task of the join that expands the hub reads at most three times the median."""
    edges = spark.range(1_000_000).select(F.lit("hub").alias("node"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("next"))
    parts, directory = graph.split(edges, "node")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = graph.expand(spark.createDataFrame([("s", "hub")], "start string, node string"), parts, directory, "node")
        n = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(n) == 1_000_000 and max(n) <= 3 * np.median(n)


EDGES = "edge_id string, src string, dst string, relation string, strength double, chapter int"


def brute_paths(edges, starts, hops, least):
    first = {}
    for e in sorted(edges):
        first.setdefault((e[1], e[2]), (e[3], e[4]))
    out, front = [], [((s,), 1.0) for s in starts]
    for h in range(hops):
        front = [((*p, b), w * k) for p, w in front for (a, b), (_, k) in first.items() if a == p[-1] and b not in p]
        out += [(p, w) for p, w in front if h and round(w, 9) >= least]
    return out


@pytest.mark.parametrize("top", [1.0, 2.5])
def test_paths_with_any_strengths(spark, top):
    """Strengths above one lift weak prefixes again; both forms hold the same paths."""
    rnd = random.Random(int(top * 10))
    names = [f"v{i}" for i in range(9)]
    edges = [(f"{i:03}", *rnd.sample(names, 2), rnd.choice("RS"), round(rnd.choice([0.1, 0.5, 1.0]) * rnd.uniform(0.2, top), 3), 1) for i in range(45)]
    e, starts = spark.createDataFrame(edges, EDGES), names[:5]
    s = spark.createDataFrame([(n,) for n in starts], "id string")
    want = brute_paths(edges, starts, 4, 0.3)
    got = [(tuple(r.path), r.weight) for r in graph.indirect_paths(s, e, 4, 0.3).collect()]
    assert sorted(p for p, _ in got) == sorted(p for p, _ in want) and dict(got) == pytest.approx(dict(want))
    table = {(r.source, r.target, r.hops, r.pred): (r.n_paths, r.best) for r in graph.path_table(s, e, 4, 0.3).collect()}
    count, best = Counter((p[0], p[-1], len(p) - 1, p[-2]) for p, _ in want), {}
    for p, w in want:
        k = (p[0], p[-1], len(p) - 1, p[-2])
        best[k] = max(best.get(k, 0), w)
    assert {k: n for k, (n, _) in table.items()} == count and {k: w for k, (_, w) in table.items()} == pytest.approx(best)


@pytest.mark.parametrize("rows", [2, 100_000])
def test_path_table_with_hubs(spark, monkeypatch, rows):
    """Hubs on either side of a join, parallel edges, loops, missing strengths and null ends, by weak and strong paths."""
    monkeypatch.setattr(graph, "HUB_ROWS", rows)
    rnd = random.Random(17)
    names = [f"v{i:02}" for i in range(24)]
    pairs = [tuple(rnd.choice(names) for _ in range(2)) for _ in range(30)] + [("v03", x) for x in names[12:22]] + [(x, "v03") for x in names[4:12]]
    edges = [(f"{i:03}", a, b, rnd.choice("RS"), rnd.choice([None, 0.6, 0.75, 0.9, 1.0]), 1) for i, (a, b) in enumerate(pairs + pairs[::4])]
    e = spark.createDataFrame([*edges, ("x", None, "v01", "R", 0.9, 1), ("y", "v01", None, "R", 0.9, 1)], EDGES)
    want = brute_paths([(*x[:4], 0.5 if x[4] is None else x[4], 1) for x in edges], names[:15], 4, 0.3)
    got = graph.path_table(spark.createDataFrame([(n,) for n in names[:15]], "id string"), e, 4, 0.3).collect()
    key = lambda p: (p[0], p[-1], len(p) - 1, p[-2])
    count, best = Counter(key(p) for p, _ in want), {}
    for p, w in want:
        best[key(p)] = max(best.get(key(p), 0), w)
    assert len(got) == len(count) > 100 and max(count.values()) > 1
    assert {(r.source, r.target, r.hops, r.pred): r.n_paths for r in got} == count and {(r.source, r.target, r.hops, r.pred): r.best for r in got} == pytest.approx(best)


def test_path_table_writes_no_paths(spark, monkeypatch):
    """Sixty nodes by way of one to sixty others: 3,600 paths from 120 edges, none of them written on the way or shuffled to be counted."""
    written, real = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, *a: written.append(real(df, *a)) or written[-1])
    edges = spark.createDataFrame([(f"i{i}", f"a{i}", "m", "R", 0.9, 1) for i in range(60)] + [(f"o{i}", "m", f"b{i}", "R", 0.9, 1) for i in range(60)] + [("z", "b0", "c", "R", 0.9, 1)], EDGES)
    out = graph.path_table(spark.createDataFrame([(f"a{i}",) for i in range(60)], "id string"), edges)
    assert Counter((r.hops, r.n_paths) for r in out.collect()) == {(2, 1): 3600, (3, 1): 60}
    assert sum(df.count() for df in written) < 1000 and "hashpartitioning(source" not in out._jdf.queryExecution().executedPlan().toString()


def test_revealed_connections_count_the_pairs(spark):
    rnd = random.Random(9)
    names = [f"v{i:02}" for i in range(25)]
    e = spark.createDataFrame([(str(i), *rnd.sample(names, 2), "R", 0.5, 1) for i in range(35)], EDGES)
    nodes = spark.createDataFrame([(n, "CHARACTER" if i % 4 else "EVENT", n, 1) for i, n in enumerate(names)], "id string, type string, name string, first_appearance int")
    pairs = [(r.a, r.b) for r in graph.hidden_links(nodes, e).collect()]
    other = defaultdict(set)
    for a, b in pairs:
        other[a].add(b)
        other[b].add(a)
    got = {r.id: (r.n_links, r.least) for r in graph.revealed_connections(nodes, e).collect()}
    assert len(set(pairs)) == len(pairs) > 10 and got == {k: (len(v), min(v)) for k, v in other.items()}


NODES = "id string, type string, name string, first_appearance int"


def brute_hidden(chars, pairs):
    """Pairs of characters that no edge joins and a walk of two or three edges from the lesser one does."""
    after = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            after[a].add(b)
    on = lambda found: {y for x in found for y in after[x]}
    return {(a, b) for a in chars for b in on(after[a]) | on(on(after[a])) if a < b and b in chars and b not in after[a] and a not in after[b]}


@pytest.mark.parametrize("rows", [2, 100_000])
def test_hidden_links_with_hubs(spark, monkeypatch, rows):
    """Hubs on either side of a join, parallel edges, loops, null ends and repeated nodes."""
    monkeypatch.setattr(graph, "HUB_ROWS", rows)
    rnd = random.Random(31)
    names = [f"v{i:02}" for i in range(40)]
    pairs = [tuple(rnd.choice(names) for _ in range(2)) for _ in range(45)] + [("v03", x) for x in names[20:36]] + [(x, "v03") for x in names[4:16]]
    pairs += pairs[:9] + [(None, "v01"), ("v01", None), ("zz", "v02")]
    chars = {n for i, n in enumerate(names) if i % 4}
    nodes = [(n, "CHARACTER" if n in chars else "EVENT", n, 1) for n in names + names[:6]] + [(None, "CHARACTER", None, 1)]
    got = [(r.a, r.b) for r in graph.hidden_links(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(str(i), a, b, "R", 0.5, 1) for i, (a, b) in enumerate(pairs)], EDGES)).collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == brute_hidden(chars, pairs)


def test_revealed_connections_write_only_edges_between_characters(spark, monkeypatch):
    """Edges to events from which no character is reached are neither written nor shuffled."""
    written, real = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, *a: written.append(real(df, *a)) or written[-1])
    chars = [f"c{i}" for i in range(5)]
    pairs = [*zip(chars, chars[1:])] + [(chars[i % 5], f"o{i}") for i in range(3000)] + [(f"o{i}", f"o{i + 1}") for i in range(2999)]
    nodes = spark.createDataFrame([(n, "CHARACTER", n, 1) for n in chars] + [(f"o{i}", "EVENT", "", 1) for i in range(3000)], NODES)
    edges = spark.createDataFrame([(str(i), a, b, "R", 0.5, 1) for i, (a, b) in enumerate(pairs)], EDGES)
    got = {r.id: (r.n_links, r.least) for r in graph.revealed_connections(nodes, edges).collect()}
    assert got == {"c0": (2, "c2"), "c1": (2, "c3"), "c2": (2, "c0"), "c3": (2, "c0"), "c4": (2, "c1")}
    assert max(df.count() for df in written) < 100


def test_plot_complications_shuffle_a_node_once(spark):
    """Of an event's many edges one row is shuffled to tell that it has a consequence; events without one are all found."""
    nodes = spark.createDataFrame([(f"o{i}", "EVENT", "", 1) for i in range(30)] + [("o3", "EVENT", "", 1), ("c1", "CHARACTER", "", 1)], NODES)
    edges = spark.createDataFrame([(f"{i}", f"o{i % 20}", f"x{i}", "R", 0.5, 1) for i in range(4000)] + [("a", "o25", "o25", "R", 0.5, 1), ("b", None, "o26", "R", 0.5, 1), ("c", "o27", None, "R", 0.5, 1)], EDGES).coalesce(2)
    out = graph.plot_complications(nodes, edges).filter("kind = 'unresolved_event'")
    assert sorted(r.first for r in out.collect()) == [f"o{i}" for i in range(20, 30)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftAnti(.|\n)*Aggregate \[\w+#", plan)


def test_small_groups_stay_whole(spark, monkeypatch):
    """Many small groups need no pivots and no parts: a block per group, each ball met once."""
    from strataline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "CHUNK", 8)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), float(i), i // 10) for i in range(200)], "id long, vec array<double>, at double, slot long")
    held = vectors.usable(rows, "id", 4, "slot", 100.0)
    pivots = vectors.pivots_of(held, "cosine", 4)
    assert len(pivots) == 1
    packed = vectors.blocks(held, pivots, "cosine", 16)
    assert packed.groupBy("grp").count().count() == packed.count() == 20
    seen = vectors._meeting(packed.select(*vectors._BALL), packed, lambda q, b: q[["blk"]].assign(n=len(q) * len(b)), "blk long, n long").collect()
    assert len(seen) == 20 and all(r.n == 1 for r in seen)


def test_hits_leave_a_slice_once(spark, monkeypatch):
    """Sixty base blocks in a few slices: a query leaves a slice with k hits, not one list per block, and the hits are exact."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 4))
    q, b = (vectors.usable(d, n, 4, None, None) for d, n in zip(frames(spark, base, base[::6]), ("qid", "id")))
    pivots = vectors.pivots_of(b, "l2", 4)
    qb, bb = vectors.blocks(q, pivots, "l2", 20), vectors.blocks(b, pivots, "l2", 10)
    pairs = qb.select(F.col("blk").alias("qblk")).crossJoin(bb.select(F.col("blk").alias("bblk")))
    groups, slices = vectors._grid(qb, bb, 4)
    rows = vectors._searched(pairs, qb, bb, 3, "l2", 4, None).collect()
    assert bb.count() >= 60 > slices and len(rows) <= 100 * 3 * slices
    s = vectors.scores(base, base[::6], "l2")
    for i in range(100):
        assert [r.id for r in sorted((r for r in rows if r.qid == i), key=lambda r: (-r.score, r.id))[:3]] == sorted(range(600), key=lambda j: (-s[i, j], j))[:3]


def test_plot_complications_have_every_pair(spark):
    rnd = random.Random(9)
    names = [f"v{i:02}" for i in range(25)]
    e = spark.createDataFrame([(str(i), *rnd.sample(names, 2), "R", 0.5, 1) for i in range(35)], EDGES)
    nodes = spark.createDataFrame([(n, "CHARACTER" if i % 4 else "EVENT", n, 1) for i, n in enumerate(names)], "id string, type string, name string, first_appearance int")
    pairs = {(r.a, r.b) for r in graph.hidden_links(nodes, e).collect()}
    got = [(r.first, r.second) for r in graph.plot_complications(nodes, e).filter("kind = 'reveal_connection'").collect()]
    assert len(got) == len(pairs) > 10 and set(got) == pairs


# Streams


def brute_admitted(rows, limit, window):
    held, out = defaultdict(list), {}
    for i, t, u in sorted(rows, key=lambda r: (r[1], r[0])):
        if u is None:
            continue
        held[u] = [h for h in held[u] if (t - h).total_seconds() < window]
        out[i] = len(held[u]) < limit
        if out[i]:
            held[u].append(t)
    return out


def brute_hits(rows, ttl):
    born, out = {}, {}
    for i, t, u in sorted(rows, key=lambda r: (r[1], r[0])):
        if u is not None:
            out[i] = u in born and (t - born[u]).total_seconds() <= ttl
            if not out[i]:
                born[u] = t
    return out


SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


def streamed(spark, path, parts, job):
    """Parts as files in the given order, one per micro-batch, and a last row far ahead that only moves the watermark."""
    last = max(r[1] for p in parts for r in p)
    for k, p in enumerate([*parts, [(None, last + dt.timedelta(days=9), None)]]):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        jobs.drain(job(spark.readStream.schema(SCHEMA).parquet(f"{path}/in")), f"{path}/run")
    return spark.read.parquet(f"{path}/run/out").collect()


@pytest.mark.parametrize("files", [1, 7])
def test_decisions_do_not_depend_on_files(spark, tmp_path, files):
    """Rows of 7 files in shuffled order, with ties and one very busy key, are decided as if they had come in order."""
    rnd = random.Random(12)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.randrange(0, 3600)), rnd.choice([1, 1, 1, 2, 3, None])) for i in range(400)]
    rnd.shuffle(rows)
    parts = [rows[k::files] for k in range(files)]
    got = streamed(spark, str(tmp_path / "a"), parts, lambda s: jobs.admissions(s, "user_id", 2, 60.0, delay="2 hours", grain=300.0))
    assert len(got) == len({r["row"] for r in got}) and {r["row"]: r.admitted for r in got} == brute_admitted(rows, 2, 60.0)
    got = streamed(spark, str(tmp_path / "b"), parts, lambda s: jobs.ttl_cache(s, "user_id", 120.0, delay="2 hours", grain=45.0))
    assert {r["row"]: r.hit for r in got} == brute_hits(rows, 120.0)


def test_waiting_rows_and_memory_are_forgotten(spark, tmp_path):
    """Rows wait until the watermark has passed them; later ones than the delay are dropped; the store is empty in the end."""
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    path = str(tmp_path)
    job = lambda: jobs.admissions(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), "user_id", 1, 50.0, delay="100 seconds", grain=10.0)
    seen = []
    for part in ([(1, at(0), 7), (2, at(30), 7), (3, at(300), 7)], [(4, at(290), 7), (5, at(40), 7)], [(6, at(5000), 8)], [(None, at(90000), None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = jobs.drain(job(), f"{path}/run")
        seen.append({r["row"]: r.admitted for r in spark.read.parquet(f"{path}/run/out").collect()})
    assert seen == [{1: True, 2: False}, {1: True, 2: False}, {1: True, 2: False, 4: True, 3: False}, {1: True, 2: False, 4: True, 3: False, 6: True}]
    spark.createDataFrame([(None, at(99000), None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    q = jobs.drain(job(), f"{path}/run")
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_state_follows_buckets(spark, tmp_path):
    """Many keys of one slot wait in the rows of their buckets, and decisions are those of the plain rule."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i % 50), i % 300) for i in range(600)]
    path = str(tmp_path)
    job = lambda: jobs.admissions(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), "user_id", 1, 20.0, delay="1 hour", grain=3600.0, buckets=5)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in")
    q = jobs.drain(job(), f"{path}/run")
    assert 0 < q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 100
    spark.createDataFrame([(None, base + dt.timedelta(days=1), None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    jobs.drain(job(), f"{path}/run")
    assert {r["row"]: r.admitted for r in spark.read.parquet(f"{path}/run/out").collect()} == brute_admitted(rows, 1, 20.0)


def test_memory_outlives_a_slot_that_is_not_decided(spark, tmp_path):
    """What a key remembers ends inside the slot that waits; the slot's earlier rows still meet it."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=s), 7) for i, s in enumerate([140, 161, 182, 203, 224, 400])]
    got = streamed(spark, str(tmp_path), [[r] for r in rows], lambda s: jobs.admissions(s, "user_id", 2, 60.0, delay="10 seconds", grain=60.0))
    assert {r["row"]: r.admitted for r in got} == brute_admitted(rows, 2, 60.0)


@pytest.mark.parametrize("files", [1, 3])
def test_table_stream_reads_file_and_folder(spark, tmp_path, files):
    """A table that is a folder of files is streamed as a table that is one file."""
    path = str(tmp_path)
    df = spark.createDataFrame([(i, f"mail a{i}@b.org") for i in range(30)], "doc_id long, text string")
    df.repartition(files).write.parquet(f"{path}/made")
    if files == 1:
        import glob
        import shutil
        shutil.copy(glob.glob(f"{path}/made/*.parquet")[0], f"{path}/documents.parquet")
    else:
        df.repartition(files).write.parquet(f"{path}/documents.parquet")
    df.limit(1).write.parquet(f"{path}/other.parquet")
    jobs.drain(jobs.redacted(jobs.table_stream(spark, path, "documents"), "doc_id", "text"), f"{path}/run")
    got = spark.read.parquet(f"{path}/run/out").collect()
    assert sorted(r.doc_id for r in got) == list(range(30)) and all(r.findings == 1 for r in got)
