"""Sources, cleaning, text, streaming and the driver contract."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataline.operators import coherence, experiments as ex, textprep, graph
from strataline.sources import readers, sinks
from strataline.streaming import jobs

from conftest import SF


def test_two_row_csv(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "ab_one.csv").write_text("experiment_id,experiment_name,control_visitors,control_conversions,treatment_visitors,treatment_conversions,segment\n"
                                  "e1,A,1000,100,1000,120,NA\ne2,B,2000,200,2000,210,EU\n")
    raw = readers.experiment_csv(spark, str(d))
    assert {(r.segment, r.source_file) for r in raw.collect()} == {("NA", "ab_one"), ("EU", "ab_one")}
    rows = {r.experiment_id: r for r in ex.derive_studies(ex.map_experiments(raw)).collect()}
    assert len(rows) == 2 and rows["e1"].control_total == 1000 and rows["e1"].effect > 0
    files = readers.experiment_files(spark, str(d)).collect()
    assert files[0].name == "ab_one.csv" and files[0].suffix == ".csv"


def test_cleaning_case(spark):
    df = spark.createDataFrame([("x", "100", "10", "100", "15"), ("y", "200", "20", "200", "250"), ("z", "0", "15", "150", "20"), ("w", "bad", "1", "5", "1")],
                               "campaign string, control_users string, control_success string, treatment_users string, treatment_success string")
    assert [r.experiment_name for r in ex.clean_import(df).collect()] == ["x"]
    with pytest.raises(ValueError):
        ex.clean_import(df.select("campaign"))
    with pytest.raises(ValueError):
        ex.map_experiments(df.select("campaign"))


def test_text_files_and_ledger(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"doc{i}.txt").write_text(f"Topic {i}\nline two")
    docs = readers.text_files(spark, str(tmp_path))
    assert sorted(r.source_file for r in docs.collect()) == ["doc0.txt", "doc1.txt", "doc2.txt"]
    h = readers.file_hashes(spark, str(tmp_path / "d0"))
    assert readers.changed(h, h).count() == 0 and readers.changed(h, h.limit(0)).count() == 1


def test_feedback_and_csv_sink(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"feedback": [{"chapter": 1, "approach": "graph", "ratings": {"overall": 4, "consistency": 5}, "selected_best": true}], "weights": {"unified": 0.3}}')
    r = readers.feedback_json(spark, str(tmp_path / "f.json")).first()
    assert (r.approach, r.overall, r.consistency) == ("graph", 4, 5)
    sinks.csv(spark.createDataFrame([(1, 'a "q", b')], "n int, t string"), str(tmp_path / "o"), ["t", "n"])
    assert readers.instruction_csv(spark, str(tmp_path / "o"), "t", "n").first().instruction == 'a "q", b'


def test_recursive_chunks():
    text = "\n\n".join("".join(f"Sentence number {i * 100 + j} is here. " for j in range(i)) for i in range(60)) + "".join(chr(0x4E00 + i) for i in range(2500))
    parts = textprep.recursive_pieces(text)
    assert all(0 < len(p) <= 1000 for p in parts)
    squeeze = lambda s: "".join(s.split())
    at = 0
    whole = squeeze(text)
    for p in parts:  # every piece occurs in order, nothing between pieces is lost
        i = whole.find(squeeze(p), max(0, at - len(squeeze(p))))
        assert 0 <= i <= at
        at = max(at, i + len(squeeze(p)))
    assert at == len(whole)


def test_table_function(spark):
    from strataline.functions.tables import register

    register(spark)
    rows = spark.sql("SELECT c.* FROM (SELECT repeat('word and more. ', 20) AS t) d, LATERAL recursive_chunks(d.t, 100, 20) c ORDER BY 1").collect()
    assert len(rows) > 2 and all(len(r.text) <= 100 for r in rows)


def test_redaction(spark):
    key = "sk-" + "a1" * 16
    text, n = textprep.redact(F.col("t"))
    r = spark.createDataFrame([(f"mail a.b@c.org, call +1 555-123-4567, {key}, 10.0.0.1, 123-45-6789 [REDACTED_EMAIL]",)], "t string").select(text.alias("t"), n.alias("n")).first()
    assert r.n == 5 and "a.b@c" not in r.t and key not in r.t and "[REDACTED_SSN]" in r.t and r.t.count("[REDACTED_EMAIL]") == 2


def test_lcs():
    def slow(a, b):
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        return dp[-1][-1]

    import random
    rnd = random.Random(4)
    for _ in range(200):
        a, b = [[rnd.choice("abcde") for _ in range(rnd.randrange(1, 30))] for _ in "xy"]
        assert coherence._lcs(a, b) == slow(a, b)


def test_causal_chain_cycle(spark):
    e = spark.createDataFrame([("1", "a", "b", "CAUSED_BY", .5, 1), ("2", "b", "c", "CAUSED_BY", .5, 1), ("3", "c", "d", "CAUSED_BY", .5, 1), ("4", "d", "c", "CAUSED_BY", .5, 1)],
                              "edge_id string, src string, dst string, relation string, strength double, chapter int")
    rows = graph.causal_chains(spark.createDataFrame([("d",), ("a",)], "id string"), e).collect()
    assert [(r.root_cause, r.depth) for r in rows] == [("a", 3)]


def test_admissions_over_micro_batches(spark, tmp_path):
    import datetime as dt
    import time

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=7 * i), i % 3) for i in range(120)]
    for part in (rows[:50], rows[50:], [(None, base + dt.timedelta(days=1), None)]):  # the last row moves the watermark past all others
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.drain(jobs.admissions(s, "user_id", 2, 60.0), str(tmp_path / "run"))
    got = {r["row"]: r.admitted for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}
    held = {0: [], 1: [], 2: []}
    for i, t, u in rows:
        held[u] = [h for h in held[u] if (t - h).total_seconds() < 60]
        ok = len(held[u]) < 2
        if ok:
            held[u].append(t)
        assert got[i] == ok


def test_ttl_rule():
    assert jobs.expire([0, 100, 3600, 3601, 7000], None, 3600) == ([False, True, True, False, True], 3601)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 220


SAMPLE = ["m8_compare_models", "p19_request_classes", "v7_js_distance", "r6_prefix_fusion", "t3_semantic_chunks", "g23_conflict_triangles", "n25_tropes", "l3_latency", "st2_tumbling"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_sql(spark, name):
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    line = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert line(got) == line(want)


def test_projection_is_that_of_the_covariance(spark):
    """The two columns are the coordinates on the two greatest eigenvectors, found by power iteration, up to sign."""
    from strataline.operators.retrieval import projection

    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    got = {r.vec_id: (r.x, r.y) for r in projection(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    cov, axes = np.cov(m.T), []
    for _ in range(2):
        v = np.ones(6)
        for _ in range(500):
            v = cov @ v
            v /= np.linalg.norm(v)
        axes.append(v)
        cov = cov - (v @ cov @ v) * np.outer(v, v)
    for k, v in enumerate(axes):
        mine = np.array([got[i][k] for i in range(len(m))])
        assert np.allclose(mine, m @ v, atol=1e-6) or np.allclose(mine, -(m @ v), atol=1e-6)


def chunks_by_index(text, size, overlap, separators):
    """The same chunks from running lengths: runs of parts that fit are windows over an index, parts that don't are cut finer."""
    k = next(i for i, s in enumerate(separators) if not s or s in text)
    sep = separators[k]
    cuts, i = [0], 0
    while i < len(text):
        if text.startswith(sep, i):
            cuts.append(i)
        i += max(1, len(sep)) if text.startswith(sep, i) else 1
    parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if b > a]
    out, first = [], 0
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    last = 0
    while last < len(parts):
        if len(parts[last]) > size:
            out += [x for x in ["".join(parts[first:last]).strip()] if x] + chunks_by_index(parts[last], size, overlap, separators[k + 1:])
            first = last = last + 1
            continue
        if ends[last + 1] - ends[first] > size:
            out += [x for x in ["".join(parts[first:last]).strip()] if x]
            while first < last and (ends[last] - ends[first] > overlap or ends[last + 1] - ends[first] > size):
                first += 1
        last += 1
    return out + [x for x in ["".join(parts[first:last]).strip()] if x]


def test_recursive_chunks_by_index(spark):
    import random

    from strataline.functions.tables import register
    from strataline.operators.textprep import SEPARATORS, recursive_chunks

    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["word", "a", "longerword", " ", " ", "\n", ". ", "é"]) + rnd.choice(["", " ", "\n" * rnd.choice([1, 1, 3])]) for _ in range(rnd.choice([0, 3, 60]))) for _ in range(60)] + ["x" * 90, None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, n, c) for i, t in enumerate(texts) if t for n, c in enumerate(chunks_by_index(t, 30, 10, SEPARATORS))}
    assert {tuple(r) for r in recursive_chunks(docs, size=30, overlap=10).collect()} == want
    register(spark)
    docs.createOrReplaceTempView("chunk_docs")
    assert {tuple(r) for r in spark.sql("SELECT doc_id, c.chunk_index, c.text FROM chunk_docs, LATERAL recursive_chunks(chunk_docs.text, 30, 10) c").collect()} == want


def test_conversations_are_read_in_bounded_tasks(spark, tmp_path):
    """A file of many turns is one split; its text work is dealt to tasks of so many turns, not to one per core."""
    from strataline.plans.relations import TURNS, Tables

    n = 5 * TURNS + 1
    spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a").alias("text")).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = Tables(spark, str(tmp_path)).conversations
    assert got.rdd.getNumPartitions() == 6 > spark.sparkContext.defaultParallelism and got.count() == n


def test_relations_of_every_pattern_and_case(spark):
    """A pattern is tried only on texts with its fixed words; what the plain expressions find is what comes out."""
    import re
    from strataline.functions import lexicons
    from strataline.operators import entities as en

    lines = ["Aria AND Borin  Were allies.", "Aria was Borin's brother and Cela LOVED Doran", "Aria and Borin, were friends", "Elin\nworked  with Gwen; Hugo went to Northvale",
             "Isla fought Against Jarek and arrived at Southmere", "beloved Aria hatedly", "", "Aria trusted Borin trusted Cela"]
    got = {(r.seq, r.k, r.ord, r.source, r.target, r.relation) for r in en.pattern_relations(spark.createDataFrame([*enumerate(lines), (99, None)], "k int, text string")).collect()}
    want = set()
    for k, text in enumerate(lines):
        rows = [(i, m[1], m[2], kind) for i, (p, kind, _) in enumerate(lexicons.RELATION_PATTERNS) for m in re.finditer("(?i)" + p, text)]
        like = lambda w: len(w) > 1 and w[0].isupper() and w.upper() != w and w.lower() not in lexicons.NOT_ENTITY
        want |= {(n, k, *r) for n, r in enumerate(r for r in rows if like(r[1]) and like(r[2]))}
    assert got == want and len({r[2] for r in got}) >= 6
    assert en.fixed_words(lexicons.RELATION_PATTERNS[0][0]) == ["and", "were"]


def test_subsequences_some_rows_at_a_time(monkeypatch):
    """Token lists of a batch never become Python's all at once."""
    import random
    import pyarrow as pa

    rnd = random.Random(3)
    lists = [[rnd.choices("abcd", k=rnd.randint(0, 12)) for _ in range(50)] for _ in range(2)]
    seen = []
    inner = coherence._lcs
    monkeypatch.setattr(coherence, "COMPARED_ROWS", 7)
    monkeypatch.setattr(coherence, "_lcs", lambda a, b: seen.append(isinstance(a[0], int)) or inner(a, b))
    got = coherence._f1(*(pa.array(x, pa.list_(pa.string())) for x in lists)).to_pylist()
    for g, r, value in zip(*lists, got):
        best = [[0] * (len(r) + 1) for _ in range(len(g) + 1)]
        for i, x in enumerate(g):
            for j, y in enumerate(r):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        n = best[-1][-1]
        assert value == pytest.approx(2 * n / (len(g) + len(r)) if n else 0.0)
    assert all(seen)
