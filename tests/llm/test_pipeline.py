"""Every stage of the pipeline against brute force on its own input, in order."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from helpers import frame, near_components
from test_lines_mixing_licenses import kept_lines
from test_search_tokens_packing import BYTE, library_ids

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from strataline.llm.mixing import mix_plan  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "line dedup", "near dedup", "mixing", "packing"]
    named = steps["language"](spark, docs, SF).cache()
    assert named.columns == docs.columns and named.count() >= 0.97 * docs.count()
    thin = steps["line dedup"](spark, named, SF).cache()
    assert thin.columns == docs.columns
    want = kept_lines([(r.doc_id, r.text) for r in named.collect()])
    assert sorted(((r.doc_id, r.text) for r in thin.collect()), key=str) == sorted([(d, t) for d, _, _, t in want], key=str)
    near = steps["near dedup"](spark, thin, SF).cache()
    roots = near_components([(r.doc_id, r.text) for r in thin.collect()], percent=80)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {d for d, r in roots.items() if d == r}
    mixed = steps["mixing"](spark, near, SF).cache()
    times = {r.doc_id: r.times for r in mix_plan(near).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})
    rows = steps["packing"](spark, mixed, SF).collect()
    ids = dict(zip([r.doc_id for r in near.collect()], library_ids(BYTE, [r.text for r in near.collect()])))
    assert sum(r.length for r in rows) == sum(n * (len(ids[d]) + 1) for d, n in times.items())
    assert all(r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0][r.start:r.start + r.length], "<u4").tobytes()) for r in rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").distinct().collect()))


def test_near_stage_links_from_80_percent(spark):
    """Pairs that differ in one word: 45 of 55 shingles shared (0.818), 39 of 49 (0.796) and 95 of 105 (0.905)."""
    texts = []
    for name, n in (("a", 54), ("b", 48), ("c", 104)):
        base = [f"{name}{k}" for k in range(n)]
        texts += [" ".join(base), " ".join([*base[:20], "other", *base[21:]])]
    near = dict(corpus_pipeline.STAGES)["near dedup"](spark, frame(spark, texts), SF)
    roots = near_components(list(enumerate(texts)), percent=80)
    assert {r.doc_id for r in near.collect()} == {d for d, r in roots.items() if d == r} == {0, 2, 3, 4}
