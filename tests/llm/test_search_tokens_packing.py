import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, frame
from tokenizers import Tokenizer

from strataline.llm.ball_tree import BallTree, top_k
from strataline.llm.encode import Encoder
from strataline.llm.packing import Packer, pack
from strataline.llm.token_counts import Transducer, compose_prefixes, token_counts
from strataline.llm.wavelet import WaveletMatrix, read_documents, token_shards, write_token_shards
from pyspark.sql import functions as F

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", " \n", "\t", "'", "'s", "'re", "'rex", "'l", "'ll", "'v", "--'", "d", "e", "l", "foo", "Bar's", "ΣΑΣ", "İ", "é", "<|endoftext|>",
          "<|startoftext|>", "12", "½", "\xa0", "　", "\x1c", "\x85", "日本", "👍🏽", "!?", "é", "_", "\r\n", "​"]


def mixed_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def best(q, own, rows, ids, k):
    scores = [(sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for r, i in zip(rows, ids) if i != own]
    return sorted(scores, key=lambda x: (-x[0], x[1]))[:k]


def test_ball_tree_is_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, d, k = int(rng.integers(1, 300)), int(rng.integers(0, 6)), int(rng.integers(1, 6))
        x, ids = rng.integers(-5, 6, (n, d)), rng.permutation(2 * n)[:n]
        if trial % 3 == 0:
            x[:] = x[0]
        got = BallTree(x, ids, leaf=8).search(x[:5], ids[:5], np.full(len(x[:5]), -np.inf), k)
        assert got == [best(x[j], ids[j], x, ids, k) for j in range(len(got))]


def test_top_k_over_shards_with_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=4)]) for k in range(230)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (310, [2.0, 1.0]), (320, []), (7, rows[3][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string").repartition(3)
    got = top_k(table, F.col("vec_id") % 10 == 0, k=4, shard_rows=40, block_queries=6).collect()
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in good:
        if i % 10 == 0:
            same = [(j, w) for j, w in good if len(w) == len(v)]
            want = best(v, i, [w for _, w in same], [j for j, _ in same], 4)
            assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {i for i, v in good if i % 10 == 0 and len(v) == 4}
    assert top_k(table.limit(0), F.lit(True)).collect() == []


def test_encoder_is_the_library():
    texts = mixed_texts(4_000) + awkward()
    got = Encoder(BYTE).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(BYTE, texts)


def test_transducer_is_the_library():
    texts = mixed_texts(4_000, 2) + awkward()
    assert Transducer(WORDS).count(texts) == [len(x) for x in library_ids(WORDS, texts)]


def test_prefix_composition():
    maps = np.random.default_rng(3).integers(0, 6, (37, 6)).astype(np.uint8)
    state, want = np.arange(6), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (compose_prefixes(maps) == np.array(want)).all()


def test_token_counts_query(spark):
    texts = awkward()
    rows = token_counts(frame(spark, texts), WORDS, limit=4).orderBy("doc_id").collect()
    want = [len(x) for x in library_ids(WORDS, texts)]
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(len((t or "").encode()), n, n > 4) for t, n in zip(texts, want)]
    assert token_counts(frame(spark, texts).limit(0), WORDS).collect() == []


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 3_000):
        ids = rng.integers(0, 40, n)
        w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 6).to_bytes())
        assert (w.all() == ids).all() and all(w.access(i) == ids[i] for i in range(0, n, 17))
        for v in (0, 7, 39):
            at = np.flatnonzero(ids == v)
            assert w.count(v) == len(at) and w.count(v, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
            assert [w.select(v, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]
    with pytest.raises(ValueError):
        WaveletMatrix.build(np.array([64]), 6)


def test_token_shards_round_trip(spark, tmp_path):
    texts = awkward() * 3
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    docs = frame(spark, [texts[i] for i in order], ids=order)
    want, start = [], 0
    for i, ids in enumerate(library_ids(BYTE, texts)):
        ids = [*ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = str(tmp_path / "shards")
    write_token_shards(docs.repartition(5), path, BYTE, shard_ids=1_000)
    assert sorted(map(tuple, read_documents(spark, path).collect())) == want
    assert spark.read.parquet(path).count() > 4
    assert token_shards(docs.limit(0), BYTE).collect() == []
    twice = token_shards(frame(spark, ["a", "a", None], ids=[4, 4, None]), BYTE).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in twice] == [(None, 0, 1), (4, 1, 2), (4, 3, 2)]


def check_packing(pieces, docs, size):
    """Pieces (doc, start, ids, sequence, offset) hold every id once; sequences are full or a power of two."""
    for d, ids in docs.items():
        mine = sorted((s, i) for x, s, i, _, _ in pieces if x == d)
        assert b"".join(i for _, i in mine) == ids
        assert [s for s, _ in mine] == np.cumsum([0, *(len(i) // 4 for _, i in mine)])[:-1].tolist()
    sequences = {}
    for _, _, i, q, o in pieces:
        sequences.setdefault(q, []).append((o, len(i) // 4))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == size or at < size and at & (at - 1) == 0


def test_packer_keeps_every_id():
    rng = np.random.default_rng(6)
    for trial in range(150):
        size = (16, 64)[trial % 2]
        packer, docs = Packer(size, most=(1, 3, 50)[trial % 3]), {}
        for d in range(int(rng.integers(0, 50))):
            docs[d] = rng.integers(0, 9, int(rng.choice([1, 2, 15, 16, 17, 200]))).astype("<u4").tobytes()
            packer.add(d, docs[d])
        packer.finish()
        check_packing([(r[0], r[1], r[7], r[5], r[6]) for r in packer.take()], docs, size)


def test_packer_takes_the_level_of_least_squares():
    rng = np.random.default_rng(7)
    packer = Packer(12)
    for _ in range(400):
        n = int(rng.integers(1, 12))
        options = {}
        for h in range(12):
            if (h and not packer.count[h]) or h + n > 12:
                continue
            c = packer.count.copy()
            if h:
                c[h] -= 1
            if h + n < 12:
                c[h + n] += 1
            options[h] = int((c[1:12] ** 2).sum())
        assert options[packer._level(n)] == min(options.values())
        packer._put((0, 0, b"\0\0\0\0" * n, n), n)


def test_pack_query(spark):
    texts = awkward()
    docs = frame(spark, texts)
    rows = pack(docs.repartition(3), BYTE, with_ids=True).collect()
    want = {i: np.array([*ids, 0], "<u4").tobytes() for i, ids in enumerate(library_ids(BYTE, texts))}
    check_packing([(r.doc_id, r.start, bytes(r.ids), r.sequence_id, r.offset) for r in rows], want, 1024)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) and r.doc_tokens * 4 == len(want[r.doc_id]) for r in rows)
    assert pack(docs.limit(0), BYTE).collect() == []
    assert sum(r.length for r in pack(frame(spark, ["a", "a", None], ids=[4, 4, None]), BYTE).collect()) == 5


def test_rule_fills_nearly_all_windows():
    """Of the tokens beyond full windows, the sum-of-squares rule packs at least nine tenths; what is open at the end is the rest."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    packer = Packer()
    ids = [raw + bytes(4) for raw in Encoder(BYTE).encode(texts)]
    for k, raw in enumerate(ids):
        packer.add(k, raw)
        assert packer.n_open <= packer.most and packer.n_open == packer.count.sum() == sum(map(len, packer.open))
    assert packer.by_rule >= 0.9 * sum(len(raw) // 4 % packer.size for raw in ids)
