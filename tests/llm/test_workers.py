"""What Python workers hold: runs of texts, pieces numbered together, the state of one step."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from strataline.llm import common, encode


def test_text_runs_hold_one_run_of_a_batch():
    texts = ["ab" * 5, None, "", "é" * 10, "x" * 45, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    empty = batch.slice(0, 0)
    runs = list(encode.text_runs(iter([empty, batch, batch.slice(3)]), 20))
    assert [ids for ids, _ in runs] == [[0, 1, 2, 3], [4], [5], [3, 4], [5]]
    assert [t for ids, run in runs for t in run] == texts + texts[3:]
    assert all(sum(len(t or "") for t in run[:-1]) < 20 for _, run in runs)


def test_new_pieces_are_numbered_together():
    numbers = encode._Numbers(iter(range(100)))
    numbers["old"]
    numbers.new.clear()
    assert numbers.many(np.array(["a", "old", "b", "a"], object)).tolist() == [1, 0, 2, 1]
    assert numbers.new == [(1, "a"), (2, "b")] and numbers == {"old": 0, "a": 1, "b": 2}
    assert numbers.many(np.array([], object)).tolist() == []


def test_parted_pieces_have_the_ids_of_the_library():
    e = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Word, word.\nWord!? (x) a,\nb,\nword, é. ñu\n\nend.", "word,\nWord. 12. 3\n4. <|endoftext|>. a\n<|x", "ßé... ɐ. ɐ,\nx  y.", "", None]
    for _ in range(2):  # the second time every piece is known
        got = [np.frombuffer(raw, "<u4").tolist() for raw in e.encode(texts)]
        assert got == [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_worker_keeps_the_state_of_one_step():
    made = []
    first = common.worker_state("test-first", lambda: made.append(1) or [1])
    assert common.worker_state("test-first", lambda: made.append(2) or [2]) is first and made == [1]
    second = common.worker_state("test-second", lambda: [3])
    assert common.worker_state("test-first", lambda: [4]) == [4] and second == [3]
    common.drop_worker_state()
    assert common.worker_state("test-first", lambda: [5]) == [5]
    common.drop_worker_state()
