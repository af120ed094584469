"""Token counts by a compiled finite-state transducer, run over chunks of all texts at once."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state
from .encode import runs

#: Characters per chunk of the parallel scan.
CHUNK = 2_048
#: A worker forgets the words it has counted when it holds more; results don't depend on it.
KNOWN_WORDS = 800_000

# The splitting pattern of the vocabulary files this transducer is compiled for (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Symbol classes and states.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, RV, EL, E = range(9)
GAP, WORD, MARKS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
STATES, CLASSES = 6, 9
#: What a transition says: a word begins at this symbol; a word begins at the symbol before.
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output per (class, state), flattened: a deterministic transducer for ``SPLIT``.

    Whether 'r, 'v or 'l is a contraction shows one symbol later, so the output
    can mark the symbol before. A contraction ends in GAP, as a number does.
    """
    letters = (LETTER, STMD, RV, EL, E)
    nxt, out = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)
    fresh = {SPACE: (GAP, 0), NUMBER: (GAP, HERE), OTHER: (MARKS, HERE), QUOTE: (QUOTED, HERE)} | {c: (WORD, HERE) for c in letters}
    for state in range(STATES):
        for c in range(CLASSES):
            go, say = fresh[c]
            if state == WORD and c in letters:
                go, say = WORD, 0
            elif state in (MARKS, QUOTED) and c in (OTHER, QUOTE):
                go, say = MARKS, 0
            elif state == QUOTED and c in (STMD, RV, EL):
                go, say = {STMD: GAP, RV: QUOTED_RV, EL: QUOTED_L}[c], 0
            elif (state, c) in ((QUOTED_RV, E), (QUOTED_L, EL)):
                go, say = GAP, 0
            elif state in (QUOTED_RV, QUOTED_L):
                go, say = (WORD, BEFORE) if c in letters else (go, say | BEFORE)
            nxt[c, state], out[c, state] = go, say
    return nxt.ravel(), out.ravel()


def symbol_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    for chars, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", EL), ("e", E)):
        for c in chars:
            table[ord(c)] = kind
    return table


class Transducer:
    """Counts tokens under a BPE file with word ends.

    The splitter runs as a finite-state machine: every chunk of the text is run
    from every state at once, which gives its map from entry state to exit
    state; the maps are composed by a parallel prefix scan, which gives each
    chunk's true entry state; a second run then says where words begin. The
    transition that closes a word emits the word's number of tokens. These
    outputs are compiled on demand: a word seen first is given to the library,
    many at a time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        spec = json.load(open(path))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != SPLIT or spec["model"].get("end_of_word_suffix") != "</w>" or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the transducer is compiled for another splitting rule")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings must be matched as they stand")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.normalizer = normalizers.Sequence([])  # words arrive normalised
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size(with_added_tokens=True))])
        self.next, self.out = compile_splitter()
        self.classes = symbol_classes()
        self.known: dict[str, int] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, code point by code point."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def begins(self, symbols: np.ndarray) -> np.ndarray:
        """Where words begin in a sequence of classes that ends in SPACE: a flag per symbol."""
        lanes = -(-len(symbols) // CHUNK)
        padded = np.full(lanes * CHUNK, SPACE, np.uint8)
        padded[:len(symbols)] = symbols
        rows = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T) * np.uint8(STATES)
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
        for row in rows:
            maps = self.next[maps + row]
        entry = np.empty(lanes, np.uint8)
        entry[0] = GAP
        entry[1:] = compose_prefixes(maps.T)[:-1, GAP]
        said, state = np.empty((CHUNK, lanes), np.uint8), entry
        for k, row in enumerate(rows):
            at = state + row
            said[k] = self.out[at]
            state = self.next[at]
        flat = said.T.reshape(-1)[:len(symbols)]
        begin = (flat & HERE).astype(bool)
        begin[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begin

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 2_000):
            some = words[k:k + 2_000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.int64)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(some):
                self.known.update(zip(some, np.diff(at, prepend=-1).tolist()))
            else:
                self.known.update((w, len(e.ids)) for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null text has none."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        extra, plain = [0] * len(texts), []
        for k, t in enumerate(texts):
            t = t or ""
            if "<|" in t:
                pieces = self.special.split(t)
                extra[k] = len(pieces) - 1
                plain.append("\n".join(map(self.normal, pieces)))
            else:
                plain.append(self.normal(t))
        whole = "\n".join(plain) + "\n"
        symbols = self.classes[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        begin = self.begins(symbols)
        marks = np.flatnonzero(begin | (symbols == SPACE))
        first = begin[marks]
        at, to = marks[first], marks[np.flatnonzero(first) + 1]
        words = [whole[b:e] for b, e in zip(at.tolist(), to.tolist())]
        self._learn(sorted(set(words).difference(self.known)))
        counts = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([len(p) + 1 for p in plain])
        upto = total[np.searchsorted(at, ends)]
        return (np.diff(upto, prepend=0) + extra).tolist()


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunk, state) under composition, in log2 of the number of chunks rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Whole texts, without begin, end or added special tokens; a special string
    inside a text is one token. A null or empty text has 0 bytes and 0 tokens.
    Rows that repeat a doc_id (or have none) are counted each for itself; other
    columns are not read. Nothing is shuffled. An empty table gives an empty table.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_state(f"transducer:{tokenizer}", lambda: Transducer(tokenizer))
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            counts = [n for i, j in runs(texts) for n in machine.count(texts[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, sizes, counts)], schema=kinds)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
