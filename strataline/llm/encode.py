"""Token ids of whole texts with the tokenizers library, encoding each distinct piece of text once per worker."""

from __future__ import annotations

import itertools
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: A worker forgets its pieces when it holds more; results don't depend on it.
KNOWN_PIECES = 500_000
#: Texts are encoded in runs of about this many characters, whatever the size of an Arrow batch.
RUN_CHARS = 2_000_000
#: The same where only ids are made: longer runs see fewer pieces twice.
ENCODE_CHARS = 3_000_000

_ODD = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")
#: Letters or digits (of Latin, where Python and the file's splitting rule agree on them), then punctuation to the end.
_ENDED = re.compile(r"([0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([" + re.escape(string.punctuation) + "]+)", re.ASCII)


class _Numbers(dict):
    """Numbers for pieces as they come; new ones wait in ``new``."""

    def __init__(self, counter):
        self.counter, self.new = counter, []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = next(self.counter)
        self.new.append((n, piece))
        return n

    def many(self, pieces: np.ndarray) -> np.ndarray:
        """Numbers of an object array of pieces; all new ones are numbered at once."""
        numbers = np.fromiter(map(self.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        new = list(dict.fromkeys(pieces[unknown].tolist()))
        given = list(itertools.islice(self.counter, len(new)))
        self.update(zip(new, given))
        self.new.extend(zip(given, new))
        numbers[unknown] = given if len(new) == len(unknown) else np.fromiter(map(self.__getitem__, pieces[unknown]), np.int64, len(unknown))
        return numbers


class _Pool:
    """Ids of numbered pieces end to end, gathered for many pieces at once."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(numbers) and numbers.max() >= len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these pieces in order, length of each)."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + lengths, lengths)
        return self.ids[at], lengths


class Encoder:
    """Ids of texts under a byte-level BPE file, as little-endian unsigned 32-bit integers.

    The file's own splitting rule binds a space to what follows it, and nothing
    before a space that precedes a visible character changes what follows. So a
    text may be cut before each such space and its pieces encoded one by one.
    The rule also parts letters or digits from the punctuation that ends a
    piece, and a line feed between two visible characters from both, so a new
    piece of that form is put together from its parts. Parts repeat a great
    deal; each new one goes to the library once, many in one string: each starts
    with the one space that it holds, and so do exactly the first tokens of
    each. Under a file with another splitting rule pieces are not parted.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        rule = str(self.tok.pre_tokenizer)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.parted = rule.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in rule and self.tok.normalizer is None and not any(map(_ENDED.fullmatch, special))
        #: A piece of several lines with the first character of a special string goes to the library whole.
        self.marks = re.compile("|".join(sorted(re.escape(t[0]) for t in special)) or "(?!)")
        self._forget()

    def _forget(self) -> None:
        counter = itertools.count()
        #: Pieces that follow a space, and those that don't.
        self.after, self.first, self.pool = _Numbers(counter), _Numbers(counter), _Pool()
        self.first[""] = next(counter)
        self.pool.put(np.array([0]), np.array([0]), np.zeros(0, "<u4"))

    def _from_library(self, pieces: list[tuple[int, str]], lead: str) -> None:
        for k in range(0, len(pieces), 2_000):
            some = pieces[k:k + 2_000]
            numbers = np.array([n for n, _ in some])
            if lead and not any(" " in p for _, p in some):
                ids = np.array(self.tok.encode_batch_fast([" " + " ".join(p for _, p in some)], add_special_tokens=False)[0].ids, dtype="<u4")
                at = np.flatnonzero(self.spaced[ids])
                if len(at) == len(some):
                    self.pool.put(numbers, np.diff(at, append=len(ids)), ids)
                    continue
            rows = [e.ids for e in self.tok.encode_batch_fast([lead + p for _, p in some], add_special_tokens=False)]
            self.pool.put(numbers, np.array([len(r) for r in rows]), np.array([i for r in rows for i in r], dtype="<u4"))

    def _lines(self, piece: str, numbers: _Numbers) -> list[int] | None:
        """Numbers of the parts of a piece of several lines, or nothing if it is to go to the library whole."""
        lines = piece.split("\n")
        if len(lines) == 1 or lines != piece.split() or self.marks.search(piece):
            return None
        out = []
        for k, line in enumerate(lines):
            of, ended = self.first if k else numbers, _ENDED.fullmatch(line)
            out += [self.first["\n"]] * (k > 0) + ([of[ended[1]], self.first[ended[2]]] if ended else [of[line]])
        return out

    def _learn(self) -> None:
        """Ids of all new pieces; the parts of a piece are pieces of one part, and new ones among them come behind."""
        joined, parts, counts = [], [np.zeros(0, np.int64)], []
        for numbers, lead in ((self.after, " "), (self.first, "")):
            new, numbers.new = numbers.new, []
            whole = [x for x in new if x[1].isalnum()] if self.parted else new
            if len(whole) < len(new):
                rest = [x for x in new if not x[1].isalnum()]
                ends = [_ENDED.fullmatch(p) for _, p in rest]
                ended = [m.groups() for m in ends if m]
                if ended:
                    stems, tails = (np.array(c, object) for c in zip(*ended))
                    joined += [n for (n, _), m in zip(rest, ends) if m]
                    parts.append(np.column_stack([numbers.many(stems), self.first.many(tails)]).ravel())
                    counts += [2] * len(ended)
                of_lines = []
                for x in (x for x, m in zip(rest, ends) if not m):
                    lines = self._lines(x[1], numbers) if "\n" in x[1] else None
                    if lines:
                        joined.append(x[0])
                        of_lines += lines
                        counts.append(len(lines))
                    else:
                        whole.append(x)
                parts.append(np.array(of_lines, np.int64))
                whole += numbers.new
                numbers.new = []
            plain = [x for x in whole if " " not in x[1]]
            self._from_library(plain, lead)
            if len(plain) < len(whole):
                self._from_library([x for x in whole if " " in x[1]], lead)
        if joined:
            ids, lengths = self.pool.get(np.concatenate(parts))
            ends = np.cumsum(lengths)[np.cumsum(counts) - 1]
            self.pool.put(np.array(joined), np.diff(ends, prepend=0), ids)

    def _cut(self, text: str) -> tuple[np.ndarray, list[int]]:
        """As :meth:`_numbered` for one text in which white space follows a space."""
        head, *rest = _CUT.split(text)
        return np.array([self.first[head], *map(self.after.__getitem__, rest)], np.int64), [len(rest) + 1]

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, how many each has); they are told apart before Python sees them."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        kinds = lists.flatten().dictionary_encode()
        numbers = self.after.many(kinds.dictionary.to_numpy(zero_copy_only=False))[np.asarray(kinds.indices)]
        counts = np.asarray(lists.value_lengths(), np.int64)
        numbers[np.cumsum(counts) - counts] = [self.first[t.partition(" ")[0]] for t in texts]
        return numbers, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One value per text; a null text has no ids."""
        if len(self.after) > KNOWN_PIECES:
            self._forget()
        plain = [t or "" for t in texts]
        odd = [bool(_ODD.search(t)) for t in plain]
        order = sorted(range(len(plain)), key=odd.__getitem__)
        if not plain:
            return []
        even = [plain[k] for k in order if not odd[k]]
        rows = [self._numbered(even)] * bool(even) + [self._cut(plain[k]) for k in order if odd[k]]
        self._learn()
        ids, lengths = self.pool.get(np.concatenate([r[0] for r in rows]))
        ends = 4 * np.cumsum(lengths)[np.cumsum(np.concatenate([r[1] for r in rows])) - 1]
        raw, out, begin = ids.tobytes(), [b""] * len(plain), 0
        for k, end in zip(order, ends.tolist()):
            out[k] = raw[begin:end]
            begin = end
        return out


def encoder(path: str) -> Encoder:
    return worker_state(f"encoder:{path}", lambda: Encoder(path))


def runs(texts: list[str | None], chars: int = RUN_CHARS):
    """(begin, end) of runs of texts with about ``chars`` characters each."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def text_runs(batches: Iterator[pa.RecordBatch], chars: int = ENCODE_CHARS) -> Iterator[tuple[list, list]]:
    """(values, texts) of runs of rows with about ``chars`` characters each; Python holds one run, whatever the size of an Arrow batch."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(b.column(1)), 0), np.int64))
        begin = 0
        while begin < b.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = min(b.num_rows, int(np.searchsorted(ends, done + chars)) + 1)
            part = b.slice(begin, end - begin)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            begin = end
