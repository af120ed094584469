"""A small awkward table and brute-force versions of the operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, score string, n_lines string"


def frame(spark, texts, sources=None, ids=None, langs=None):
    """Documents with columns whose names clash with those that operators use inside."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [(ids[k], texts[k], (langs or ["en"] * n)[k], (sources or ["a"] * n)[k], None, k, "x", "y") for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def awkward():
    """Nulls, empty and blank texts, one very long text, ties and repeats."""
    line = "A line that several documents share"
    return [None, "", "   ", "\n", "\n\n", "short", f"  {line}  \nown one", f"{line.upper()}\nother", f"x\n\t{line}\r\n{line}", line,
            "word " * 30_000, "word " * 30_000, "one two three four", "One  two\tthree four", "äöü ß É 日本 👍", "<|endoftext|> a <|endoftext|>", "l\n" * 5_000]


def shingles(text, k=5):
    w = [x for x in words((text or "").translate(LOWER))]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(docs, percent=85):
    """doc_id -> smallest linked doc_id, by all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}
