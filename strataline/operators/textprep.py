"""Chunking, redaction, profiling, citation checks and instruction sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import sentences, strip, words


def word_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 50, least: int = 20) -> DataFrame:
    """Overlapping word windows; short ones are dropped before they are numbered."""
    w = docs.select(F.col(doc), words(F.col(text)).alias("_w"))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    piece = lambda i: F.struct(i.alias("start_word"), F.least(i + size, F.size("_w")).alias("end_word"), F.array_join(F.slice("_w", i + 1, size), " ").alias("text"))
    kept = F.filter(F.transform(starts, piece), lambda p: F.length(p.text) > least)
    out = w.select(doc, F.posexplode(kept).alias("chunk_index", "p"))
    return out.select(F.concat(F.col(doc).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), doc, "chunk_index", "p.*")


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_pieces(text: str, size: int = 1000, overlap: int = 200, separators=SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs, pack pieces up to ``size``, carry an overlap."""
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1:]
    if sep:
        head, *tail = text.split(sep)
        parts = [p for p in [head, *[sep + p for p in tail]] if p]
    else:
        parts = list(text)
    out, held, length = [], [], 0

    def flush():
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for p in parts:
        if len(p) > size:
            flush()
            held, length = [], 0
            out.extend(recursive_pieces(p, size, overlap, rest))
            continue
        if length + len(p) > size:
            flush()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    flush()
    return out


def recursive_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Recursive chunks of whole texts, one Arrow batch of documents at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pieces = [recursive_pieces(x, size, overlap) if x else [] for x in pdf["text"]]
            flat = [(d, i, p) for d, ps in zip(pdf["doc"], pieces) for i, p in enumerate(ps)]
            yield pd.DataFrame(flat, columns=["doc", "chunk_index", "text"])

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInPandas(
        run, "doc long, chunk_index int, text string").withColumnRenamed("doc", doc)


def semantic_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """Neighbouring sentences stay together while the cosine of their word sets reaches the threshold.

    Works inside the row: a document is one value, so no shuffle is needed.
    """
    s = F.filter(F.transform(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), r"\. "), strip), lambda x: x != "")
    d = docs.select(doc, text, s.alias("_s"))
    d = d.withColumn("_v", F.transform("_s", lambda x: F.array_distinct(words(F.lower(x)))))
    near = lambda a, b: F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))
    step = lambda i: F.when((i > 0) & (F.round(near(F.get("_v", i - 1), F.get("_v", i)), 9) >= threshold), 0).otherwise(1)
    d = d.withColumn("_b", F.transform("_s", lambda x, i: step(i)))
    start = F.array().cast("array<string>")
    # Chunks are slices between boundaries, so each sentence is copied once.
    d = d.withColumn("_at", F.filter(F.transform("_b", lambda b, i: F.when(b == 1, i + 1)), lambda i: i.isNotNull()))
    upto = lambda j: F.coalesce(F.get("_at", j + 1), F.size("_s") + 1)
    chunks = F.transform("_at", lambda i, j: F.array_join(F.slice("_s", i, upto(j) - i), ". "))
    final = F.when(F.size("_s") <= 1, F.when(strip(F.col(text)) != "", F.array(F.col(text))).otherwise(start)).otherwise(
        F.transform(chunks, lambda x: F.concat(x, F.lit("."))))
    return d.select(doc, F.posexplode(final).alias("chunk_index", "text"))


# What a text must contain for a pattern to be tried at all.
HINTS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.rlike("[0-9]{3}"), "api_key": lambda t: t.contains("sk-") | t.contains("key-"),
         "ipv4": lambda t: t.rlike(r"[0-9]\.[0-9]"), "ssn": lambda t: t.rlike("[0-9]-[0-9]")}


def redact(text: Column) -> tuple[Column, Column]:
    """Redacted text and number of findings; each pattern sees the replacements of the ones before.

    No pattern can take in a bracketed mark, so the findings are the marks that were added.
    """
    out, found = text, F.lit(0)
    for name, pattern in lexicons.PII:
        out = F.when(HINTS[name](out), F.regexp_replace(out, pattern, f"[REDACTED_{name.upper()}]")).otherwise(out)
    for name, _ in lexicons.PII:
        mark = f"[REDACTED_{name.upper()}]"
        marks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)
        found = found + (marks(out) - marks(text)).cast("int")
    return out, found


WORD = r"[\p{L}\p{N}_]+"


def profile(docs: DataFrame, text: str = "text", digits: tuple[int, int, int] = (1, 3, 1)) -> DataFrame:
    """Grade level, lexical diversity, sentence length and a complexity label."""
    d = docs.withColumn("_w", F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)))
    d = d.withColumn("_n", F.size("_w")).withColumn("_s", F.size(F.filter(F.split(text, r"\."), lambda x: strip(x) != "")))

    def syllables(w):
        # Vowels become "a", everything else a space: the runs are the words of what is left.
        runs = F.size(F.filter(F.split(F.regexp_replace(F.translate(w, "eiouy", "aaaaa"), "[^a]+", " "), " "), lambda x: x != "")) - F.when(w.endswith("e"), 1).otherwise(0)
        return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), runs))

    d = d.withColumn("_w", F.transform("_w", F.lower))
    syl = F.aggregate(F.transform("_w", syllables), F.lit(0), lambda a, x: a + x)
    ok = (F.col("_n") > 0) & (F.col("_s") > 0)
    per = F.col("_n") / F.col("_s")
    grade = 0.39 * per + 11.8 * (syl / F.col("_n")) - 15.59
    d = d.withColumn("_g", F.when(ok, grade))
    kinds = F.size(F.array_distinct("_w"))
    return d.withColumns({
        "reading_grade_level": F.when(ok, F.round("_g", digits[0])).otherwise(0.0),
        "lexical_diversity": F.when(ok, F.round(kinds / F.col("_n"), digits[1])).otherwise(0.0),
        "avg_sentence_length": F.when(ok, F.round(per, digits[2])).otherwise(0.0),
        "complexity_label": F.when(~ok, "Unknown").when(F.col("_g") > 14, "High").when(F.col("_g") > 10, "Advanced").otherwise("Baseline"),
    }).drop("_w", "_n", "_s", "_g")


def difficulty(text: Column, intent: Column) -> Column:
    return F.when(F.size(words(text)) < 4, "Incomplete").when(intent == "cross_document", "Complex").otherwise("Standard")


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited source rows per answer: answers (answer_id, text), sources (answer_id, rank, source_file, page, content)."""
    n = F.transform(F.regexp_extract_all("text", F.lit(r"\[(?:Source\s*)?(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    cited = answers.select("answer_id", F.explode(F.array_distinct(n)).alias("rank"))
    return cited.join(sources, ["answer_id", "rank"]).select(
        "answer_id", "rank", F.coalesce("source_file", F.lit("Unknown")).alias("file"), F.coalesce("page", F.lit("N/A")).alias("page"),
        F.concat(F.substring("content", 1, 200), F.lit("...")).alias("snippet"))


def citation_coverage(text: Column) -> Column:
    """Share of sentences over ten characters with a bracketed number."""
    s = F.filter(sentences(text), lambda x: F.length(x) > 10)
    cited = F.filter(s, lambda x: x.rlike(r"\[\d+\]"))
    return F.when(F.size(s) > 0, F.size(cited) / F.size(s)).otherwise(0.0)


def citation_count(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))))


def composite_evaluation(df: DataFrame) -> DataFrame:
    """Overall score and warnings from faithfulness, relevance, coverage, response text and source count."""
    c = F.col
    overall = c("faithfulness") * 0.5 + c("relevance") * 0.3 + c("coverage") * 0.2
    rules = [(c("faithfulness") < 0.5, "low faithfulness"), (c("relevance") < 0.6, "low relevance"), (c("n_sources") == 0, "no sources"),
             ((citation_count(c("response")) == 0) & (F.length("response") > 100), "no citations"), (F.size(words(c("response"))) < 20, "very short")]
    return df.withColumns({"overall": overall, "warnings": F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in rules]))})


def persona_scores(df: DataFrame) -> DataFrame:
    """One row per persona: its weights over faithfulness, relevance and coverage."""
    rows = [F.struct(F.lit(p).alias("persona"), (F.col("faithfulness") * w[0] + F.col("relevance") * w[1] + F.col("coverage") * w[2]).alias("score"))
            for p, (*_, w) in lexicons.PERSONAS.items()]
    return df.withColumn("_p", F.explode(F.array(*rows))).select(*df.columns, "_p.*")


def qa_pairs(chunks: DataFrame, order: list[str], n: int | None = None, text: str = "text") -> DataFrame:
    """Instruction and output from all chunks, or the first n; blank ones are skipped."""
    first = chunks if n is None else chunks.orderBy(*order).limit(n)
    return first.filter(strip(F.col(text)) != "").select(
        *order, F.concat(F.lit("Explain the key points from the following text: "), F.substring(text, 1, 100), F.lit("...")).alias("instruction"),
        F.col(text).alias("output"))


def training_prompt(instruction: Column, output: Column, template: str = "### Instruction:\n{instruction}\n\n### Response:\n{output}") -> Column:
    head, rest = template.split("{instruction}")
    mid, tail = rest.split("{output}")
    return F.concat(F.lit(head), F.coalesce(instruction, F.lit("")), F.lit(mid), F.coalesce(output, F.lit("")), F.lit(tail))


def instruction_statistics(df: DataFrame, issues: int | Column = 0) -> DataFrame:
    n = lambda c: F.avg(F.size(words(F.coalesce(F.col(c), F.lit("")))))
    s = df.agg(F.count(F.lit(1)).alias("total_samples"), n("instruction").alias("i"), n("output").alias("o"))
    return s.select("total_samples", F.coalesce(F.col("i").cast("long"), F.lit(0)).alias("avg_instruction_length"),
                    F.coalesce(F.col("o").cast("long"), F.lit(0)).alias("avg_output_length"),
                    ((F.col("total_samples") > 0) & (F.lit(issues) == 0 if isinstance(issues, int) else issues == 0)).alias("format_valid"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, by an equi-join on the turn number."""
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    reply = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"], "left")
