"""File and table sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def experiment_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Headered experiment files with the file stem; text such as NA is kept as text."""
    r = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return df.withColumn("source_file", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1))


def experiment_files(spark: SparkSession, path: str, pattern: str = "*.{csv,xlsx,xls}") -> DataFrame:
    """Name, size, time and suffix of the files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                        F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.md5("content").alias("hash"))


def changed(hashes: DataFrame, ledger: DataFrame, keys: list[str] = ["path", "hash"]) -> DataFrame:
    """Entries whose (path, hash) the ledger does not hold."""
    return hashes.join(ledger.select(*keys), keys, "left_anti")


def status_report(rows: DataFrame, file: str = "source_file", valid: str = "valid", complete: str = "complete") -> DataFrame:
    """Per file: Error without the needed columns, Warning without valid rows, else Success."""
    g = rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("valid_rows"), F.bool_and(complete).alias("_c"))
    return g.select(file, "rows", "valid_rows", F.when(~F.col("_c"), "Error").when(F.col("valid_rows") == 0, "Warning").otherwise("Success").alias("status"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of all files below a folder."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    return df.select(F.col("_metadata.file_path").alias("path"), "value")


def checked_lines(lines: DataFrame, first: str, required: list[str], valid: Column, file: str = "source_file") -> DataFrame:
    """Data lines of headered files with ``complete`` (the file's header has all required columns) and ``valid``.

    A header starts with the column ``first``; a file without one is incomplete.
    ``valid`` may read ``fields``, a map from column to text. The table of
    headers has one row per file.
    """
    head = (F.col("value") == first) | F.col("value").startswith(first + ",")
    headers = lines.filter(head).groupBy(file).agg(F.min("value").alias("_h"))
    rows = lines.filter(~head).join(headers, file, "left").withColumn("_n", F.split("_h", ","))
    # A line may have more or fewer fields than its header: surplus ones are dropped, missing ones are null.
    cells = F.transform(F.sequence(F.lit(1), F.size("_n")), lambda i: F.try_element_at(F.split("value", ","), i))
    rows = rows.withColumn("fields", F.when(F.col("_n").isNotNull(), F.map_from_arrays("_n", cells)))
    complete = F.col("_n").isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, required)), F.col("_n"))) == 0)
    rows = rows.withColumn("complete", F.coalesce(complete, F.lit(False)))
    return rows.withColumn("valid", F.col("complete") & F.coalesce(valid, F.lit(False))).drop("_h", "_n", "fields")


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file below the path; unreadable files are skipped."""
    df = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def rows_as_text(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Lines ``a | b | c`` under a sheet header, one row per line, so a large sheet stays distributed."""
    line = F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])
    body = df.select(group, *order, F.lit(1).alias("part"), line.alias("line"))
    head = df.select(group).distinct().select(group, *[F.lit(None).cast(dict(df.dtypes)[o]).alias(o) for o in order], F.lit(0).alias("part"),
                                              F.concat(F.lit("## Sheet: "), F.col(group).cast("string")).alias("line"))
    return head.unionByName(body)


def markdown_lines(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Markdown table as ordered lines: header, rule, then rows with at least one value."""
    spark = df.sparkSession
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    some = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]).isNotNull()
    body = df.filter(some).select(F.col(order).cast("long").alias("line"), bar([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("text"))
    top = spark.range(2).select((F.col("id") - 2).alias("line"), F.when(F.col("id") == 0, bar([F.lit(c) for c in columns])).otherwise(bar([F.lit("---") for _ in columns])).alias("text"))
    return top.unionByName(body)


def instruction_lines(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid (instruction, output, input) rows and the lines that are not usable, with a reason."""
    parsed = lines.withColumn("_j", F.from_json(text, "instruction string, output string, input string, _corrupt_record string",
                                                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
    whole = ~broken & F.col("_j.instruction").isNotNull() & F.col("_j.output").isNotNull()
    good = parsed.filter(whole).select(*[c for c in lines.columns if c != text], "_j.instruction", "_j.output", "_j.input")
    bad = parsed.filter(~whole).select(*lines.columns, F.when(broken, "invalid JSON").otherwise("missing instruction or output").alias("issue"))
    return good, bad


def instruction_csv(spark: SparkSession, path: str, instruction: str = "instruction", output: str = "output") -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in (instruction, output) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(F.col(instruction).alias("instruction"), F.col(output).alias("output"))


def instruction_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("instruction").isNotNull() & F.col("output").isNotNull()
    return df.filter(ok), df.filter(~ok)


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Run id and one row per logged step."""
    return spark.read.json(path).select("run_id", F.explode("metrics").alias("m")).select("run_id", "m.*")


def catalog_tables(spark: SparkSession, catalog: str, base: str) -> DataFrame:
    """Every CSV a JSON catalog names, united by column name with its dataset id.

    The catalog is a small list of files that a person maintains; only its entries reach the driver.
    """
    entries = spark.read.option("multiLine", True).json(catalog).select("dataset_id", "file_path").collect()
    out = None
    for e in entries:
        df = spark.read.option("header", True).option("nullValue", "").csv(f"{base}/{e.file_path}").withColumn("dataset_id", F.lit(e.dataset_id))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def feedback_json(spark: SparkSession, path: str) -> DataFrame:
    """Feedback entries with flattened ratings."""
    f = spark.read.option("multiLine", True).json(path).select(F.explode("feedback").alias("f")).select("f.*")
    return f.select(*[c for c in f.columns if c != "ratings"], "ratings.*")
