"""Statement logs as rows, batch or stream; and the noise filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "mysql", "performance_schema", "sys", "pg_toast")
MARKERS = ("@@version", "show variables", "select version()", "pg_stat_", "set names", "show warnings")


def lines(spark: SparkSession, path: str | list[str], stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("line"))


def mysql_general(rows: DataFrame) -> DataFrame:
    """The payload after `Query` of each line of a general log; no state, so it serves streams as well."""
    sql = F.regexp_extract("line", r"\sQuery\s+(.*)$", 1)
    return rows.withColumn("sql", F.regexp_replace(F.trim(sql), r";\s*$", "")).filter("sql <> ''").select("source_name", "sql", F.lit("NATIVE_LOG").alias("source_type"))


def mysql_slow(files: DataFrame) -> DataFrame:
    """Statements of slow logs (source_name, text), without # lines, SET timestamp and USE lines: each file's text is split at the semicolons that end a line."""
    text = F.regexp_replace("text", r"(?im)^(#.*|\s*SET\s+timestamp\s*=.*|\s*USE\s+\S+;\s*)$", "")
    parts = files.select("source_name", F.explode(F.split(text, r";[ \t]*(?=\r?\n|$)")).alias("sql"))
    return parts.select("source_name", F.regexp_replace("sql", r"^\s+|\s+$", "").alias("sql")).filter("sql <> ''").select("source_name", "sql", F.lit("NATIVE_LOG").alias("source_type"))


def postgres(rows: DataFrame) -> DataFrame:
    """The text after `statement:` or `execute name:` of each line; `line` may hold the lines that belong to a statement, see postgres_entries()."""
    sql = F.regexp_extract("line", r"(?s)(?:statement|execute\s+[^:]+):\s+(.*)$", 1)
    return rows.withColumn("sql", F.regexp_replace(F.trim(sql), r";\s*$", "")).filter("sql <> ''").select("source_name", "sql", F.lit("NATIVE_LOG").alias("source_type"))


def postgres_entries(files: DataFrame) -> DataFrame:
    """(source_name, line) of whole log files (source_name, text): an entry begins at a line with a severity after its prefix, and the lines up to the next such line, indented or not, belong to it."""
    entry = r"(?m)\n(?=[^\n]*\b(?:LOG|ERROR|DETAIL|HINT|WARNING|STATEMENT|FATAL|NOTICE|CONTEXT):\s)"
    return files.select("source_name", F.explode(F.split("text", entry)).alias("line"))


def is_noise(sql: Column, tables: Column, schemas: tuple[str, ...] = SYSTEM_SCHEMAS, markers: tuple[str, ...] = MARKERS) -> Column:
    """All physical rowsets lie in system schemas; or there is none and a marker occurs."""
    system = F.forall(tables, lambda t: F.regexp_extract(t, r"(?:^|\.)([^.]+)\.[^.]+$", 1).isin(*schemas))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.lower(sql), F.lit(m))
    return F.when(F.size(tables) > 0, system).otherwise(marked)


def without_noise(statements: DataFrame, tables_col: str = "tables") -> DataFrame:
    return statements.filter(~is_noise(F.col("sql"), F.col(tables_col)))


def source_name(path: Column) -> Column:
    """A source's name without protocol and trailing separators, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[a-z]+:/+", "/"), r"/+$", "")


def windows(records: DataFrame, component: str, order: list[str], bytes_col: str, limit: int = 8 << 20) -> DataFrame:
    """records with `window`: inside a component, in order, a new window begins where the running bytes pass a multiple of the limit."""
    running = F.sum(F.col(bytes_col)).over(W.partitionBy(component).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return records.withColumn("window", F.floor(F.coalesce(running, F.lit(0)) / limit).cast("int"))
