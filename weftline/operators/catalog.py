"""Catalog facts: columns, constraints, indexes; their merge, the evidence they give, and closure rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, table, column, type, ordinal, nullable) of DataFrames by name, in lower case."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(f"{t}.{f.name}".lower(), t.lower(), f.name.lower(), f.dataType.simpleString(), i, f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "key string, table string, column string, type string, ordinal int, nullable boolean")


def columns_of_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same from the session's catalog: one row for each column of each of its tables."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{'.'.join(t.namespace or [])}.{t.name}"), 1):
            rows.append((f"{t.name}.{c.name}".lower(), t.name.lower(), c.name.lower(), c.dataType, i, c.nullable))
    return spark.createDataFrame(rows, "key string, table string, column string, type string, ordinal int, nullable boolean")


def unique_columns(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(key, rows, distinct_values, is_unique) measured on data: as many distinct non-null values as rows. Each table is scanned once for all its columns."""
    out = None
    by: dict[str, list[str]] = {}
    for t, c in columns:
        by.setdefault(t, []).append(c)
    for t, cs in sorted(by.items()):
        longs = F.explode(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("key"), F.col(c).cast("string").alias("v")) for c in cs])).alias("x")
        # Two levels: values first, so that no task holds the set of a column's values.
        one = tables[t].select(longs).select("x.*").groupBy("key", "v").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").cast("long").alias("rows"), F.count("v").alias("distinct_values"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_unique", F.col("rows") == F.col("distinct_values"))


def type_compatible(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """COLUMN_TYPE_COMPATIBLE evidence: candidate pairs whose type names are equal ignoring case."""
    types = columns.select("key", F.lower("type").alias("type"))
    both = candidates.select("src_key", "tgt_key").join(types.withColumnsRenamed({"key": "src_key", "type": "s"}), "src_key").join(types.withColumnsRenamed({"key": "tgt_key", "type": "t"}), "tgt_key")
    return both.filter("s = t").select("src_key", "tgt_key", F.lit("COLUMN_TYPE_COMPATIBLE").alias("evidence_type"), F.lit("0.08").cast("decimal(12,10)").alias("score")).distinct()


def index_policy(indexes: DataFrame) -> DataFrame:
    """(key, is_unique, is_lookup) from index members (index, table, column, ordinal, kind, is_unique, visible).

    Unique counts only for a visible index with a single FULL_COLUMN member; a lookup index needs a leading member that isn't an expression. Indexes whose ordinals aren't 1..n count for nothing.
    """
    whole = indexes.groupBy("index", "table").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"), F.bool_and("visible").alias("seen"),
        F.min_by(F.struct("column", "kind", "is_unique"), "ordinal").alias("lead"),
    ).filter("lo = 1 AND hi = n AND d = n")
    key = F.concat_ws(".", "table", "lead.column")
    return (
        whole.filter("seen AND lead.column IS NOT NULL").select(key.alias("key"), (F.col("lead.is_unique") & (F.col("n") == 1) & (F.col("lead.kind") == "FULL_COLUMN")).alias("u"), (F.col("lead.kind") != "EXPRESSION").alias("l"))
        .groupBy("key").agg(F.bool_or("u").alias("is_unique"), F.bool_or("l").alias("is_lookup"))
    )


def enhanced(candidates: DataFrame, columns: DataFrame, policy: DataFrame) -> DataFrame:
    """SOURCE_INDEX, TARGET_UNIQUE and COLUMN_TYPE_COMPATIBLE evidence of column pairs, one of each for a (type, source, target)."""
    pairs = candidates.select("src_key", "tgt_key").distinct()
    made = lambda df, kind, score: df.select("src_key", "tgt_key", F.lit(kind).alias("evidence_type"), F.lit(score).cast("decimal(12,10)").alias("score"))
    source = pairs.join(policy.filter("is_lookup OR is_unique").select(F.col("key").alias("src_key")), "src_key", "left_semi")
    target = pairs.join(policy.filter("is_unique").select(F.col("key").alias("tgt_key")), "tgt_key", "left_semi")
    return made(source, "SOURCE_INDEX", "0.10").unionByName(made(target, "TARGET_UNIQUE", "0.18")).unionByName(type_compatible(pairs, columns))


def merged_inventory(preferred: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join by key where the preferred (live) facts win column by column; origin is LIVE, DDL or BOTH."""
    rest = [c for c in preferred.columns if c not in keys]
    b = fallback.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__b"))
    out = preferred.withColumn("__a", F.lit(True)).join(b, keys, "full")
    origin = F.when(F.col("__a") & F.col("__b"), "BOTH").when(F.col("__a"), "LIVE").otherwise("DDL")
    return out.select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in rest], origin.alias("origin"))


def status(preferred_rows: int | None, fallback_rows: int | None) -> str:
    """COMPLETE with live facts, PARTIAL with DDL facts only, UNAVAILABLE with neither."""
    return "COMPLETE" if preferred_rows else "PARTIAL" if fallback_rows else "UNAVAILABLE"


def closure(tables: DataFrame, columns: DataFrame, constraints: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, subject) of every violation; empty for a closed inventory.

    tables (table), columns (table, column), constraints (name, table, columns array, ref_table, ref_columns array), members (index, ordinal). Rules: unique keys, existing tables and columns on both ends of
    a reference, equal arity, index ordinals 1..n.
    """
    def found(df: DataFrame, rule: str, subject) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), subject.alias("subject"))

    name = lambda *c: F.concat_ws(".", *c)
    refs = constraints.filter("ref_table IS NOT NULL")
    own = constraints.select("name", "table", F.explode("columns").alias("column"))
    far = refs.select("name", F.col("ref_table").alias("table"), F.explode("ref_columns").alias("column"))
    numbers = members.groupBy("index").agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"))
    parts = [
        found(tables.groupBy("table").count().filter("count > 1"), "DUPLICATE_TABLE", F.col("table")),
        found(columns.groupBy("table", "column").count().filter("count > 1"), "DUPLICATE_COLUMN", name("table", "column")),
        found(columns.join(tables, "table", "left_anti"), "UNKNOWN_TABLE", name("table", "column")),
        found(refs.join(tables.withColumnRenamed("table", "ref_table"), "ref_table", "left_anti"), "UNKNOWN_REFERENCED_TABLE", F.col("name")),
        found(own.join(columns, ["table", "column"], "left_anti"), "UNKNOWN_CONSTRAINT_COLUMN", name("name", "column")),
        found(far.join(columns, ["table", "column"], "left_anti"), "UNKNOWN_REFERENCED_COLUMN", name("name", "column")),
        found(refs.filter(F.size("columns") != F.size("ref_columns")), "FOREIGN_KEY_ARITY", F.col("name")),
        found(numbers.filter("lo <> 1 OR hi <> n OR d <> n"), "INDEX_ORDINALS", F.col("index")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ddl_evidence(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """DDL index and unique facts (key, role, observation) met with candidates on either endpoint, each observation once; composite members (size > 1) don't count."""
    facts = inventory.filter("size = 1")
    s = candidates.join(facts.filter("role IN ('INDEX', 'UNIQUE', 'PRIMARY')").withColumnRenamed("key", "src_key"), "src_key").select("src_key", "tgt_key", F.lit("SOURCE_INDEX").alias("evidence_type"), "observation")
    t = candidates.join(facts.filter("role IN ('UNIQUE', 'PRIMARY')").withColumnRenamed("key", "tgt_key"), "tgt_key").select("src_key", "tgt_key", F.lit("TARGET_UNIQUE").alias("evidence_type"), "observation")
    return s.unionByName(t).distinct()
