"""Lineage facts: scores, merging, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import lineage_score, transform_rank


def scored(lineage: DataFrame) -> DataFrame:
    return lineage.withColumn("confidence", lineage_score(F.col("flow"), F.col("transform")))


def known_targets(lineage: DataFrame, tables: DataFrame | None, temporary: DataFrame | None = None) -> DataFrame:
    """Lineage into tables of the catalog (table), none of them temporary; without a catalog, into any table."""
    table = F.regexp_replace("target", r"\.[^.]*$", "")
    out = lineage.withColumn("__t", table)
    if tables is not None:
        out = out.join(tables.select(F.col("table").alias("__t")).distinct(), "__t", "left_semi")
    if temporary is not None:
        out = out.join(temporary.select(F.col("table").alias("__t")).distinct(), "__t", "left_anti")
    return out.filter(~F.col("__t").startswith("#")).drop("__t")


def merged(lineage: DataFrame) -> DataFrame:
    """(flow, transform, sources, target, confidence, observations): one row for each flow, transform, sorted sources and target; the confidence of the first by ordinal stays."""
    rows = lineage.withColumn("sources", F.array_sort("sources"))
    return rows.groupBy("flow", "transform", "sources", "target").agg(F.min_by("confidence", "ordinal").alias("confidence"), F.count("*").alias("observations"), F.min("ordinal").alias("ordinal"))


def fingerprint(lineage: DataFrame) -> Column:
    return F.concat(F.col("flow"), F.lit(":"), F.col("transform"), F.lit(":"), F.array_join("sources", ","), F.lit("->"), F.col("target"))


def edges(lineage: DataFrame) -> DataFrame:
    """(src, tgt, transform, flow, confidence): a row for each source column."""
    return lineage.select(F.explode("sources").alias("src"), F.col("target").alias("tgt"), "transform", "flow", "confidence")


def dominant(lineage: DataFrame) -> DataFrame:
    """The dominant transform of each (source, target)."""
    return edges(lineage).groupBy("src", "tgt").agg(F.max_by("transform", transform_rank(F.col("transform"))).alias("transform"), F.max("confidence").alias("confidence"))


def bridged(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """As-of join of local rowsets: a use (name, line, ...) meets the latest declaration (name, line, source) at or before its line; declarations of equal line that disagree, and blocked ones (source null), give nothing.

    Both sides are laid in one order by name and line, and each use takes what was last declared: linear, without pairing a use with the declarations before.
    """
    d = declared.groupBy("name", F.col("line").alias("decl_line")).agg(F.when(F.countDistinct("source") + F.max(F.col("source").isNull().cast("int")) == 1, F.max("source")).alias("source"))
    own = [c for c in uses.columns if c not in ("name", "line")]
    rows = uses.select("name", "line", F.struct(*own, F.lit(True).alias("__use")).alias("u"), F.lit(None).cast("struct<source:string,decl_line:bigint>").alias("d"))
    decl = d.select("name", F.col("decl_line").alias("line"), F.lit(None).cast(rows.schema["u"].dataType).alias("u"), F.struct("source", F.col("decl_line").cast("bigint").alias("decl_line")).alias("d"))
    order = W.partitionBy("name").orderBy("line", F.col("u").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = rows.unionByName(decl).withColumn("d", F.last("d", ignorenulls=True).over(order)).filter("u IS NOT NULL AND d.source IS NOT NULL")
    return met.select("name", "line", *[F.col(f"u.`{c}`").alias(c) for c in own], F.col("d.source").alias("source"), F.col("d.decl_line").cast(dict(declared.dtypes)["line"]).alias("decl_line"))
