"""Naming evidence by equi-joins on computed stems; no pair of columns is tried that no rule can match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import singular

RULES = ("TABLE_ID", "ID_SUFFIX_TO_ID", "SELF_ROLE_ID", "USER_CONFIGURED")
#: Parts of a rule's sources that meet its targets on their own.
SALT = 32
OUT = ["src_key", "tgt_key", "rule", "direction_hint"]


@dataclass(frozen=True)
class Matcher:
    """How a user rule finds an endpoint: a table and a column, each by "equals", "suffix" or "any", or by an exact key."""

    table: str = "any"
    table_value: str = ""
    column: str = "equals"
    column_value: str = ""
    key: str = ""


@dataclass(frozen=True)
class UserRule:
    name: str
    source: Matcher
    target: Matcher


def table_id(columns: DataFrame) -> DataFrame:
    """columns (key, table, column), lower case: `<stem>_id` points to `id` of the table whose singular is the stem. Not where the table is named by its stem, and only where the reverse doesn't match as well."""
    targets = columns.filter("`column` = 'id'").select(F.col("key").alias("tgt_key"), F.col("table").alias("t"), singular(F.col("table")).alias("stem")).filter("stem <> t")
    sources = columns.filter(F.col("column").endswith("_id")).select(F.col("key").alias("src_key"), F.col("table").alias("s"), F.regexp_replace("column", "_id$", "").alias("stem"))
    return sources.join(targets, "stem").filter("s <> t").select("src_key", "tgt_key", F.lit("TABLE_ID").alias("rule"), F.lit("SOURCE_TO_TARGET").alias("direction_hint")).distinct()


def _parts(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    named = lambda p: columns.select(F.col("key").alias(f"{p}_key"), F.col("table").alias(f"{p}_table"), F.col("column").alias(f"{p}_column"))
    return candidates.join(named("src"), "src_key").join(named("tgt"), "tgt_key")


def id_suffix(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """Of candidate pairs, `*_id` -> `id` of another table where the column's and the table's stems are equal or one ends in `_` and the other."""
    both = _parts(candidates, columns)
    flipped = both.select(*[F.col(c.replace("src", "§").replace("tgt", "src").replace("§", "tgt")).alias(c) for c in both.columns if c[:3] in ("src", "tgt")])
    both = both.select(*flipped.columns).unionByName(flipped)
    own, stem = F.regexp_replace("src_column", "_id$", ""), singular(F.col("tgt_table"))
    near = (own == stem) | own.endswith(F.concat(F.lit("_"), stem)) | stem.endswith(F.concat(F.lit("_"), own))
    hit = both.filter(F.col("src_column").endswith("_id") & (F.col("tgt_column") == "id") & (F.col("src_table") != F.col("tgt_table")) & near)
    return hit.select("src_key", "tgt_key", F.lit("ID_SUFFIX_TO_ID").alias("rule"), F.lit("SOURCE_TO_TARGET").alias("direction_hint")).distinct()


def self_role(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """Of candidate pairs in one table (a self join), `*_id` -> `id`."""
    both = _parts(candidates, columns).filter("src_table = tgt_table")
    ahead = both.filter(F.col("src_column").endswith("_id") & (F.col("tgt_column") == "id")).select("src_key", "tgt_key")
    back = both.filter(F.col("tgt_column").endswith("_id") & (F.col("src_column") == "id")).select(F.col("tgt_key").alias("src_key"), F.col("src_key").alias("tgt_key"))
    return ahead.unionByName(back).select("src_key", "tgt_key", F.lit("SELF_ROLE_ID").alias("rule"), F.lit("SOURCE_TO_TARGET").alias("direction_hint")).distinct()


def _matching(columns: DataFrame, m: Matcher, prefix: str) -> DataFrame:
    """The matched columns, with the part of the column's name before its suffix."""
    out = columns
    if m.key:
        out = out.filter(F.col("key") == m.key)
    else:
        for part, how, value in (("table", m.table, m.table_value), ("column", m.column, m.column_value)):
            if how == "equals":
                out = out.filter(F.col(part) == value)
            elif how == "suffix":
                out = out.filter(F.col(part).endswith(value))
    stem = F.regexp_replace(F.regexp_replace("column", f"{m.column_value}$" if m.column == "suffix" else "$^", ""), "^[a-z]_", "")
    return out.select(F.col("key").alias(f"{prefix}_key"), F.col("table").alias(f"{prefix}_table"), stem.alias("stem"))


def user_rules(columns: DataFrame, rules: list[UserRule]) -> DataFrame:
    """Every user rule's matches between different tables. Where both sides match by column suffix, the rest of the names (without a one-letter prefix) must agree, so the join has a key. A side that names one
    key is a constant, and needs no join. Other rules pair all matches of both sides, as they ask for: the smaller side's (a catalog's columns that one rule names) is spread, the other is split over tasks."""
    out = None
    for r in rules:
        if r.target.key or r.source.key:
            fixed, other, at, to = (r.target.key, r.source, "tgt", "src") if r.target.key else (r.source.key, r.target, "src", "tgt")
            known = columns.filter(F.col("key") == fixed).select("key").distinct()
            hit = _matching(columns, other, to).withColumn(f"{at}_key", F.lit(fixed)).withColumn(f"{at}_table", F.lit(fixed.rpartition(".")[0])).join(known.select(F.col("key").alias(f"{at}_key")), f"{at}_key", "left_semi")
        else:
            a, b = _matching(columns, r.source, "src"), _matching(columns, r.target, "tgt")
            if r.source.column == "suffix" and r.target.column == "suffix":
                hit = a.join(b, "stem")
            else:
                salt = F.pmod(F.xxhash64("src_key"), F.lit(SALT)).cast("int")
                hit = a.drop("stem").withColumn("__salt", salt).join(b.drop("stem").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), "__salt")
        one = hit.filter("src_table <> tgt_table").select("src_key", "tgt_key", F.lit(f"USER_CONFIGURED:{r.name}").alias("rule"), F.lit("SOURCE_TO_TARGET").alias("direction_hint"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def first_match(evidence: DataFrame) -> DataFrame:
    """Of the built-in rules' matches of a pair, the first by rule order; user rules all stay."""
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    built = evidence.filter(~F.col("rule").startswith("USER_CONFIGURED"))
    pair = W.partitionBy(F.least("src_key", "tgt_key"), F.greatest("src_key", "tgt_key")).orderBy(order, "src_key", "tgt_key")
    return built.withColumn("__i", F.row_number().over(pair)).filter("__i = 1").drop("__i").unionByName(evidence.filter(F.col("rule").startswith("USER_CONFIGURED")))


def merged(evidence: DataFrame) -> DataFrame:
    """(id, src_key, tgt_key, rule, direction_hint), one row for each source, target and rule, in order; hints that disagree give none."""
    hint = F.when(F.min("direction_hint") == F.max("direction_hint"), F.min("direction_hint"))
    out = evidence.groupBy("src_key", "tgt_key", "rule").agg(hint.alias("direction_hint"))
    return out.select(F.concat(F.lit("naming:"), "src_key", F.lit("->"), "tgt_key", F.lit(":"), "rule").alias("id"), *OUT).orderBy("src_key", "tgt_key", "rule")


def attach(evidence: DataFrame, naming: DataFrame) -> DataFrame:
    """NAMING_MATCH evidence for column co-occurrences that have SQL predicate evidence and no naming match yet, in either direction of the pair."""
    from .evidence import PREDICATES, unordered

    pairs = evidence.filter("relation_type = 'CO_OCCURRENCE'").groupBy("src_key", "tgt_key", "relation_type").agg(
        F.bool_or(F.col("evidence_type").isin(*PREDICATES)).alias("sql"), F.bool_or(F.col("evidence_type") == "NAMING_MATCH").alias("named")
    )
    hits = naming.select(unordered(F.col("src_key"), F.col("tgt_key")).alias("u"), "rule").groupBy("u").agg(F.min("rule").alias("detail"))
    open_ = pairs.filter("sql AND NOT named").withColumn("u", unordered(F.col("src_key"), F.col("tgt_key")))
    return open_.join(hits, "u").select("src_key", "tgt_key", "relation_type", F.lit("NAMING_MATCH").alias("evidence_type"), F.lit("0.20").cast("decimal(12,10)").alias("score"), "detail")
