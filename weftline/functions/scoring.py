"""Scores and confidences. Confidence is decimal arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of each kind of evidence.
EVIDENCE = {
    "METADATA_FOREIGN_KEY": "0.98", "DDL_FOREIGN_KEY": "0.90", "VIEW_JOIN": "0.72", "PROCEDURE_JOIN": "0.70", "TRIGGER_REFERENCE": "0.65", "SQL_LOG_JOIN": "0.55",
    "SQL_LOG_SUBQUERY_IN": "0.58", "SQL_LOG_EXISTS": "0.58", "SQL_LOG_COLUMN_CO_OCCURRENCE": "0.40", "SQL_LOG_TABLE_CO_OCCURRENCE": "0.25", "NAMING_MATCH": "0.20", "SOURCE_INDEX": "0.10",
    "TARGET_UNIQUE": "0.18", "COLUMN_TYPE_COMPATIBLE": "0.08", "VALUE_CONTAINMENT_HIGH": "0.30", "VALUE_OVERLAP_HIGH": "0.20", "VALUE_MISMATCH": "-0.30",
}
REPEAT_MOST = "0.10"
#: Types whose distinct locations make a repeated observation.
SQL_LIKE = ("SQL_LOG_JOIN", "SQL_LOG_SUBQUERY_IN", "SQL_LOG_EXISTS", "VIEW_JOIN", "PROCEDURE_JOIN", "TRIGGER_REFERENCE", "SQL_LOG_COLUMN_CO_OCCURRENCE", "SQL_LOG_TABLE_CO_OCCURRENCE")
LINEAGE = {"DIRECT": "0.90", "AGGREGATE": "0.80", "CUMULATIVE": "0.80", "COALESCE": "0.75", "ARITHMETIC": "0.75", "CONCAT_FORMAT": "0.70", "CASE_WHEN": "0.65", "FUNCTION_CALL": "0.65", "WINDOW_DERIVED": "0.50", "UNKNOWN": "0.35"}
LINEAGE_CONTROL = "0.55"
SUBTYPES = ("TABLE_CO_OCCURRENCE", "COLUMN_CO_OCCURRENCE", "NAMING_MATCH", "INFERRED_SUBQUERY_FK", "INFERRED_JOIN_FK", "PROFILE_SUPPORTED_FK", "DDL_DECLARED_FK", "DECLARED_FK")
#: Merging lineage: a later transform dominates an earlier one.
DOMINANCE = ("DIRECT", "UNKNOWN", "CASE_WHEN", "FUNCTION_CALL", "CONCAT_FORMAT", "COALESCE", "ARITHMETIC", "WINDOW_DERIVED", "AGGREGATE", "CUMULATIVE")
#: Classifying one expression tree: the first that occurs in it counts.
CLASSIFICATION = ("CASE_WHEN", "CUMULATIVE", "AGGREGATE", "WINDOW_DERIVED", "COALESCE", "CONCAT_FORMAT", "ARITHMETIC", "FUNCTION_CALL", "DIRECT")
FUNCTIONS = (
    dict.fromkeys(("sum", "avg", "count", "min", "max"), "AGGREGATE") | dict.fromkeys(("row_number", "rank", "dense_rank", "ntile", "lag", "lead"), "WINDOW_DERIVED")
    | {"coalesce": "COALESCE", "nvl": "COALESCE"} | dict.fromkeys(("concat", "format", "to_char", "group_concat", "listagg"), "CONCAT_FORMAT")
)

#: Narrow enough that a product of two keeps all its digits.
D = "decimal(20,18)"


def lookup(column: Column, values: dict[str, str] | tuple[str, ...], kind: str = "decimal(12,10)") -> Column:
    """A constant map as CASE, which stays in generated code; a tuple maps to positions."""
    items = list(values.items() if isinstance(values, dict) else ((v, i) for i, v in enumerate(values)))
    out = F.when(column == items[0][0], F.lit(items[0][1]).cast(kind))
    for key, value in items[1:]:
        out = out.when(column == key, F.lit(value).cast(kind))
    return out


def evidence_score(evidence_type: Column) -> Column:
    return lookup(evidence_type, EVIDENCE)


def significant(x: Column) -> Column:
    """A decimal in [0, 1] rounded half up to 12 significant digits."""
    return F.when(x >= 0.1, F.round(x, 12)).when(x >= 0.01, F.round(x, 13)).when(x >= 0.001, F.round(x, 14)).otherwise(F.round(x, 15)).cast(D)


def noisy_or(scores: Column, has_metadata_key: Column | None = None) -> Column:
    """(1 - product of 1 - positive scores) * product of 1 + negative scores, of an array of decimals; with a metadata key at least 0.95; between 0 and 0.99; 4 decimals, half up.

    Null and empty arrays give 0; null scores are ignored. Products are kept to 12 significant digits.
    """
    one = F.lit("1").cast(D)
    scores = scores.cast(f"array<{D}>")
    misses = F.aggregate(scores, one, lambda p, s: significant((p * F.when(s > 0, one - s).otherwise(one)).cast(D)))
    damps = F.aggregate(scores, one, lambda p, s: significant((p * F.when(s < 0, one + s).otherwise(one)).cast(D)))
    least = F.lit("0").cast(D) if has_metadata_key is None else F.when(has_metadata_key, F.lit("0.95").cast(D)).otherwise(F.lit("0").cast(D))
    value = F.coalesce(F.round(((one - misses) * damps).cast(D), 12), F.lit("0").cast(D))
    return F.round(F.least(F.greatest(value, least), F.lit("0.99").cast(D)), 4).cast("decimal(5,4)")


def repeat_score(locations: Column) -> Column:
    """0.10 * (1 - 1 / n) for n > 1 distinct locations, else null."""
    most = F.lit(REPEAT_MOST).cast("decimal(12,10)")
    return F.when(locations > 1, (most - most / locations.cast("decimal(12,0)")).cast("decimal(12,10)"))


def ratio_text(x: Column) -> Column:
    """6 decimals, half up, without trailing zeros."""
    text = F.round(x.cast("decimal(38,18)"), 6).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def transform_rank(transform: Column) -> Column:
    return lookup(transform, DOMINANCE, "int")


def subtype_rank(subtype: Column) -> Column:
    return lookup(subtype, SUBTYPES, "int")


def lineage_score(flow: Column, transform: Column) -> Column:
    return F.when(flow == "CONTROL", F.lit(LINEAGE_CONTROL).cast("decimal(5,4)")).otherwise(F.coalesce(lookup(transform, LINEAGE, "decimal(5,4)"), F.lit("0.35").cast("decimal(5,4)")))


def token_estimate(text: Column) -> Column:
    """ceil(ceil(ascii / 4) + other characters + 64, with 15 % added)."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    base = F.ceil((F.length(text) - other) / F.lit(4)) + other + 64
    return F.ceil(base.cast("decimal(20,0)") * F.lit("1.15").cast("decimal(3,2)")).cast("long")


def stable_id(prefix: str, *parts: Column) -> Column:
    """SHA-256 of the parts, each with its length in bytes before it, so that no two lists of parts read alike; a null part differs from an empty one."""
    framed = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";")), F.lit("-1:;")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat(*framed), 256))


def singular(word: Column) -> Column:
    """ies -> y; es is dropped after ss, x, z, ch and sh; s is dropped from words of over three letters."""
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 3), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def canonical_key(catalog: Column, schema: Column, table: Column, column: Column) -> Column:
    """catalog.schema.table.column in lower case, stripped; a missing column is *."""
    fold = lambda c: F.lower(F.trim(c.cast("string")))
    return F.concat_ws(".", F.nullif(fold(catalog), F.lit("")), F.nullif(fold(schema), F.lit("")), fold(table), F.coalesce(F.nullif(fold(column), F.lit("")), F.lit("*")))
