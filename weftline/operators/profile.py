"""Inclusion profiling of column pairs: one distinct set for each column, shared by all its pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import noisy_or, ratio_text


@dataclass(frozen=True)
class Options:
    """Thresholds of the decision and budgets of the candidates."""

    max_pairs: int = 1000
    max_targets: int = 3
    containment: float = 0.98
    overlap: float = 0.80
    mismatch: float = 0.50
    min_distinct: int = 20
    min_rows: int = 100
    profile_declared: bool = False
    profile_unindexed: bool = False
    live: bool = True


PRIORITY = ("DECLARED", "SQL_PREDICATE", "NAMING", "CO_OCCURRENCE")


def values(df: DataFrame, column: str, name: str) -> DataFrame:
    """(col, v, n): the distinct non-null values of a column as text, with their counts; the pre-aggregation that all pairs share."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).select(F.lit(name).alias("col"), "v", "n")


def metrics(columns: dict[str, tuple[DataFrame, str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """(src_key, tgt_key, rows, source_distinct, matched, missing, target_distinct) for each pair of names in `columns`.

    Every column is scanned and made distinct once; pairs then share one join on (pair's target, value), which shuffles distinct values only, and values spread over tasks
    by their hash, so a frequent value is one row. Nulls are ignored on both sides.
    """
    used = sorted({c for p in pairs for c in p})
    every = None
    for name in used:
        one = values(*columns[name], name)
        every = one if every is None else every.unionByName(one)
    spark = next(iter(columns.values()))[0].sparkSession
    by_source: dict[str, list[str]] = {}
    for s, t in pairs:
        by_source.setdefault(s, []).append(t)
    targets = F.create_map(*[x for s, ts in by_source.items() for x in (F.lit(s), F.array(*map(F.lit, ts)))])
    sources = every.filter(F.col("col").isin(*by_source)).select("col", "v", "n", F.explode(targets[F.col("col")]).alias("target"))
    goals = every.filter(F.col("col").isin(*{t for _, t in pairs})).select(F.col("col").alias("target"), "v", F.lit(1).alias("hit"))
    met = sources.join(goals, ["target", "v"], "left").groupBy(F.col("col").alias("src_key"), F.col("target").alias("tgt_key")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("source_distinct"), F.count("hit").alias("matched")
    )
    sizes = goals.groupBy("target").agg(F.count("*").alias("target_distinct")).withColumnRenamed("target", "tgt_key")
    listed = spark.createDataFrame(pairs, "src_key string, tgt_key string")
    out = listed.join(met, ["src_key", "tgt_key"], "left").join(sizes, "tgt_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("src_key", "tgt_key", zero("rows"), zero("source_distinct"), zero("matched"), F.greatest(F.lit(0), F.coalesce(F.col("source_distinct") - F.col("matched"), F.lit(0))).cast("long").alias("missing"), zero("target_distinct"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / b))).otherwise(F.lit(0.0))


def decide(measured: DataFrame, options: Options = Options(), declared: Column | None = None, conditional: Column | None = None) -> DataFrame:
    """measured with containment, overlap, evidence_type (VALUE_CONTAINMENT_HIGH, else VALUE_OVERLAP_HIGH, else null), ratio (as text) and negative.

    Containment excludes overlap; negative evidence is independent of both, and only for unconditional declared keys of a live source. An empty source gives neither.
    """
    s, m, t = F.col("source_distinct"), F.col("matched"), F.col("target_distinct")
    contain, over = _share(m, s), _share(m, F.when(t > 0, F.least(s, t)).otherwise(s))
    enough = s >= options.min_distinct
    kind = F.when((F.col("rows") > 0) & enough & (contain >= options.containment), "VALUE_CONTAINMENT_HIGH").when((F.col("rows") > 0) & enough & (m > 0) & (over >= options.overlap), "VALUE_OVERLAP_HIGH")
    is_declared = declared if declared is not None else F.lit(False)
    is_conditional = conditional if conditional is not None else F.lit(False)
    missing = _share(F.col("missing"), s)
    negative = is_declared & ~is_conditional & F.lit(options.live) & enough & (F.col("rows") >= options.min_rows) & (missing >= options.mismatch)
    return measured.withColumns({
        "containment": contain, "overlap": over, "evidence_type": kind,
        "ratio": F.when(kind == "VALUE_CONTAINMENT_HIGH", ratio_text(contain)).when(kind == "VALUE_OVERLAP_HIGH", ratio_text(over)),
        "negative": F.coalesce(negative, F.lit(False)), "missing_ratio": F.when(negative, ratio_text(missing)),
    })


def confidence(decided: DataFrame) -> DataFrame:
    """decided with the confidence of its profile evidence."""
    scores = F.array(
        F.when(F.col("evidence_type") == "VALUE_CONTAINMENT_HIGH", F.lit("0.30").cast("decimal(12,10)")).when(F.col("evidence_type") == "VALUE_OVERLAP_HIGH", F.lit("0.20").cast("decimal(12,10)")),
        F.when(F.col("negative"), F.lit("-0.30").cast("decimal(12,10)")),
    )
    return decided.withColumn("confidence", noisy_or(scores))


def eligible(candidates: DataFrame, columns: DataFrame, indexes: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """candidates (src_key, tgt_key, declared, ...) that may be profiled: both are columns, of equal type names ignoring case; declared keys only if asked; targets must lead an index if index facts exist.

    columns: (key, type); indexes: (key), one row for each leading index column.
    """
    types = columns.select(F.col("key"), F.lower("type").alias("type"))
    out = candidates.filter(~F.col("src_key").endswith("*") & ~F.col("tgt_key").endswith("*"))
    out = out.join(types.withColumnsRenamed({"key": "src_key", "type": "__s"}), "src_key").join(types.withColumnsRenamed({"key": "tgt_key", "type": "__t"}), "tgt_key")
    out = out.filter(F.col("__s") == F.col("__t")).drop("__s", "__t")
    if not options.profile_declared:
        out = out.filter(~F.coalesce("declared", F.lit(False)))
    if indexes is not None and not options.profile_unindexed:
        out = out.join(indexes.select(F.col("key").alias("tgt_key")).distinct(), "tgt_key", "left_semi")
    return out


def budgeted(candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """The candidates within the budgets: the first of each pair, then at most max_targets for a source, then at most max_pairs, by priority, observations (most first), source, target and subtype."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("priority")), F.lit(0))
    order = [F.when(rank > 0, rank).otherwise(len(PRIORITY) + 1).cast("int").alias("__rank"), F.desc("observations"), F.col("src_key"), F.col("tgt_key"), F.col("subtype")]
    ranked = candidates.withColumn("__rank", order[0])
    order[0] = F.col("__rank")
    one = ranked.withColumn("__i", F.row_number().over(W.partitionBy("src_key", "tgt_key").orderBy(*order))).filter("__i = 1")
    few = one.withColumn("__i", F.row_number().over(W.partitionBy("src_key").orderBy(*order))).filter(F.col("__i") <= options.max_targets)
    return few.orderBy(*order).limit(options.max_pairs).drop("__i", "__rank")


def new_relationships(decided: DataFrame) -> DataFrame:
    """Pairs that no other evidence proposes become relationships only by containment."""
    return decided.filter(F.col("evidence_type") == "VALUE_CONTAINMENT_HIGH")


def in_namespace(df: DataFrame, key: str, scope: str | None) -> DataFrame:
    """Rows whose catalog (the first of four parts of the key) is blank or the scope's; without a scope, blank only."""
    parts = F.split(F.col(key), r"\.")
    catalog = F.when(F.size(parts) > 3, parts[0]).otherwise("")
    return df.filter((catalog == "") | (catalog == F.lit(scope or "")))
