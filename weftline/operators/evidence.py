"""Evidence: folding, summaries, merging into relationships, direction and subtype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import SQL_LIKE, noisy_or, repeat_score, subtype_rank
from .hot import HOT_ROWS, hot_join

OBSERVATION = ("src_key", "tgt_key", "relation_type", "evidence_type", "source_type", "source", "score", "detail", "conditions")
PREDICATES = ("SQL_LOG_JOIN", "SQL_LOG_SUBQUERY_IN", "SQL_LOG_EXISTS", "VIEW_JOIN", "TRIGGER_REFERENCE", "PROCEDURE_JOIN")


def exact_fold(evidence: DataFrame, key: tuple[str, ...] = OBSERVATION) -> DataFrame:
    """One row for each distinct observation (conditions included), with its number of occurrences and smallest ordinal."""
    own = [c for c in key if c in evidence.columns]
    times = F.col("occurrences") if "occurrences" in evidence.columns else F.lit(1)
    return evidence.groupBy(*own).agg(F.sum(times).cast("long").alias("occurrences"), F.min("ordinal").alias("ordinal"))


def summaries(evidence: DataFrame, samples: int = 5, keys: tuple[str, ...] = ("src_key", "tgt_key"), attributes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (keys, evidence_type, source_type, source, score): observation count, first and last detail by ordinal, up to `samples` details, whether there are more, and the attributes on which all observations agree.

    The samples are the first ones by ordinal: rows are ranked inside their group, and only the first `samples` of each are collected, so a group's rows are never gathered whole.
    """
    group = [*keys, "evidence_type", "source_type", "source", "score"]
    folded = exact_fold(evidence.select(*group, "detail", "ordinal", *attributes, *([F.col("occurrences")] if "occurrences" in evidence.columns else [])), tuple(group) + ("detail",) + attributes)
    folded = folded.withColumn("__i", F.row_number().over(W.partitionBy(*group).orderBy("ordinal", "detail")))
    agree = [F.when((F.min(a) == F.max(a)) & (F.count(a) == F.count("*")), F.min(a)).alias(a) for a in attributes]
    main = folded.groupBy(*group).agg(
        F.sum("occurrences").alias("observations"), F.min_by("detail", "ordinal").alias("first_detail"), F.max_by("detail", "ordinal").alias("last_detail"),
        F.count("*").alias("__n"), F.array_sort(F.collect_list(F.when(F.col("__i") <= samples, F.struct("ordinal", "detail")))).alias("__s"), *agree,
    )
    return main.withColumn("samples", F.transform("__s", lambda s: s["detail"])).withColumn("truncated", F.col("__n") > samples).drop("__n", "__s")


def repeated(evidence: DataFrame, keys: tuple[str, ...] = ("src_key", "tgt_key")) -> DataFrame:
    """REPEATED_OBSERVATION rows: for SQL-like evidence seen at n > 1 distinct locations (source and detail), 0.10 * (1 - 1 / n)."""
    places = evidence.filter(F.col("evidence_type").isin(*SQL_LIKE)).groupBy(*keys).agg(F.countDistinct("source", "detail").alias("locations"))
    return places.filter("locations > 1").select(*keys, F.lit("REPEATED_OBSERVATION").alias("evidence_type"), repeat_score(F.col("locations")).alias("score"), "locations")


def merge_key(src: Column, tgt: Column, relation_type: Column) -> Column:
    """Table-level co-occurrence is unordered; everything else is type:source->target."""
    tables = (relation_type == "CO_OCCURRENCE") & src.endswith("*") & tgt.endswith("*")
    return F.when(tables, F.concat(F.lit("CO_OCCURRENCE:"), F.least(src, tgt), F.lit("<->"), F.greatest(src, tgt))).otherwise(F.concat(relation_type, F.lit(":"), src, F.lit("->"), tgt))


def unordered(src: Column, tgt: Column) -> Column:
    return F.concat(F.least(src, tgt), F.lit("|"), F.greatest(src, tgt))


def fold_co_occurrence(evidence: DataFrame) -> DataFrame:
    """Column co-occurrence of a pair for which a directional key exists takes the key's direction and type. A pair with keys in both directions takes the smaller source."""
    keys = evidence.filter((F.col("relation_type") == "FK_LIKE") & ~F.col("src_key").endswith("*")).groupBy(unordered(F.col("src_key"), F.col("tgt_key")).alias("__u")).agg(F.min(F.struct("src_key", "tgt_key")).alias("__k"))
    both = evidence.withColumn("__u", unordered(F.col("src_key"), F.col("tgt_key"))).join(keys, "__u", "left")
    absorbed = (F.col("relation_type") == "CO_OCCURRENCE") & F.col("__k").isNotNull()
    return both.withColumns({
        "src_key": F.when(absorbed, F.col("__k.src_key")).otherwise(F.col("src_key")), "tgt_key": F.when(absorbed, F.col("__k.tgt_key")).otherwise(F.col("tgt_key")),
        "relation_type": F.when(absorbed, "FK_LIKE").otherwise(F.col("relation_type")),
    }).drop("__u", "__k")


def directed(evidence: DataFrame, unique: DataFrame, hints: DataFrame | None = None, floor: int = HOT_ROWS) -> DataFrame:
    """Evidence under its relationship's direction.

    A key without declared or profiled direction becomes co-occurrence first. Column co-occurrence with SQL predicate evidence becomes FK_LIKE if exactly one endpoint is unique (that one is the
    target), else if the naming hints (src_key, tgt_key) of the pair all agree. unique: (key). Co-occurrence of a column with itself is dropped. The rows of a pair that has very many aren't brought to one task (hot_join).
    """
    u = evidence.withColumn("__u", unordered(F.col("src_key"), F.col("tgt_key")))
    facts = u.groupBy("__u").agg(
        F.min(F.least("src_key", "tgt_key")).alias("__a"), F.max(F.greatest("src_key", "tgt_key")).alias("__b"), F.bool_or(F.col("evidence_type").isin(*PREDICATES)).alias("__sql"),
        F.min(F.when(F.col("evidence_type").isin("METADATA_FOREIGN_KEY", "DDL_FOREIGN_KEY"), F.struct("src_key", "tgt_key"))).alias("__fk"), F.count("*").alias("__n"),
    )
    keys = unique.select(F.col("key")).distinct()
    facts = facts.join(keys.select(F.col("key").alias("__a"), F.lit(True).alias("__ua")), "__a", "left").join(keys.select(F.col("key").alias("__b"), F.lit(True).alias("__ub")), "__b", "left")
    if hints is not None:
        told = hints.groupBy(unordered(F.col("src_key"), F.col("tgt_key")).alias("__u")).agg(F.countDistinct("src_key").alias("__m"), F.min("src_key").alias("__hint"))
        facts = facts.join(told.filter("__m = 1").drop("__m"), "__u", "left")
    else:
        facts = facts.withColumn("__hint", F.lit(None).cast("string"))
    one = F.coalesce("__ua", F.lit(False)) != F.coalesce("__ub", F.lit(False))
    columns = ~F.col("__a").endswith("*") & ~F.col("__b").endswith("*") & (F.col("__a") != F.col("__b"))
    source = F.when(F.col("__fk").isNotNull(), F.col("__fk.src_key")).when(columns & F.col("__sql") & one, F.when(F.col("__ub"), F.col("__a")).otherwise(F.col("__b"))).when(columns & F.col("__sql"), F.col("__hint"))
    out = hot_join(u, facts.select("__u", "__a", "__b", source.alias("__src"), "__n"), ["__u"], "__n", evidence.count(), floor=floor)
    known = F.col("__src").isNotNull()
    out = out.withColumns({
        "src_key": F.when(known, F.col("__src")).otherwise(F.col("__a")), "tgt_key": F.when(known, F.when(F.col("__src") == F.col("__a"), F.col("__b")).otherwise(F.col("__a"))).otherwise(F.col("__b")),
        "relation_type": F.when(known, "FK_LIKE").otherwise("CO_OCCURRENCE"),
    })
    return out.filter(F.col("src_key") != F.col("tgt_key")).drop("__u", "__a", "__b", "__src")


def subtype(relation_type: Column, types: Column) -> Column:
    """The subtype of highest precedence that the set of evidence types supports."""
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    fk = relation_type == "FK_LIKE"
    return (
        F.when(has("METADATA_FOREIGN_KEY"), "DECLARED_FK").when(has("DDL_FOREIGN_KEY"), "DDL_DECLARED_FK").when(fk & has("VALUE_CONTAINMENT_HIGH") & ~has(*PREDICATES), "PROFILE_SUPPORTED_FK")
        .when(fk & has("SQL_LOG_JOIN", "VIEW_JOIN", "PROCEDURE_JOIN", "TRIGGER_REFERENCE"), "INFERRED_JOIN_FK").when(fk & has("SQL_LOG_SUBQUERY_IN", "SQL_LOG_EXISTS"), "INFERRED_SUBQUERY_FK")
        .when(has("NAMING_MATCH") & ~has(*PREDICATES), "NAMING_MATCH").when(has("SQL_LOG_TABLE_CO_OCCURRENCE"), "TABLE_CO_OCCURRENCE").otherwise("COLUMN_CO_OCCURRENCE")
    )


def relationships(evidence: DataFrame, min_confidence: str = "0.30") -> DataFrame:
    """(src_key, tgt_key, relation_type, subtype, confidence, n_evidence, observations), ordered: the merge of directed evidence.

    Each kind of evidence counts once with its best score; repetition adds its bonus; the filter applies to the rounded confidence.
    """
    key = ["src_key", "tgt_key", "relation_type"]
    kinds = evidence.groupBy(*key, "evidence_type").agg(F.max("score").cast("decimal(12,10)").alias("score"), F.count("*").alias("n"))
    again = repeated(evidence, tuple(key)).select(*key, "evidence_type", "score", F.lit(0).cast("long").alias("n"))
    merged = kinds.unionByName(again).groupBy(*key).agg(F.array_sort(F.collect_list("score")).alias("scores"), F.collect_set("evidence_type").alias("types"), F.sum("n").alias("observations"))
    out = merged.select(*key, subtype(F.col("relation_type"), F.col("types")).alias("subtype"), noisy_or(F.col("scores"), F.array_contains("types", "METADATA_FOREIGN_KEY")).alias("confidence"), F.size("types").alias("n_evidence"), "observations")
    return out.filter(F.col("confidence") >= F.lit(min_confidence).cast("decimal(5,4)")).orderBy(F.desc("confidence"), "src_key", "tgt_key", "relation_type")


def best_subtype(df: DataFrame, keys: list[str], column: str = "subtype") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(column, subtype_rank(F.col(column))).alias(column))


def conditional(structural: DataFrame) -> DataFrame:
    """(src_key, tgt_key, conditional, polymorphic) from structural evidence (src_key, tgt_key, discriminator, operator, value; the last three null without a condition).

    conditional: every observation has a condition. polymorphic: one (source, discriminator, operator) has several targets and several values.
    """
    spread = structural.filter("discriminator IS NOT NULL").groupBy("src_key", "discriminator", "operator").agg((F.countDistinct("tgt_key") > 1).alias("__t"), (F.countDistinct("value") > 1).alias("__v"))
    sources = spread.groupBy("src_key").agg(F.bool_or(F.col("__t") & F.col("__v")).alias("__poly"))
    own = structural.groupBy("src_key", "tgt_key").agg(F.bool_and(F.col("discriminator").isNotNull()).alias("conditional"), F.bool_or(F.col("discriminator").isNotNull()).alias("__some"))
    return own.join(sources, "src_key", "left").select("src_key", "tgt_key", "conditional", (F.coalesce("__poly", F.lit(False)) & F.col("__some")).alias("polymorphic"))


def adjusted(evidence: DataFrame, adjust: Column) -> DataFrame:
    """Evidence with a plugged-in score: any expression, a Pandas UDF included; a result that is null or outside [-1, 1] fails the query."""
    value = adjust.cast("decimal(12,10)")
    fine = value.isNotNull() & value.between(F.lit(-1), F.lit(1))
    return evidence.withColumn("score", F.when(fine, value).otherwise(F.raise_error(F.lit("an adjusted score must lie between -1 and 1")).cast("decimal(12,10)")))


def without_repeated_references(naming_refs: DataFrame) -> DataFrame:
    return naming_refs.dropDuplicates(["src_key", "tgt_key", "evidence_ref"])
