"""All queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import catalog, evidence, graph, lineage, naming, profile, semantic
from ..session import checkpoint
from ..sources import logs, results, scripts
from . import examples, profiles, relational, scan

KEYS = {
    "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "customer": ["c_nationkey", "c_custkey"], "supplier": ["s_nationkey", "s_suppkey"],
    "nation": ["n_regionkey", "n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"], "events": ["user_id"],
}
PAIRS = [
    ("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey"),
    ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("nation.n_regionkey", "region.r_regionkey"), ("events.user_id", "customer.c_custkey"), ("part.p_partkey", "supplier.s_suppkey"),
]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# profiling
def _columns(spark: SparkSession, d: str, pairs=PAIRS) -> dict[str, tuple[DataFrame, str]]:
    return {k: (_t(spark, d, k.split(".")[0]), k.split(".")[1]) for p in pairs for k in p}


def ind_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profile.metrics(_columns(spark, d), PAIRS)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return profile.decide(ind_metrics(spark, d), declared=~F.col("src_key").startswith("events"))


def ind_evidence(spark: SparkSession, d: str) -> DataFrame:
    out = profile.confidence(_decided(spark, d))
    return out.select("src_key", "tgt_key", F.round("containment", 6).alias("containment"), F.round("overlap", 6).alias("overlap"), "evidence_type", "ratio", F.col("confidence").cast("double").alias("confidence")).orderBy(F.desc("confidence"), "src_key", "tgt_key")


def ind_negative(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("src_key", "tgt_key", "negative", "missing_ratio")


_METRICS = " UNION ALL ".join(
    f"SELECT '{s}' AS src_key, '{t}' AS tgt_key, (SELECT count({s.split('.')[1]}) FROM {s.split('.')[0]}) AS rows, (SELECT count(DISTINCT {s.split('.')[1]}) FROM {s.split('.')[0]}) AS source_distinct, "
    f"(SELECT count(DISTINCT {s.split('.')[1]}) FROM {s.split('.')[0]} WHERE {s.split('.')[1]} IN (SELECT {t.split('.')[1]} FROM {t.split('.')[0]} WHERE {t.split('.')[1]} IS NOT NULL)) AS matched, (SELECT count(DISTINCT {t.split('.')[1]}) FROM {t.split('.')[0]}) AS target_distinct"
    for s, t in PAIRS
)
_DECIDED = f"""WITH m AS ({_METRICS}), r AS (SELECT *, greatest(source_distinct - matched, 0) AS missing,
  CASE WHEN source_distinct > 0 THEN least(1.0, matched / source_distinct) ELSE 0.0 END AS containment,
  CASE WHEN least(source_distinct, CASE WHEN target_distinct > 0 THEN target_distinct ELSE source_distinct END) > 0 THEN least(1.0, matched / least(source_distinct, CASE WHEN target_distinct > 0 THEN target_distinct ELSE source_distinct END)) ELSE 0.0 END AS overlap FROM m),
e AS (SELECT *, CASE WHEN rows > 0 AND source_distinct >= 20 AND containment >= 0.98 THEN 'VALUE_CONTAINMENT_HIGH' WHEN rows > 0 AND source_distinct >= 20 AND matched > 0 AND overlap >= 0.8 THEN 'VALUE_OVERLAP_HIGH' END AS evidence_type FROM r)"""
_RATIO = "regexp_replace(regexp_replace(round({0}, 6)::DECIMAL(18,6)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def profile_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of key columns of different tables: the candidates that the budgets then cut."""
    keys = [f"{t}.{c}" for t, cs in KEYS.items() for c in cs]
    rows = [(a, b, (len(a) * 7 + len(b) * 3) % 4, (len(a) * len(b)) % 9) for a in keys for b in keys if a.split(".")[0] != b.split(".")[0]]
    return spark.createDataFrame(rows, "src_key string, tgt_key string, p int, observations int").withColumn("priority", F.element_at(F.array(*map(F.lit, profile.PRIORITY)), F.col("p") + 1)).withColumn("subtype", F.lit("COLUMN_CO_OCCURRENCE")).drop("p")


_CANDIDATES = "SELECT a.k AS src_key, b.k AS tgt_key, (length(a.k) * 7 + length(b.k) * 3) % 4 AS p, (length(a.k) * length(b.k)) % 9 AS observations FROM (VALUES {0}) a(k), (VALUES {0}) b(k) WHERE split_part(a.k, '.', 1) <> split_part(b.k, '.', 1)".format(", ".join(f"('{t}.{c}')" for t, cs in KEYS.items() for c in cs))


def profile_topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    return profile.budgeted(profile_candidates(spark, d)).select("src_key", "tgt_key", "priority", "observations")


def profile_budget(spark: SparkSession, d: str) -> DataFrame:
    return profile.budgeted(profile_candidates(spark, d), profile.Options(max_pairs=11)).select("src_key", "tgt_key", "priority", "observations")


def profile_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = profile_candidates(spark, d).withColumn("declared", F.col("observations") == 0)
    return profile.eligible(rows, _catalog(spark, d)).select("src_key", "tgt_key")


# evidence
def observations(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as observations of column pairs."""
    kinds = ["SQL_LOG_JOIN", "SQL_LOG_SUBQUERY_IN", "SQL_LOG_EXISTS", "NAMING_MATCH", "TARGET_UNIQUE", "VALUE_CONTAINMENT_HIGH", "VALUE_MISMATCH"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") - 1) % 7 + 1)
    return _t(spark, d, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_partkey") % 40, F.lit(".a")).alias("src_key"), F.concat(F.lit("t"), F.col("l_suppkey") % 25, F.lit(".b")).alias("tgt_key"), F.lit("CO_OCCURRENCE").alias("relation_type"),
        kind.alias("evidence_type"), F.col("l_returnflag").alias("source_type"), F.col("l_linestatus").alias("source"), scoring.evidence_score(kind).alias("score"), F.concat(F.lit("d"), F.col("l_orderkey") % 11).alias("detail"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.when(F.col("l_orderkey") % 5 > 0, F.lit("kind")).alias("discriminator"), F.lit("EQUALS").alias("operator"), (F.col("l_orderkey") % 3).cast("string").alias("value"),
    )


_SCORE = "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.EVIDENCE.items()) + " END"
_OBS = f"""WITH k AS (SELECT *, (ARRAY['SQL_LOG_JOIN','SQL_LOG_SUBQUERY_IN','SQL_LOG_EXISTS','NAMING_MATCH','TARGET_UNIQUE','VALUE_CONTAINMENT_HIGH','VALUE_MISMATCH'])[(l_linenumber - 1) % 7 + 1] AS k FROM lineitem),
obs AS (SELECT 't' || (l_partkey % 40) || '.a' AS src_key, 't' || (l_suppkey % 25) || '.b' AS tgt_key, 'CO_OCCURRENCE' AS relation_type, k AS evidence_type, l_returnflag AS source_type, l_linestatus AS source, ({_SCORE})::DOUBLE AS score,
  'd' || (l_orderkey % 11) AS detail, l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_orderkey % 5 > 0 THEN 'kind' END AS discriminator, 'EQUALS' AS operator, (l_orderkey % 3)::VARCHAR AS value FROM k)
"""


def exact_fold(spark: SparkSession, d: str) -> DataFrame:
    return evidence.exact_fold(observations(spark, d)).withColumn("score", F.col("score").cast("double"))


def summary_group_first_last_sample(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.summaries(observations(spark, d))
    return out.select("src_key", "tgt_key", "evidence_type", "source_type", "source", "observations", "first_detail", "last_detail", F.array_join("samples", ",").alias("samples"), "truncated")


def consensus_attributes(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.summaries(observations(spark, d), attributes=("operator", "value"))
    return out.select("src_key", "tgt_key", "evidence_type", "source_type", "source", "operator", "value")


def repeated_observation(spark: SparkSession, d: str) -> DataFrame:
    return evidence.repeated(observations(spark, d)).select("src_key", "tgt_key", F.round(F.col("score").cast("double"), 8).alias("score"), "locations")


def noisy_or_confidence(spark: SparkSession, d: str) -> DataFrame:
    kinds = observations(spark, d).groupBy("src_key", "tgt_key", "evidence_type").agg(F.max("score").alias("score"))
    return kinds.groupBy("src_key", "tgt_key").agg(scoring.noisy_or(F.array_sort(F.collect_list("score"))).cast("double").alias("confidence"))


def min_confidence_sort(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.relationships(observations(spark, d), "0.60")
    return out.select("src_key", "tgt_key", "relation_type", "subtype", F.col("confidence").cast("double").alias("confidence"), "observations")


def direction_unique_flip(spark: SparkSession, d: str) -> DataFrame:
    unique = _t(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey") % 12, F.lit(".b")).alias("key"))
    out = evidence.directed(observations(spark, d), unique)
    return out.groupBy("src_key", "tgt_key", "relation_type").agg(F.count("*").alias("n"))


def fold_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    keys = rows.filter("src_key IN ('t1.a', 't2.a', 't3.a')").select("src_key", "tgt_key").distinct().select(F.col("tgt_key").alias("src_key"), F.col("src_key").alias("tgt_key"), F.lit("FK_LIKE").alias("relation_type"), F.lit("DDL_FOREIGN_KEY").alias("evidence_type"))
    both = rows.select("src_key", "tgt_key", "relation_type", "evidence_type").unionByName(keys)
    return evidence.fold_co_occurrence(both).groupBy("src_key", "tgt_key", "relation_type").agg(F.count("*").alias("n"))


def subtype_precedence(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("k"), F.element_at(F.array(*map(F.lit, scoring.SUBTYPES)), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("subtype"), "o_orderstatus").filter("o_orderstatus <> 'P'")
    return evidence.best_subtype(rows, ["k", "o_orderstatus"])


def conditional_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    return evidence.conditional(observations(spark, d))


# catalog and naming
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.columns_of({t: _t(spark, d, t) for t in TABLES})


def unique_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unique_columns({t: _t(spark, d, t) for t in KEYS}, [(t, c) for t, cs in KEYS.items() for c in cs])


def type_compatible_pairs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.type_compatible(profile_candidates(spark, d), _catalog(spark, d)).select("src_key", "tgt_key", "evidence_type", F.col("score").cast("double").alias("score"))


def naming_stem_join(spark: SparkSession, d: str) -> DataFrame:
    """Names made of the nations: `<nation>s` tables with `id`, and columns that refer to them."""
    n = _t(spark, d, "nation").select(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")).alias("w"), "n_nationkey", "n_regionkey")
    ids = n.select(F.concat("w", F.lit("s")).alias("table"), F.lit("id").alias("column"))
    refs = n.select(F.concat(F.lit("fact"), F.col("n_regionkey")).alias("table"), F.concat("w", F.lit("_id")).alias("column"))
    columns = ids.unionByName(refs).withColumn("key", F.concat_ws(".", "table", "column"))
    return naming.merged(naming.table_id(columns)).select("id", "src_key", "tgt_key", "rule", "direction_hint")


def naming_user_rules(spark: SparkSession, d: str) -> DataFrame:
    M = naming.Matcher
    rules = [naming.UserRule("custkey", M(column="suffix", column_value="custkey"), M(table="equals", table_value="customer", column_value="c_custkey")), naming.UserRule("nationkey", M(column="suffix", column_value="nationkey"), M(key="nation.n_nationkey"))]
    return naming.user_rules(_catalog(spark, d), rules)


def inventory_merge_full_outer(spark: SparkSession, d: str) -> DataFrame:
    live = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_mktsegment").alias("type")).filter("k % 3 <> 0")
    ddl = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("type")).filter("k % 4 <> 0")
    return catalog.merged_inventory(live, ddl, ["k"])


def inventory_closure_anti(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose part or supplier number, folded, isn't among the kept ones: references that don't close."""
    facts = _t(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("fact_id"))
    return semantic.dangling(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("ref"), "l_orderkey", "l_linenumber"), facts)


def inventory_closure_rules(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    fk = spark.createDataFrame([("fk1", "orders", ["o_custkey"], "customer", ["c_custkey"]), ("fk2", "orders", ["o_nokey"], "customer", ["c_custkey"]), ("fk3", "nation", ["n_regionkey"], "continent", ["k"]), ("fk4", "lineitem", ["l_orderkey", "l_partkey"], "orders", ["o_orderkey"])], "name string, table string, columns array<string>, ref_table string, ref_columns array<string>")
    members = spark.createDataFrame([("i1", 1), ("i1", 2), ("i2", 1), ("i2", 3)], "index string, ordinal int")
    return catalog.closure(c.select("table").distinct(), c.select("table", "column"), fk, members)


# graph
def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A sparse graph of suppliers and parts: each supplier points to two numbers below it."""
    s = _t(spark, d, "supplier")
    a = s.select(F.concat(F.lit("n"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("n"), F.floor(F.col("s_suppkey") / 2)).alias("tgt"), F.lit("0.9000").cast("decimal(5,4)").alias("confidence"))
    b = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("n"), F.col("s_suppkey") - 1).alias("tgt"), F.lit("0.6000").cast("decimal(5,4)").alias("confidence"))
    return a.unionByName(b).filter("src <> tgt").withColumn("kind", F.lit("RELATIONSHIP")).withColumn("support", F.lit(2))


_EDGES = """e AS (SELECT 'n' || s_suppkey AS src, 'n' || (s_suppkey // 2) AS tgt, 0.9::DECIMAL(38,18) AS c FROM supplier
  UNION ALL SELECT 'n' || s_suppkey, 'n' || (s_suppkey - 1), 0.6::DECIMAL(38,18) FROM supplier WHERE s_suppkey % 3 = 0)"""
_PATHS = f"""WITH RECURSIVE {_EDGES},
p AS (SELECT src, tgt, [src, tgt] AS path, c::DOUBLE AS least, 1 AS hops, 2::BIGINT AS support FROM e WHERE src <> tgt
  UNION ALL SELECT p.src, e.tgt, list_append(p.path, e.tgt), least(p.least, e.c::DOUBLE), hops + 1, support * 2 FROM p JOIN e ON e.src = p.tgt WHERE e.src <> e.tgt AND NOT list_contains(p.path, e.tgt) AND hops < 5 AND least(p.least, e.c::DOUBLE) * pow(0.75, hops) >= 0.1),
found AS (SELECT * FROM p WHERE hops >= 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = p.src AND e.tgt = p.tgt))
"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(checkpoint(_edges(spark, d)), checkpoint=checkpoint)


def edges_aggregate(spark: SparkSession, d: str) -> DataFrame:
    facts = _t(spark, d, "lineitem").select(F.concat(F.lit("t"), F.col("l_suppkey") % 30).alias("src"), F.col("l_returnflag").alias("tgt"), F.lit("RELATIONSHIP").alias("kind"), (F.col("l_linenumber") / 10).cast("decimal(5,4)").alias("confidence"), F.concat(F.lit("r"), F.col("l_orderkey") % 6).alias("ref"))
    return graph.edges(facts).select("src", "tgt", F.col("confidence").cast("double").alias("confidence"), "support", F.array_join("refs", ",").alias("refs"))


def paths_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("src", "tgt", F.array_join("path", ">").alias("path"), F.col("path_length").cast("long").alias("path_length"))


def path_confidence_decay(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select(F.array_join("path", ">").alias("path"), F.col("confidence").cast("double").alias("confidence"))


def support_combinations(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select(F.array_join("path", ">").alias("path"), F.col("support").cast("long").alias("support"))


def paths_per_pair_limit(spark: SparkSession, d: str) -> DataFrame:
    return graph.limited(_paths(spark, d), 1).select("src", "tgt", F.array_join("path", ">").alias("path"))


def paths_reverse_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Derived relationships over the keys between the folder's tables."""
    fk = spark.createDataFrame([(s, t) for s, t in PAIRS[:7]], "src string, tgt string").withColumn("confidence", F.lit("0.9000").cast("decimal(5,4)"))
    return graph.derived_relationships(fk, checkpoint=checkpoint).select("src", "tgt", F.array_join("path", ">").alias("path"), F.col("path_length").cast("long").alias("path_length"), F.col("confidence").cast("double").alias("confidence"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"))
    return graph.components(pairs, checkpoint=checkpoint)


# lineage and semantic layer
def _lineage(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as lineage facts."""
    transforms = F.array(*map(F.lit, scoring.DOMINANCE))
    kinds = F.array(*map(F.lit, ("INSERT_SELECT", "UPDATE_SET", "MERGE_UPDATE", "DELETE")))
    rows = _t(spark, d, "lineitem").select(
        F.array(F.concat(F.lit("p"), F.col("l_partkey") % 20, F.lit(".x")), F.concat(F.lit("q"), F.col("l_partkey") % 7, F.lit(".y"))).alias("sources"), F.concat(F.lit("s"), F.col("l_suppkey") % 10, F.lit(".z")).alias("target"),
        F.when(F.col("l_linenumber") == 7, "CONTROL").otherwise("VALUE").alias("flow"), F.element_at(transforms, (F.col("l_orderkey") % 10 + 1).cast("int")).alias("transform"), F.element_at(kinds, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("mapping"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("ref"), F.when(F.col("l_returnflag") == "R", "PROCEDURE").when(F.col("l_returnflag") == "A", "TRIGGER").otherwise("PLAIN_SQL").alias("source_type"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("obj"), F.col("l_orderkey") % 6)).alias("object_name"), F.concat(F.lit("file"), F.col("l_orderkey") % 3).alias("source_name"),
    )
    return lineage.scored(rows)


_LINE_SCORE = "CASE WHEN flow = 'CONTROL' THEN 0.55 ELSE CASE transform " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.LINEAGE.items()) + " END END"
_LIN = f"""WITH l0 AS (SELECT ['p' || (l_partkey % 20) || '.x', 'q' || (l_partkey % 7) || '.y'] AS sources, 's' || (l_suppkey % 10) || '.z' AS target, CASE WHEN l_linenumber = 7 THEN 'CONTROL' ELSE 'VALUE' END AS flow,
  (ARRAY[{", ".join(f"'{t}'" for t in scoring.DOMINANCE)}])[l_orderkey % 10 + 1] AS transform, (ARRAY['INSERT_SELECT','UPDATE_SET','MERGE_UPDATE','DELETE'])[l_orderkey % 4 + 1] AS mapping, l_orderkey * 10 + l_linenumber AS ordinal, 'f' || (l_orderkey % 50) AS ref,
  CASE l_returnflag WHEN 'R' THEN 'PROCEDURE' WHEN 'A' THEN 'TRIGGER' ELSE 'PLAIN_SQL' END AS source_type, CASE WHEN l_returnflag <> 'N' THEN 'obj' || (l_orderkey % 6) END AS object_name, 'file' || (l_orderkey % 3) AS source_name FROM lineitem),
lin AS (SELECT *, ({_LINE_SCORE})::DOUBLE AS confidence FROM l0),
ev0 AS (SELECT *, CASE WHEN source_type = 'PROCEDURE' THEN 'ROUTINE:' || object_name WHEN source_type = 'TRIGGER' THEN 'TRIGGER:' || object_name ELSE 'WRITE:' || source_name || ':' || split_part(target, '.', 1) END AS k,
  CASE WHEN mapping LIKE 'INSERT%' THEN 'INSERT' WHEN mapping LIKE 'UPDATE%' THEN 'UPDATE' WHEN mapping LIKE 'MERGE%' THEN 'MERGE' WHEN mapping LIKE 'DELETE%' THEN 'DELETE' ELSE 'WRITE' END AS op FROM lin WHERE flow <> 'CONTROL'),
ev AS (SELECT k, array_to_string(list_sort(list_distinct(array_agg(op))), ',') AS operations, list_sort(list_distinct(flatten(array_agg(sources)))) AS inputs, list_sort(list_distinct(array_agg(target))) AS outputs, array_to_string(list_sort(list_distinct(array_agg(ref))), ',') AS references_,
  round(avg(confidence), 4) AS confidence FROM ev0 GROUP BY k)
"""


def lineage_merge(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.merged(_lineage(spark, d))
    return out.select("flow", "transform", F.array_join("sources", ",").alias("sources"), "target", F.col("confidence").cast("double").alias("confidence"), "observations", "ordinal")


def lineage_dominant_transform(spark: SparkSession, d: str) -> DataFrame:
    return lineage.dominant(_lineage(spark, d)).withColumn("confidence", F.col("confidence").cast("double"))


def event_group(spark: SparkSession, d: str) -> DataFrame:
    e = semantic.events(_lineage(spark, d))
    return e.select("kind", "subject", F.array_join("operations", ",").alias("operations"), F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"), F.array_join("references", ",").alias("refs"), F.col("confidence").cast("double").alias("confidence"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("p"), F.col("l_partkey") % 20, F.lit(".x"))
    t = F.concat(F.lit("s"), F.col("l_suppkey") % 10, F.lit(".z"))
    return _t(spark, d, "lineitem").select(s.alias("src_key"), t.alias("tgt_key")).distinct().select(F.concat_ws("->", "src_key", "tgt_key").alias("fact_id"), F.lit("FK_LIKE").alias("relation_type"), F.lit("RELATIONSHIP").alias("fact_type"), "src_key", "tgt_key")


_FACTS = "facts AS (SELECT DISTINCT 'p' || (l_partkey % 20) || '.x' AS src_key, 's' || (l_suppkey % 10) || '.z' AS tgt_key FROM lineitem)"


def event_association(spark: SparkSession, d: str) -> DataFrame:
    e = checkpoint(semantic.events(_lineage(spark, d))).withColumn("event_id", F.concat_ws(":", "kind", "subject"))
    return semantic.associations(e, checkpoint(_facts(spark, d))).withColumnRenamed("event_id", "event")


def reference_closure(spark: SparkSession, d: str) -> DataFrame:
    refs = _t(spark, d, "orders").select(F.col("o_custkey").alias("ref"), F.col("o_orderkey").alias("holder"))
    return semantic.dangling(refs, _t(spark, d, "customer").filter("c_nationkey <> 7").select(F.col("c_custkey").alias("fact_id")))


def triplets(spark: SparkSession, d: str) -> DataFrame:
    e, facts = checkpoint(semantic.events(_lineage(spark, d))), checkpoint(_facts(spark, d))
    n = facts.select("src_key", "tgt_key", F.lit("TABLE_ID").alias("rule"))
    return semantic.triplets(facts, e, _lineage(spark, d), n).groupBy(F.regexp_extract("predicate", "^[A-Z_]*", 0).alias("predicate")).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def _kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(columns, facts, events, join paths) of the line items, each worked out once: nodes, edges and their checks read them many times."""
    facts, lines = checkpoint(_facts(spark, d)), _lineage(spark, d)
    ends = lines.select("sources", "target").distinct().select(F.explode(F.concat("sources", F.array("target"))).alias("key"))
    keys = facts.select(F.explode(F.array("src_key", "tgt_key")).alias("key")).unionByName(ends).distinct()
    columns = checkpoint(keys.select("key", F.substring_index("key", ".", 1).alias("table"), F.lit(1).alias("ordinal")))
    return columns, facts, checkpoint(semantic.events(lines)), facts.select(F.concat(F.lit("path:"), "fact_id").alias("path_id"), F.array("src_key", "tgt_key").alias("path"))


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return semantic.kg_nodes(*_kg(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return semantic.kg_edges(*_kg(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def kg_closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure of a graph whose nodes lack table p3 and its column."""
    columns, *rest = _kg(spark, d)
    return semantic.kg_problems(semantic.kg_nodes(columns.filter("`table` <> 'p3'"), *rest), semantic.kg_edges(columns, *rest))


def stable_id_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", scoring.stable_id("customer", F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey"))).alias("id"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", scoring.token_estimate(F.concat(F.col("props"), F.lit("é"), F.col("event_type"))).alias("tokens"))


def shard_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    w = _t(spark, d, "orders").groupBy(F.concat(F.lit("t"), F.col("o_custkey") % 60).alias("owner")).agg((F.count("*") * 40).alias("tokens")).withColumn("component", F.lit("c"))
    return semantic.pack(w, target=40_000)


def input_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_id", "event_type", F.octet_length("props").alias("bytes"))
    return logs.windows(rows, "event_type", ["event_id"], "bytes", 4096)


def asof_local_rowset(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as uses of a customer's temporary rowset, urgent ones as its declarations: each use meets the latest declaration at or before it."""
    o = _t(spark, d, "orders")
    uses = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("line"))
    decl = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("line"), F.concat(F.lit("src"), F.col("o_orderkey") % 9).alias("source"))
    return lineage.bridged(uses, decl)


def canonical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return results.canonical_fingerprint(_t(spark, d, "nation").withColumn("generated_at", F.current_timestamp()))


# SQL text
def _examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(examples.STATEMENTS, "source_name string, ordinal int, sql string, source_type string")


def sql_relationships(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_statements(_examples(spark))["relationships"].withColumn("confidence", F.col("confidence").cast("double"))


def sql_lineage(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_statements(_examples(spark))["lineage"].withColumn("sources", F.array_join("sources", ",")).withColumn("confidence", F.col("confidence").cast("double"))


def sql_naming(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_statements(_examples(spark))["naming"]


def ddl_facts(spark: SparkSession, d: str) -> DataFrame:
    return scan.analysed(_examples(spark)).select(F.explode("ddl").alias("x")).select("x.*")


def _cases(spark: SparkSession, cases) -> DataFrame:
    return scan.analysed(spark.createDataFrame([(name, 0, sql) for name, sql, _ in cases], "source_name string, ordinal int, sql string"))


def sql_pair_cases(spark: SparkSession, d: str) -> DataFrame:
    """The column pairs of a statement of each shape."""
    return _cases(spark, examples.PAIR_CASES).select(F.col("source_name").alias("name"), F.explode("pairs").alias("p")).select("name", "p.src_key", "p.tgt_key", "p.evidence_type")


def sql_lineage_cases(spark: SparkSession, d: str) -> DataFrame:
    """The flows of a statement of each shape."""
    return _cases(spark, examples.LINEAGE_CASES).select(F.col("source_name").alias("name"), F.explode("lineage").alias("l")).select("name", "l.flow", "l.transform", F.array_join("l.sources", ",").alias("sources"), "l.target")


def _part_statements(spark: SparkSession, d: str) -> DataFrame:
    """Parts read as statements: a join for each part, and the definition of each table that is joined to."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("a"), (F.col("p_size") % 12).alias("b"))
    joins = p.select(F.lit("q").alias("source_name"), F.col("p_partkey").cast("int").alias("ordinal"), F.format_string("SELECT x.id FROM fact%d x JOIN dim%d y ON y.id = x.dim%d_id", "a", "b", "b").alias("sql"), F.lit("PLAIN_SQL").alias("source_type"))
    tables = p.select("b").distinct().select(F.lit("ddl").alias("source_name"), F.col("b").alias("ordinal"), F.format_string("CREATE TABLE dim%d (id BIGINT PRIMARY KEY, name VARCHAR(9))", "b").alias("sql"), F.lit("DDL_FILE").alias("source_type"))
    return joins.unionByName(tables)


def sql_part_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The whole scan over a statement for each part."""
    out = scan.scan_statements(_part_statements(spark, d))["relationships"]
    return out.select("src_key", "tgt_key", "relation_type", "subtype", F.col("confidence").cast("double").alias("confidence"), "observations")


def _order_statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(examples.ORDER_STATEMENTS, "source_name string, ordinal int, sql string, source_type string")


def _order_scan(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Statements over the folder's tables, with these tables as the catalog: enhanced, bridged over a temporary table, profiled on the data."""
    M = naming.Matcher
    rule = naming.UserRule("custkey", M(column="suffix", column_value="_custkey"), M(key="customer.c_custkey"))
    return scan.scan_statements(_order_statements(spark), scan.Config(dialect="postgres", user_rules=(rule,)), tables={t: _t(spark, d, t) for t in TABLES})


def scan_catalog_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _order_scan(spark, d)["evidence"].select("src_key", "tgt_key", "evidence_type", F.col("score").cast("double").alias("score")).distinct()


def scan_catalog_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _order_scan(spark, d)["relationships"].select("src_key", "tgt_key", "relation_type", "subtype", F.col("confidence").cast("double").alias("confidence"), "conditional", "polymorphic")


def scan_catalog_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _order_scan(spark, d)["lineage"].select("flow", "transform", F.array_join("sources", ",").alias("sources"), "target")


def derived_naming(spark: SparkSession, d: str) -> DataFrame:
    """Paths of naming matches: each nation's table is named by the next one's column."""
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".id")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey") + 1, F.lit(".id")).alias("tgt"))
    edges = n.withColumn("kind", F.lit("NAMING")).withColumn("confidence", F.lit("0.2000").cast("decimal(5,4)")).withColumn("support", F.lit(1))
    return graph.paths(edges, naming_graph=True, checkpoint=checkpoint).select("src", "tgt", F.array_join("path", ">").alias("path"), F.col("confidence").cast("double").alias("confidence"))


def fact_budget(spark: SparkSession, d: str) -> DataFrame:
    """The 40 facts of a budget over derived relationships, lineage and naming."""
    one = lambda t, k, v, name: _t(spark, d, t).select(F.concat(F.lit(name), F.col(k)).alias("src"), F.lit("t").alias("tgt"), F.array(F.lit(name)).alias("path"), (F.col(v) % 7 / 10).alias("confidence"), F.lit(name).alias("kind"))
    made = graph.fact_budget(one("region", "r_regionkey", "r_regionkey", "r"), one("nation", "n_nationkey", "n_regionkey", "n"), one("supplier", "s_suppkey", "s_nationkey", "s"), 40)
    return made[0].unionByName(made[1]).unionByName(made[2]).select("kind", "src", F.round("confidence", 2).alias("confidence"))


def profile_selection(spark: SparkSession, d: str) -> DataFrame:
    """The grammar profile of a dialect and version."""
    rows = [(a, b, p.id if p else None, why) for a, b, *_ in examples.VERSIONS for p, why in [profiles.select(a, b)]]
    return spark.createDataFrame(rows, "dialect string, version string, profile string, reason string")


def profile_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Statements with a newer feature, read with an older profile."""
    out = None
    for i, (dialect, version, sql, _) in enumerate(examples.FEATURE_CASES):
        one = scan.analysed(spark.createDataFrame([(sql,)], "sql string"), dialect, version=version).select(F.lit(i).alias("i"), "diagnostic")
        out = one if out is None else out.unionByName(one)
    return out


def routine_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The pairs and flows of routines of each dialect."""
    read = scan.analysed(spark.createDataFrame([(name, 0, sql, "PROCEDURE") for name, sql, _ in examples.ROUTINE_CASES], "source_name string, ordinal int, sql string, source_type string"))
    pairs = read.select(F.col("source_name").alias("name"), F.explode("pairs").alias("p")).select("name", F.lit("PAIR").alias("kind"), F.col("p.src_key").alias("src"), F.col("p.tgt_key").alias("tgt"))
    flows = read.select(F.col("source_name").alias("name"), F.explode("lineage").alias("l")).filter("l.flow = 'VALUE'").select("name", F.lit("FLOW").alias("kind"), F.array_join("l.sources", ",").alias("src"), F.col("l.target").alias("tgt"))
    return pairs.unionByName(flows).distinct()


def owner_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as items that touch two tables each, planned into shards by component."""
    a = F.col("o_custkey") % 40
    items = _t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.array(F.concat(F.lit("t"), a), F.concat(F.lit("u"), a % 7)).alias("tables"), F.col("o_orderpriority").alias("payload"))
    return semantic.planned(items, target=60_000, checkpoint=checkpoint)


def evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    """The facts of nations, customers' segments and parts' brands as an evidence graph, and what refers to none of them."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    facts = semantic.evidence_graph({"tables": n, "columns": _t(spark, d, "customer").select("c_mktsegment", "c_nationkey"), "events": _t(spark, d, "part").select("p_brand")})
    tables = facts.filter("fact_type = 'tables'").select(F.lit("triplets").alias("section"), "fact_id", F.get_json_object("payload", "$.n_nationkey").cast("int").alias("k"))
    documents = tables.select("section", F.concat(F.lit("i"), F.col("k") % 20).alias("item_id"), F.when(F.col("k") % 6 > 0, F.array(F.when(F.col("k") % 5 == 0, F.lit("gone")).otherwise(F.col("fact_id")))).alias("refs"))
    problems = semantic.invalid_references(documents, facts).groupBy(F.col("problem").alias("kind")).agg(F.count("*").alias("n"))
    return facts.groupBy(F.col("fact_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(problems)


def script_framing(spark: SparkSession, d: str) -> DataFrame:
    return scripts.framed(spark.createDataFrame(examples.SCRIPTS, "source_name string, text string"), "mysql")


def customer_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Customers read as MySQL scripts with a changed delimiter, framed: the number of statements of each kind, and the lines that they span."""
    text = F.format_string("-- %s\nCREATE TABLE t%d (a INT);\nDELIMITER //\nCREATE PROCEDURE p%d()\nBEGIN\n  UPDATE t SET a = 1; SELECT ';';\nEND//\nDELIMITER ;\nSELECT %d; SELECT 2\n;", "c_mktsegment", "c_custkey", "c_custkey", "c_nationkey")
    read = scripts.framed(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("source_name"), text.alias("text")), "mysql")
    return read.groupBy("source_name", "source_type", "start_line", "end_line").agg(F.count("*").alias("n"), F.countDistinct("object_name").alias("names"))


def log_statements(spark: SparkSession, d: str) -> DataFrame:
    """Events read as lines of PostgreSQL and MySQL logs, statements on system tables and connections among them."""
    e = _t(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("u"), (F.col("event_id") % 30).alias("v"))
    line = (
        F.when(F.col("event_id") % 5 == 0, F.format_string("2024-05-01 10:00:00 UTC [7] LOG:  statement: SELECT a.id FROM u%d a JOIN v%d b ON b.id = a.v_id;", "u", "v"))
        .when(F.col("event_id") % 5 == 1, F.lit("2024-05-01 10:00:01 UTC [7] LOG:  execute q1: SELECT relname FROM pg_catalog.pg_class"))
        .when(F.col("event_id") % 5 == 2, F.format_string("2024-05-01T10:00:02.000000Z\t   12 Query\tSELECT * FROM u%d WHERE id = 3", "u"))
        .when(F.col("event_id") % 5 == 3, F.lit("2024-05-01T10:00:03.000000Z\t   12 Connect\troot@localhost"))
        .otherwise(F.format_string("2024-05-01T10:00:04.000000Z\t   12 Query\tUPDATE u%d SET n = 1 WHERE k IN (SELECT b.k FROM v%d b)", "u", "v"))
    )
    rows = e.select(F.lit("log").alias("source_name"), line.alias("line"))
    read = logs.postgres(rows).unionByName(logs.mysql_general(rows))
    return logs.without_noise(scan.analysed(read)).groupBy("sql", F.array_join("tables", ",").alias("tables")).agg(F.count("*").alias("n"), F.sum(F.size("pairs")).alias("pairs"))


def _q(*names: str) -> dict:
    return {n: globals()[n] for n in names}


QUERIES = relational.QUERIES | _q(
    "ind_metrics", "ind_evidence", "ind_negative", "profile_topk_per_source", "profile_budget", "profile_eligible", "exact_fold", "summary_group_first_last_sample", "consensus_attributes", "repeated_observation", "noisy_or_confidence",
    "min_confidence_sort", "direction_unique_flip", "fold_cooccurrence", "subtype_precedence", "conditional_polymorphic", "unique_columns", "type_compatible_pairs", "naming_stem_join", "naming_user_rules", "inventory_merge_full_outer",
    "inventory_closure_anti", "inventory_closure_rules", "edges_aggregate", "paths_bounded", "path_confidence_decay", "support_combinations", "paths_per_pair_limit", "paths_reverse_bridge", "connected_components", "lineage_merge",
    "lineage_dominant_transform", "event_group", "event_association", "reference_closure", "triplets", "kg_nodes", "kg_edges", "kg_closure", "stable_id_sha256", "token_estimate", "shard_greedy_pack", "input_windows", "asof_local_rowset",
    "canonical_fingerprint", "sql_relationships", "sql_lineage", "sql_naming", "ddl_facts", "sql_pair_cases", "sql_lineage_cases", "sql_part_relationships", "scan_catalog_evidence", "scan_catalog_relationships", "scan_catalog_lineage", "derived_naming", "fact_budget", "profile_selection", "profile_diagnostics", "routine_bodies", "owner_plan", "evidence_graph", "script_framing", "customer_scripts", "log_statements",
)

_RANK = "CASE p WHEN 0 THEN 'DECLARED' WHEN 1 THEN 'SQL_PREDICATE' WHEN 2 THEN 'NAMING' ELSE 'CO_OCCURRENCE' END"
_TOPK = f"WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY p, observations DESC, src_key, tgt_key) AS i FROM c) SELECT src_key, tgt_key, {_RANK} AS priority, observations FROM r WHERE i <= 3 ORDER BY p, observations DESC, src_key, tgt_key LIMIT "
_TYPES = "t AS (SELECT table_name || '.' || column_name AS key, data_type AS type FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"
_GROUP = "src_key, tgt_key, evidence_type, source_type, source"


def _values(rows, columns: str) -> str:
    """Rows as SQL: what the rules of the texts give, worked out by hand."""
    text = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


#: The evidence of ORDER_STATEMENTS: what the statements show, names suggest, types allow, and the data says.
_ORDER = """WITH c AS (SELECT * FROM (VALUES ('orders.o_custkey', 'customer.c_custkey', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT c_custkey) FROM customer)),
    ('customer.c_nationkey', 'nation.n_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)), (SELECT count(DISTINCT n_nationkey) FROM nation)),
    ('lineitem.l_orderkey', 'orders.o_orderkey', (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), (SELECT count(DISTINCT o_orderkey) FROM orders))) v(src_key, tgt_key, s, m, t)),
  d AS (SELECT *, CASE WHEN s >= 20 AND m / s >= 0.98 THEN 'VALUE_CONTAINMENT_HIGH' WHEN s >= 20 AND m / least(s, t) >= 0.8 THEN 'VALUE_OVERLAP_HIGH' END AS kind FROM c),
  found AS (SELECT src_key, tgt_key, kind AS evidence_type, CASE kind WHEN 'VALUE_CONTAINMENT_HIGH' THEN 0.3 ELSE 0.2 END::DOUBLE AS score FROM d WHERE kind IS NOT NULL
    UNION ALL SELECT src_key, tgt_key, k, v::DOUBLE FROM c CROSS JOIN (VALUES ('COLUMN_TYPE_COMPATIBLE', 0.08), ('TARGET_UNIQUE', 0.18)) e(k, v)
    UNION ALL SELECT * FROM (VALUES ('orders.o_custkey', 'customer.c_custkey', 'SQL_LOG_JOIN', 0.55), ('orders.o_custkey', 'customer.c_custkey', 'NAMING_MATCH', 0.2), ('customer.c_nationkey', 'nation.n_nationkey', 'SQL_LOG_JOIN', 0.55), ('lineitem.l_orderkey', 'orders.o_orderkey', 'SQL_LOG_SUBQUERY_IN', 0.58)) w(a, b, k, v))
"""
_KG = _LIN + f", {_FACTS}, cols AS (SELECT DISTINCT k FROM (SELECT src_key AS k FROM facts UNION ALL SELECT tgt_key FROM facts UNION ALL SELECT unnest(sources) FROM lin UNION ALL SELECT target FROM lin))"
ORACLES = relational.ORACLES | {
    "ind_metrics": f"WITH m AS ({_METRICS}) SELECT *, greatest(source_distinct - matched, 0) AS missing FROM m",
    "ind_evidence": _DECIDED + f" SELECT src_key, tgt_key, round(containment, 6) AS containment, round(overlap, 6) AS overlap, evidence_type, CASE evidence_type WHEN 'VALUE_CONTAINMENT_HIGH' THEN {_RATIO.format('containment')} WHEN 'VALUE_OVERLAP_HIGH' THEN {_RATIO.format('overlap')} END AS ratio, CASE evidence_type WHEN 'VALUE_CONTAINMENT_HIGH' THEN CASE WHEN neg THEN 0.21 ELSE 0.3 END WHEN 'VALUE_OVERLAP_HIGH' THEN CASE WHEN neg THEN 0.14 ELSE 0.2 END ELSE 0 END::DOUBLE AS confidence FROM (SELECT *, NOT starts_with(src_key, 'events') AND source_distinct >= 20 AND rows >= 100 AND missing >= 0.5 * source_distinct AS neg FROM e)",
    "ind_negative": _DECIDED + f" SELECT src_key, tgt_key, neg AS negative, CASE WHEN neg THEN {_RATIO.format('missing / source_distinct')} END AS missing_ratio FROM (SELECT *, NOT starts_with(src_key, 'events') AND source_distinct >= 20 AND rows >= 100 AND missing >= 0.5 * source_distinct AS neg FROM e)",
    "profile_topk_per_source": _TOPK + "1000",
    "profile_budget": _TOPK + "11",
    "profile_eligible": f"WITH c AS ({_CANDIDATES}), {_TYPES} SELECT c.src_key, c.tgt_key FROM c JOIN t a ON a.key = c.src_key JOIN t b ON b.key = c.tgt_key AND a.type = b.type WHERE observations <> 0",
    "type_compatible_pairs": f"WITH c AS ({_CANDIDATES}), {_TYPES} SELECT c.src_key, c.tgt_key, 'COLUMN_TYPE_COMPATIBLE' AS evidence_type, 0.08::DOUBLE AS score FROM c JOIN t a ON a.key = c.src_key JOIN t b ON b.key = c.tgt_key AND a.type = b.type",
    "exact_fold": _OBS + "SELECT src_key, tgt_key, relation_type, evidence_type, source_type, source, score, detail, count(*) AS occurrences, min(ordinal) AS ordinal FROM obs GROUP BY ALL",
    "summary_group_first_last_sample": _OBS + f", f AS (SELECT {_GROUP}, detail, count(*) AS n, min(ordinal) AS ordinal FROM obs GROUP BY ALL) SELECT {_GROUP}, sum(n)::BIGINT AS observations, arg_min(detail, ordinal) AS first_detail, arg_max(detail, ordinal) AS last_detail, array_to_string(list_slice(array_agg(detail ORDER BY ordinal), 1, 5), ',') AS samples, count(*) > 5 AS truncated FROM f GROUP BY {_GROUP}",
    "consensus_attributes": _OBS + f"SELECT {_GROUP}, CASE WHEN count(DISTINCT operator) = 1 THEN min(operator) END AS operator, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM obs GROUP BY {_GROUP}",
    "repeated_observation": _OBS + "SELECT src_key, tgt_key, round(0.1 - 0.1 / n, 8)::DOUBLE AS score, n AS locations FROM (SELECT src_key, tgt_key, count(DISTINCT source || '|' || detail) AS n FROM obs WHERE evidence_type LIKE 'SQL_LOG%' GROUP BY 1, 2) WHERE n > 1",
    "noisy_or_confidence": _OBS + ", k2 AS (SELECT src_key, tgt_key, evidence_type, max(score) AS s FROM obs GROUP BY ALL) SELECT src_key, tgt_key, round(least(0.99, (1 - coalesce(product(1 - s) FILTER (WHERE s > 0), 1)) * coalesce(product(1 + s) FILTER (WHERE s < 0), 1))::DECIMAL(18,12), 4)::DOUBLE AS confidence FROM k2 GROUP BY 1, 2",
    "min_confidence_sort": _OBS + ", n AS (SELECT src_key, tgt_key, count(*) AS observations, count(DISTINCT CASE WHEN evidence_type LIKE 'SQL_LOG%' THEN source || '|' || detail END) AS locs, bool_or(evidence_type LIKE 'SQL_LOG%') AS q, bool_or(evidence_type = 'NAMING_MATCH') AS nm FROM obs GROUP BY 1, 2), k2 AS (SELECT src_key, tgt_key, evidence_type, max(score) AS s FROM obs GROUP BY ALL), m AS (SELECT src_key, tgt_key, coalesce(product(1 - s) FILTER (WHERE s > 0), 1) AS miss, coalesce(product(1 + s) FILTER (WHERE s < 0), 1) AS damp FROM k2 GROUP BY 1, 2), c AS (SELECT n.*, round(least(0.99, (1 - miss * (CASE WHEN locs > 1 THEN 1 - round(0.1 - 0.1 / locs, 10) ELSE 1 END)) * damp)::DECIMAL(18,12), 4)::DOUBLE AS confidence FROM n JOIN m USING (src_key, tgt_key)) SELECT src_key, tgt_key, 'CO_OCCURRENCE' AS relation_type, CASE WHEN nm AND NOT q THEN 'NAMING_MATCH' ELSE 'COLUMN_CO_OCCURRENCE' END AS subtype, confidence, observations FROM c WHERE confidence >= 0.6",
    "direction_unique_flip": _OBS + ", u AS (SELECT DISTINCT 't' || (s_suppkey % 12) || '.b' AS key FROM supplier), p AS (SELECT src_key, tgt_key, count(*) AS n, bool_or(evidence_type LIKE 'SQL_LOG%') AS sql FROM obs GROUP BY 1, 2) SELECT CASE WHEN sql AND tgt_key IN (FROM u) THEN src_key ELSE least(src_key, tgt_key) END AS src_key, CASE WHEN sql AND tgt_key IN (FROM u) THEN tgt_key ELSE greatest(src_key, tgt_key) END AS tgt_key, CASE WHEN sql AND tgt_key IN (FROM u) THEN 'FK_LIKE' ELSE 'CO_OCCURRENCE' END AS relation_type, n FROM p",
    "fold_cooccurrence": _OBS + "SELECT CASE WHEN src_key IN ('t1.a', 't2.a', 't3.a') THEN tgt_key ELSE src_key END AS src_key, CASE WHEN src_key IN ('t1.a', 't2.a', 't3.a') THEN src_key ELSE tgt_key END AS tgt_key, CASE WHEN src_key IN ('t1.a', 't2.a', 't3.a') THEN 'FK_LIKE' ELSE relation_type END AS relation_type, count(*) + CASE WHEN obs.src_key IN ('t1.a', 't2.a', 't3.a') THEN 1 ELSE 0 END AS n FROM obs GROUP BY obs.src_key, obs.tgt_key, obs.relation_type",
    "subtype_precedence": "SELECT o_custkey % 200 AS k, o_orderstatus, (ARRAY[" + ", ".join(f"'{s}'" for s in scoring.SUBTYPES) + "])[max(o_orderkey % 8) + 1] AS subtype FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2",
    "conditional_polymorphic": _OBS + ", s AS (SELECT * FROM obs), p AS (SELECT src_key, bool_or(t > 1 AND v > 1) AS poly FROM (SELECT src_key, discriminator, operator, count(DISTINCT tgt_key) AS t, count(DISTINCT value) AS v FROM s WHERE discriminator IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) SELECT src_key, tgt_key, bool_and(discriminator IS NOT NULL) AS conditional, coalesce(bool_or(poly), false) AND bool_or(discriminator IS NOT NULL) AS polymorphic FROM s LEFT JOIN p USING (src_key) GROUP BY 1, 2",
    "unique_columns": " UNION ALL ".join(f"SELECT '{t}.{c}' AS key, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, count(*) = count(DISTINCT {c}) AS is_unique FROM {t}" for t, cs in KEYS.items() for c in cs),
    "naming_stem_join": "WITH n AS (SELECT lower(regexp_replace(n_name, '[^A-Za-z]', '_', 'g')) AS w, n_regionkey AS r FROM nation), t AS (SELECT w || 's' AS tab, CASE WHEN regexp_matches(w || 's', 'ies$') THEN regexp_replace(w || 's', 'ies$', 'y') WHEN regexp_matches(w || 's', '(ss|x|z|ch|sh)es$') THEN regexp_replace(w || 's', 'es$', '') ELSE regexp_replace(w || 's', 's$', '') END AS stem FROM n) SELECT DISTINCT 'naming:fact' || r || '.' || w || '_id->' || tab || '.id:TABLE_ID' AS id, 'fact' || r || '.' || w || '_id' AS src_key, tab || '.id' AS tgt_key, 'TABLE_ID' AS rule, 'SOURCE_TO_TARGET' AS direction_hint FROM n JOIN t ON t.stem = n.w",
    "naming_user_rules": "SELECT table_name || '.' || column_name AS src_key, 'customer.c_custkey' AS tgt_key, 'USER_CONFIGURED:custkey' AS rule, 'SOURCE_TO_TARGET' AS direction_hint FROM information_schema.columns WHERE column_name LIKE '%custkey' AND table_name <> 'customer' UNION ALL SELECT table_name || '.' || column_name, 'nation.n_nationkey', 'USER_CONFIGURED:nationkey', 'SOURCE_TO_TARGET' FROM information_schema.columns WHERE column_name LIKE '%nationkey' AND table_name <> 'nation'",
    "inventory_merge_full_outer": "WITH a AS (SELECT c_nationkey AS k, max(c_mktsegment) AS type FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_name) AS type FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.type, b.type) AS type, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'BOTH' WHEN a.k IS NOT NULL THEN 'LIVE' ELSE 'DDL' END AS origin FROM a FULL JOIN b ON a.k = b.k",
    "inventory_closure_anti": "SELECT l_partkey AS ref, l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)",
    "edges_aggregate": "SELECT 't' || (l_suppkey % 30) AS src, l_returnflag AS tgt, l_linenumber / 10 AS confidence, count(*) AS support, array_to_string(list_sort(list_distinct(array_agg('r' || (l_orderkey % 6)))), ',') AS refs FROM lineitem GROUP BY 1, 2, 3",
    "paths_bounded": _PATHS + "SELECT src, tgt, array_to_string(path, '>') AS path, hops::BIGINT AS path_length FROM found",
    "path_confidence_decay": _PATHS + "SELECT array_to_string(path, '>') AS path, round((least * pow(0.75, hops - 1))::DECIMAL(18,12), 4)::DOUBLE AS confidence FROM found",
    "support_combinations": _PATHS + "SELECT array_to_string(path, '>') AS path, support FROM found",
    "paths_per_pair_limit": _PATHS + "SELECT src, tgt, array_to_string(min(path), '>') AS path FROM found GROUP BY 1, 2",
    "connected_components": "WITH RECURSIVE e0 AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(cc.component) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS r ON r.node = e.b WHERE cc.component < r.component GROUP BY e.b)) SELECT node, component FROM cc",
    "lineage_merge": _LIN + "SELECT flow, transform, array_to_string(list_sort(sources), ',') AS sources, target, arg_min(confidence, ordinal) AS confidence, count(*) AS observations, min(ordinal) AS ordinal FROM lin GROUP BY flow, transform, list_sort(sources), target",
    "lineage_dominant_transform": _LIN + f"SELECT src, target AS tgt, (ARRAY[{', '.join(f"'{t}'" for t in scoring.DOMINANCE)}])[max(list_position([{', '.join(f"'{t}'" for t in scoring.DOMINANCE)}], transform))] AS transform, max(confidence) AS confidence FROM (SELECT unnest(sources) AS src, target, transform, confidence FROM lin) GROUP BY 1, 2",
    "event_group": _LIN + "SELECT split_part(k, ':', 1) AS kind, substr(k, strpos(k, ':') + 1) AS subject, operations, array_to_string(inputs, ',') AS inputs, array_to_string(outputs, ',') AS outputs, references_ AS refs, confidence FROM ev",
    "event_association": _LIN + f", {_FACTS}, o AS (SELECT k, unnest(outputs) AS key FROM ev), i AS (SELECT DISTINCT k, split_part(unnest(inputs), '.', 1) AS a FROM ev), pairs AS (SELECT DISTINCT i.k, least(a, split_part(o.key, '.', 1)) AS x, greatest(a, split_part(o.key, '.', 1)) AS y FROM i JOIN o USING (k) WHERE a <> split_part(o.key, '.', 1)) SELECT DISTINCT k AS event, src_key || '->' || tgt_key AS fact_id, 'OUTPUT_ENDPOINT' AS via FROM o JOIN facts ON o.key IN (src_key, tgt_key) UNION SELECT k, src_key || '->' || tgt_key, 'TABLE_PAIR' FROM pairs JOIN facts ON x = least(split_part(src_key, '.', 1), split_part(tgt_key, '.', 1)) AND y = greatest(split_part(src_key, '.', 1), split_part(tgt_key, '.', 1))",
    "triplets": _KG + """, fed AS (SELECT DISTINCT i, o, k FROM (SELECT k, unnest(inputs) AS i, outputs FROM ev) CROSS JOIN unnest(outputs) t(o)), l AS (SELECT DISTINCT unnest(sources) AS s, target, transform FROM lin)
        SELECT 'FK_LIKE' AS predicate, count(*) AS n, count(DISTINCT src_key) AS subjects FROM facts UNION ALL SELECT 'NAMED_AS', count(*), count(DISTINCT src_key) FROM facts
        UNION ALL SELECT 'HAS_DIMENSION', count(DISTINCT (split_part(src_key, '.', 1), split_part(tgt_key, '.', 1))), count(DISTINCT split_part(src_key, '.', 1)) FROM facts
        UNION ALL SELECT 'FEEDS_VIA', count(*), count(DISTINCT i) FROM fed UNION ALL SELECT 'LINEAGE_' || transform, count(*), count(DISTINCT s) FROM l GROUP BY transform""",
    "kg_nodes": _KG + """ SELECT 'RELATIONSHIP' AS kind, count(*) AS n, count(*) AS labels FROM facts UNION ALL SELECT 'JoinPath', count(*), count(*) FROM facts UNION ALL SELECT 'PhysicalColumn', count(*), count(*) FROM cols
        UNION ALL SELECT 'PhysicalTable', count(DISTINCT split_part(k, '.', 1)), count(DISTINCT split_part(k, '.', 1)) FROM cols UNION ALL SELECT 'Event', count(*), count(DISTINCT substr(k, strpos(k, ':') + 1)) FROM ev""",
    "kg_edges": _KG + """ SELECT 'TABLE_COLUMN' AS kind, count(*) AS n FROM cols UNION ALL SELECT 'RELATIONSHIP_SOURCE', count(*) FROM facts UNION ALL SELECT 'RELATIONSHIP_TARGET', count(*) FROM facts
        UNION ALL SELECT 'JOIN_PATH_STEP', 2 * count(*) FROM facts UNION ALL SELECT 'EVENT_INPUT', sum(len(inputs))::BIGINT FROM ev UNION ALL SELECT 'EVENT_OUTPUT', sum(len(outputs))::BIGINT FROM ev""",
    "kg_closure": "SELECT 'DANGLING_END' AS problem, kind || ':' || sha256(strlen(name) || ':' || name || ';') AS id FROM (SELECT DISTINCT 'p' || (l_partkey % 20) || '.x' AS key FROM lineitem) CROSS JOIN (VALUES ('table', 'p3'), ('column', 'p3.x')) v(kind, name) WHERE key = 'p3.x'",
    "shard_greedy_pack": """WITH RECURSIVE w AS (SELECT 't' || (o_custkey % 60) AS owner, count(*) * 40 AS tokens FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY owner) AS i FROM w),
        p AS (SELECT i, owner, tokens, tokens AS filled, 0 AS shard_id FROM n WHERE i = 1 UNION ALL SELECT n.i, n.owner, n.tokens, CASE WHEN p.filled > 0 AND p.filled + n.tokens > 40000 THEN n.tokens ELSE p.filled + n.tokens END, CASE WHEN p.filled > 0 AND p.filled + n.tokens > 40000 THEN p.shard_id + 1 ELSE p.shard_id END FROM p JOIN n ON n.i = p.i + 1)
        SELECT owner, tokens, shard_id FROM p""",
    "canonical_fingerprint": "WITH h AS (SELECT sha256(to_json({n_name: n_name, n_nationkey: n_nationkey, n_regionkey: n_regionkey})::VARCHAR) AS h FROM nation), p AS (SELECT substr(h, 1, 2) AS p, count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(8)) + " FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(array_to_string(list_sort(array_agg(concat_ws(':', p, n, " + ", ".join(f"s{i}" for i in range(8)) + "))), ',')) AS fingerprint FROM p",
    "inventory_closure_rules": _values([("UNKNOWN_REFERENCED_TABLE", "fk3"), ("UNKNOWN_CONSTRAINT_COLUMN", "fk2.o_nokey"), ("UNKNOWN_REFERENCED_COLUMN", "fk3.k"), ("FOREIGN_KEY_ARITY", "fk4"), ("INDEX_ORDINALS", "i2")], "rule, subject"),
    "paths_reverse_bridge": _values([(p.split(">")[0], p.split(">")[-1], p, p.count(">"), c) for p, c in examples.BRIDGED], "src, tgt, path, path_length, confidence"),
    "sql_relationships": _values([(*r, False, False) for r in examples.RELATIONSHIPS], "src_key, tgt_key, relation_type, subtype, confidence, n_evidence, observations, conditional, polymorphic"),
    "sql_lineage": _values(examples.LINEAGE, "flow, transform, sources, target, confidence, observations, ordinal"),
    "sql_naming": _values([(f"naming:{s}->{t}:{r}", s, t, r, "SOURCE_TO_TARGET") for s, t, r in examples.NAMING], "id, src_key, tgt_key, rule, direction_hint"),
    "ddl_facts": _values(examples.DDL, "event, name, key, other, position, size, detail"),
    "sql_pair_cases": _values([(name, *p) for name, _, ps in examples.PAIR_CASES for p in ps], "name, src_key, tgt_key, evidence_type"),
    "sql_lineage_cases": _values([(name, *f) for name, _, fs in examples.LINEAGE_CASES for f in fs], "name, flow, transform, sources, target"),
    "sql_part_relationships": "WITH p AS (SELECT 'fact' || (p_partkey % 40) || '.dim' || (p_size % 12) || '_id' AS src_key, 'dim' || (p_size % 12) || '.id' AS tgt_key, count(*) AS n FROM part GROUP BY 1, 2) SELECT src_key, tgt_key, 'FK_LIKE' AS relation_type, 'INFERRED_JOIN_FK' AS subtype, round((1 - 0.45 * 0.82 * 0.8 * (CASE WHEN n > 1 THEN 1 - round(0.1 - 0.1 / n, 10) ELSE 1 END))::DECIMAL(18,12), 4)::DOUBLE AS confidence, n + 2 AS observations FROM p",
    "scan_catalog_evidence": _ORDER + "SELECT src_key, tgt_key, evidence_type, score FROM found",
    "scan_catalog_relationships": _ORDER + ", p AS (SELECT src_key, tgt_key, coalesce(product(1 - score) FILTER (WHERE score > 0), 1) AS miss, coalesce(product(1 + score) FILTER (WHERE score < 0), 1) AS damp, bool_or(evidence_type = 'SQL_LOG_JOIN') AS j, bool_or(evidence_type = 'SQL_LOG_SUBQUERY_IN') AS q FROM found GROUP BY 1, 2), z AS (SELECT *, round(((1 - miss) * damp)::DECIMAL(18,12), 4)::DOUBLE AS confidence FROM p) SELECT src_key, tgt_key, 'FK_LIKE' AS relation_type, CASE WHEN j THEN 'INFERRED_JOIN_FK' WHEN q THEN 'INFERRED_SUBQUERY_FK' ELSE 'PROFILE_SUPPORTED_FK' END AS subtype, confidence, src_key = 'customer.c_nationkey' AS conditional, false AS polymorphic FROM z WHERE confidence >= 0.3",
    "scan_catalog_lineage": _values([("VALUE", "DIRECT", "staged.s_custkey", "customer.c_custkey"), ("VALUE", "AGGREGATE", "orders.o_totalprice", "customer.c_acctbal")], "flow, transform, sources, target"),
    "derived_naming": "WITH RECURSIVE e AS (SELECT n_nationkey AS a FROM nation), p AS (SELECT a AS src, a + 1 AS tgt, 'n' || a || '.id>n' || (a + 1) || '.id' AS path, 1 AS hops FROM e UNION ALL SELECT src, tgt + 1, path || '>n' || (tgt + 1) || '.id', hops + 1 FROM p JOIN e ON e.a = p.tgt WHERE hops < 5 AND 0.2 * pow(0.75, hops) >= 0.1) SELECT 'n' || src || '.id' AS src, 'n' || tgt || '.id' AS tgt, path, round((0.2 * pow(0.75, hops - 1))::DECIMAL(18,12), 4)::DOUBLE AS confidence FROM p WHERE hops >= 2",
    "fact_budget": "WITH f AS (SELECT 1 AS o, 'r' AS kind, 'r' || r_regionkey AS src, r_regionkey % 7 / 10 AS confidence FROM region UNION ALL SELECT 2, 'n', 'n' || n_nationkey, n_regionkey % 7 / 10 FROM nation UNION ALL SELECT 3, 's', 's' || s_suppkey, s_nationkey % 7 / 10 FROM supplier) SELECT kind, src, round(confidence, 2)::DOUBLE AS confidence FROM f ORDER BY o, confidence DESC, src LIMIT 40",
    "profile_selection": _values(examples.VERSIONS, "dialect, version, profile, reason"),
    "profile_diagnostics": _values([(i, d) for i, (*_, d) in enumerate(examples.FEATURE_CASES)], "i, diagnostic"),
    "routine_bodies": _values([(name, *f) for name, _, fs in examples.ROUTINE_CASES for f in fs], "name, kind, src, tgt"),
    "owner_plan": """WITH RECURSIVE i AS (SELECT o_custkey % 40 AS a, ceil((ceil(length(o_orderpriority) / 4) + 64) * 1.15)::BIGINT AS tokens FROM orders), w AS (SELECT a, 't' || a AS owner, sum(tokens)::BIGINT AS tokens FROM i GROUP BY 1), g AS (SELECT a % 7 AS c, min('t' || a) AS component FROM w GROUP BY 1),
        n AS (SELECT owner, tokens, row_number() OVER (ORDER BY component, owner) AS i FROM w JOIN g ON g.c = w.a % 7),
        p AS (SELECT i, owner, tokens, tokens AS filled, 0 AS shard_id FROM n WHERE i = 1 UNION ALL SELECT n.i, n.owner, n.tokens, CASE WHEN p.filled > 0 AND p.filled + n.tokens > 60000 THEN n.tokens ELSE p.filled + n.tokens END, CASE WHEN p.filled > 0 AND p.filled + n.tokens > 60000 THEN p.shard_id + 1 ELSE p.shard_id END FROM p JOIN n ON n.i = p.i + 1)
        SELECT owner, tokens, shard_id FROM p""",
    "evidence_graph": """WITH d AS (SELECT 'i' || (n_nationkey % 20) AS item, n_nationkey % 6 > 0 AS has, n_nationkey % 5 = 0 AS gone FROM nation)
        SELECT 'tables' AS kind, count(*) AS n FROM (SELECT DISTINCT n_nationkey, n_name FROM nation) UNION ALL SELECT 'columns', count(*) FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) UNION ALL SELECT 'events', count(DISTINCT p_brand) FROM part
        UNION ALL SELECT 'REPEATED_ID', count(*) FROM (SELECT item FROM d GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'NO_REFERENCE', count(DISTINCT item) FROM d WHERE NOT has UNION ALL SELECT 'UNKNOWN_REFERENCE', count(DISTINCT item) FROM d WHERE has AND gone""",
    "script_framing": _values(examples.FRAMES, "source_name, ordinal, sql, source_type, object_type, object_name, start_line, end_line, trigger_function, error"),
    "customer_scripts": "SELECT c_mktsegment AS source_name, source_type, a AS start_line, b AS end_line, count(*) AS n, count(DISTINCT CASE source_type WHEN 'DDL_FILE' THEN 't' || c_custkey WHEN 'PROCEDURE' THEN 'p' || c_custkey END) AS names FROM customer CROSS JOIN (VALUES ('DDL_FILE', 1, 2), ('PROCEDURE', 4, 7), ('PLAIN_SQL', 9, 9), ('PLAIN_SQL', 9, 9)) v(source_type, a, b) GROUP BY 1, 2, 3, 4",
    "log_statements": "WITH e AS (SELECT event_id % 5 AS k, 'u' || (user_id % 40) AS u, 'v' || (event_id % 30) AS v FROM events), s AS (SELECT CASE k WHEN 0 THEN 'SELECT a.id FROM ' || u || ' a JOIN ' || v || ' b ON b.id = a.v_id' WHEN 2 THEN 'SELECT * FROM ' || u || ' WHERE id = 3' ELSE 'UPDATE ' || u || ' SET n = 1 WHERE k IN (SELECT b.k FROM ' || v || ' b)' END AS sql, CASE WHEN k = 2 THEN u ELSE u || ',' || v END AS tables, CASE WHEN k = 2 THEN 0 ELSE 1 END AS pairs FROM e WHERE k IN (0, 2, 4)) SELECT sql, tables, count(*) AS n, sum(pairs)::BIGINT AS pairs FROM s GROUP BY 1, 2",
    "reference_closure": "SELECT o_custkey AS ref, o_orderkey AS holder FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)",
    "stable_id_sha256": "SELECT c_custkey, 'customer:' || sha256(strlen(c_name) || ':' || c_name || ';' || strlen(c_mktsegment) || ':' || c_mktsegment || ';' || CASE WHEN c_nationkey > 3 THEN strlen(c_nationkey::VARCHAR) || ':' || c_nationkey || ';' ELSE '-1:;' END) AS id FROM customer",
    "token_estimate": "SELECT event_id, ceil((ceil(a / 4) + n + 64) * 1.15)::BIGINT AS tokens FROM (SELECT event_id, length(regexp_replace(props || 'é' || event_type, '[^\\x00-\\x7F]', '', 'g')) AS a, length(regexp_replace(props || 'é' || event_type, '[\\x00-\\x7F]', '', 'g')) AS n FROM events)",
    "input_windows": "SELECT event_id, event_type, strlen(props)::INTEGER AS bytes, (coalesce(sum(strlen(props)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096)::INTEGER AS \"window\" FROM events",
    "asof_local_rowset": "SELECT u.o_custkey AS name, u.o_orderkey AS line, 'src' || (d.o_orderkey % 9) AS source, d.o_orderkey AS decl_line FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') u ASOF JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') d ON u.o_custkey = d.o_custkey AND u.o_orderkey >= d.o_orderkey",
}
