"""The semantic layer: events, associations, knowledge graph, triplets, owners and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import stable_id, token_estimate

#: Tokens in a shard; and, for shards that a model reads, most tokens of one owner and most shards.
TARGET_TOKENS, MOST_TOKENS, MOST_SHARDS = 240_000, 800_000, 128
SECTIONS = (
    "tables", "columns", "constraints", "indexes", "relationships", "lineage", "naming", "derived_relationships", "derived_lineage", "derived_naming",
    "events", "diagnostics", "triplets", "review_items", "join_paths",
)


def operation(mapping: Column) -> Column:
    return (
        F.when(mapping.startswith("INSERT"), "INSERT").when(mapping.startswith("UPDATE"), "UPDATE").when(mapping.startswith("MERGE"), "MERGE").when(mapping.startswith("UPSERT"), "MERGE")
        .when(mapping.startswith("DELETE"), "DELETE").otherwise("WRITE")
    )


def event_key(source_type: Column, object_name: Column, source_name: Column, target_table: Column) -> Column:
    """Routines and triggers are one event each; other sources one for each target table."""
    return F.when(source_type.isin("PROCEDURE", "FUNCTION"), F.concat(F.lit("ROUTINE:"), object_name)).when(source_type == "TRIGGER", F.concat(F.lit("TRIGGER:"), object_name)).otherwise(F.concat(F.lit("WRITE:"), source_name, F.lit(":"), target_table))


def events(lineage: DataFrame) -> DataFrame:
    """(event_id, kind, subject, operations, inputs, outputs, references, confidence): lineage (sources, target, flow, mapping, confidence, ref, source_type, object_name, source_name) other than CONTROL, grouped; confidence is the mean, 4 decimals.

    A group's identity must agree in all its rows.
    """
    rows = lineage.filter("flow <> 'CONTROL'").withColumn("t", F.regexp_replace("target", r"\.[^.]*$", ""))
    key = event_key(F.col("source_type"), F.coalesce("object_name", "source_name"), F.col("source_name"), F.col("t"))
    flat = rows.withColumn("k", key).select("k", operation(F.col("mapping")).alias("op"), "target", "ref", "confidence", F.explode("sources").alias("input"))
    grouped = flat.groupBy("k").agg(
        F.array_sort(F.collect_set("op")).alias("operations"), F.array_sort(F.collect_set("input")).alias("inputs"), F.array_sort(F.collect_set("target")).alias("outputs"), F.array_sort(F.collect_set("ref")).alias("references"),
    )
    means = rows.withColumn("k", key).groupBy("k").agg(F.round(F.avg(F.col("confidence").cast("decimal(12,6)")), 4).cast("decimal(5,4)").alias("confidence"))
    return grouped.join(means, "k").select(stable_id("event", F.col("k")).alias("event_id"), F.substring_index("k", ":", 1).alias("kind"), F.expr("substring(k, instr(k, ':') + 1)").alias("subject"), "operations", "inputs", "outputs", "references", "confidence")


def identity_conflicts(contributions: DataFrame, key: str, identity: list[str]) -> DataFrame:
    return contributions.groupBy(key).agg(F.countDistinct(F.struct(*identity)).alias("identities")).filter("identities > 1")


def associations(event_rows: DataFrame, relationships: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """(event_id, fact_id, via): relationships (fact_id, src_key, tgt_key) meet events on an output endpoint, or as the unordered pair of an input and an output table; derived lineage on endpoint or table. Each once."""
    table = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    outs = event_rows.select("event_id", F.explode("outputs").alias("key"))
    ends = relationships.select("fact_id", F.explode(F.array("src_key", "tgt_key")).alias("key"))
    by_end = outs.join(ends, "key").select("event_id", "fact_id", F.lit("OUTPUT_ENDPOINT").alias("via"))
    ins = event_rows.select("event_id", F.explode(F.array_distinct(F.transform("inputs", table))).alias("a"))
    outt = event_rows.select("event_id", F.explode(F.array_distinct(F.transform("outputs", table))).alias("b"))
    pairs = ins.join(outt, "event_id").filter("a <> b").select("event_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    rel = relationships.select("fact_id", F.least(table(F.col("src_key")), table(F.col("tgt_key"))).alias("x"), F.greatest(table(F.col("src_key")), table(F.col("tgt_key"))).alias("y"))
    out = by_end.unionByName(pairs.join(rel, ["x", "y"]).select("event_id", "fact_id", F.lit("TABLE_PAIR").alias("via")))
    if derived is not None:
        d = derived.select("fact_id", F.explode(F.array(F.col("tgt_key"), table(F.col("tgt_key")))).alias("key"))
        o = outs.select("event_id", F.explode(F.array(F.col("key"), table(F.col("key")))).alias("key"))
        out = out.unionByName(o.join(d, "key").select("event_id", "fact_id", F.lit("DERIVED").alias("via")))
    return out.distinct()


def dangling(references: DataFrame, facts: DataFrame, ref: str = "ref", key: str = "fact_id") -> DataFrame:
    """References without a fact: empty in a closed store."""
    return references.join(facts.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def triplets(relationships: DataFrame, event_rows: DataFrame, lineage: DataFrame, naming: DataFrame) -> DataFrame:
    """(subject, predicate, object): relationships, dimensions (keys seen from the referenced table), event inputs by outputs, lineage and naming. Distinct."""
    table = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    three = lambda df, s, p, o: df.select(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    rel = three(relationships, F.col("src_key"), F.col("relation_type"), F.col("tgt_key"))
    dim = three(relationships.filter("relation_type = 'FK_LIKE'"), table(F.col("src_key")), F.lit("HAS_DIMENSION"), table(F.col("tgt_key")))
    ev = event_rows.select("event_id", F.explode("inputs").alias("i"), "outputs").select("event_id", "i", F.explode("outputs").alias("o"))
    flow = three(ev, F.col("i"), F.concat(F.lit("FEEDS_VIA:"), F.substring("event_id", 1, 22)), F.col("o"))
    lin = three(lineage.select(F.explode("sources").alias("s"), "target", "transform"), F.col("s"), F.concat(F.lit("LINEAGE_"), F.col("transform")), F.col("target"))
    nam = three(naming, F.col("src_key"), F.concat(F.lit("NAMED_AS:"), F.col("rule")), F.col("tgt_key"))
    return rel.unionByName(dim).unionByName(flow).unionByName(lin).unionByName(nam).distinct()


def review_items(diagnostics: DataFrame) -> DataFrame:
    """One for each diagnostic (type, source, line, message)."""
    return diagnostics.select(stable_id("review", F.col("type"), F.col("source"), F.col("line"), F.col("message")).alias("item_id"), F.col("type").alias("reason"), "source", "line", "message")


def kg_nodes(columns: DataFrame, facts: DataFrame, event_rows: DataFrame, join_paths: DataFrame) -> DataFrame:
    """(node_id, kind, label): tables, columns, facts (fact_id, fact_type), events and join paths (path_id, path)."""
    node = lambda df, i, k, label: df.select(i.alias("node_id"), k.alias("kind"), label.alias("label"))
    t = columns.select("table").distinct()
    return (
        node(t, stable_id("table", F.col("table")), F.lit("PhysicalTable"), F.col("table"))
        .unionByName(node(columns, stable_id("column", F.col("key")), F.lit("PhysicalColumn"), F.col("key")))
        .unionByName(node(facts, F.col("fact_id"), F.col("fact_type"), F.col("fact_id")))
        .unionByName(node(event_rows, F.col("event_id"), F.lit("Event"), F.col("subject")))
        .unionByName(node(join_paths, F.col("path_id"), F.lit("JoinPath"), F.array_join("path", ">"))).distinct()
    )


def kg_edges(columns: DataFrame, facts: DataFrame, event_rows: DataFrame, join_paths: DataFrame) -> DataFrame:
    """(edge_id, kind, src, tgt, ordinal, evidence): TABLE_COLUMN, *_SOURCE, *_TARGET, EVENT_INPUT, EVENT_OUTPUT, JOIN_PATH_STEP. facts: (fact_id, fact_type, src_key, tgt_key)."""
    col = lambda c: stable_id("column", c)

    def edge(df, kind, s, t, n, e):
        return df.select(kind.alias("kind"), s.alias("src"), t.alias("tgt"), n.cast("int").alias("ordinal"), e.alias("evidence"))

    zero = F.lit(0)
    ins, outs = event_rows.select("event_id", F.posexplode("inputs").alias("i", "c")), event_rows.select("event_id", F.posexplode("outputs").alias("i", "c"))
    steps = join_paths.select("path_id", F.posexplode("path").alias("i", "c"))
    out = (
        edge(columns, F.lit("TABLE_COLUMN"), stable_id("table", F.col("table")), col(F.col("key")), F.col("ordinal"), F.col("key"))
        .unionByName(edge(facts, F.concat(F.col("fact_type"), F.lit("_SOURCE")), F.col("fact_id"), col(F.col("src_key")), zero, F.col("fact_id")))
        .unionByName(edge(facts, F.concat(F.col("fact_type"), F.lit("_TARGET")), F.col("fact_id"), col(F.col("tgt_key")), zero, F.col("fact_id")))
        .unionByName(edge(ins, F.lit("EVENT_INPUT"), F.col("event_id"), col(F.col("c")), F.col("i"), F.col("event_id")))
        .unionByName(edge(outs, F.lit("EVENT_OUTPUT"), F.col("event_id"), col(F.col("c")), F.col("i"), F.col("event_id")))
        .unionByName(edge(steps, F.lit("JOIN_PATH_STEP"), F.col("path_id"), col(F.col("c")), F.col("i"), F.col("path_id")))
    )
    return out.withColumn("edge_id", stable_id("edge", F.col("kind"), F.col("src"), F.col("tgt"), F.col("ordinal"))).select("edge_id", "kind", "src", "tgt", "ordinal", "evidence").distinct()


def kg_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): edges whose ends aren't nodes, edges without evidence, node ids of several kinds. Empty for a closed graph."""
    ids = nodes.select(F.col("node_id").alias("id")).distinct()
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("id"))
    return (
        ends.join(ids, "id", "left_anti").select(F.lit("DANGLING_END").alias("problem"), "id")
        .unionByName(edges.filter("evidence IS NULL").select(F.lit("NO_EVIDENCE").alias("problem"), F.col("edge_id").alias("id")))
        .unionByName(nodes.groupBy("node_id").agg(F.countDistinct("kind").alias("n")).filter("n > 1").select(F.lit("KINDS_DISAGREE").alias("problem"), F.col("node_id").alias("id"))).distinct()
    )


def owners(items: DataFrame) -> DataFrame:
    """items (item_id, tables array, payload) with owner (their first table in order) and tokens."""
    return items.withColumn("owner", F.array_min("tables")).withColumn("tokens", token_estimate(F.col("payload")))


def pack(weights: DataFrame, target: int = TARGET_TOKENS, most: int | None = None, shards: int | None = None) -> DataFrame:
    """(owner, tokens, shard_id): owners in order of (component, owner) are packed greedily into shards: a shard is closed when the next owner would pass `target`.

    Greedy packing depends on what came before, so it is one ordered pass over one row an owner (a table name and a number, not the items). An owner above `target` is a
    shard of its own. A caller whose shards go to a model gives its limits (MOST_TOKENS, MOST_SHARDS): then an owner above `most`, or more than `shards` shards, is an error.
    """
    def each(frames):
        import pandas as pd

        rows = pd.concat(list(frames) or [pd.DataFrame(columns=["component", "owner", "tokens"])]).sort_values(["component", "owner"])
        shard, filled, out = 0, 0, []
        for owner, tokens in zip(rows["owner"], rows["tokens"]):
            if most is not None and tokens > most:
                raise ValueError(f"{owner} alone has {tokens} tokens")
            if filled and filled + tokens > target:
                shard, filled = shard + 1, 0
            filled += tokens
            if shards is not None and shard >= shards:
                raise ValueError(f"more than {shards} shards")
            out.append((owner, tokens, shard))
        yield pd.DataFrame(out, columns=["owner", "tokens", "shard_id"]).astype({"tokens": "int64", "shard_id": "int32"})

    return weights.select("component", "owner", "tokens").coalesce(1).mapInPandas(each, "owner string, tokens long, shard_id int")


def planned(items: DataFrame, target: int = TARGET_TOKENS, most: int | None = None, shards: int | None = None, checkpoint=None) -> DataFrame:
    """(owner, tokens, shard_id) of items (item_id, tables, payload): each item belongs to the first of its tables; tables that items touch together form a component, and components are packed in order."""
    from .graph import components

    own = owners(items)
    stars = own.select("owner", F.explode("tables").alias("table")).distinct()
    groups = components(stars, "owner", "table", checkpoint=checkpoint)
    weights = own.groupBy("owner").agg(F.sum("tokens").cast("long").alias("tokens"))
    return pack(weights.join(groups.withColumnRenamed("node", "owner"), "owner", "left").withColumn("component", F.coalesce("component", "owner")), target, most, shards)


def evidence_graph(sections: dict[str, DataFrame]) -> DataFrame:
    """(fact_id, fact_type, payload): the rows of all sections as typed facts; equal rows of a section are one fact, whose id depends on nothing but its content."""
    out = None
    for name, df in sections.items():
        payload = F.to_json(F.struct(*sorted(df.columns)))
        one = df.select(stable_id(name, payload).alias("fact_id"), F.lit(name).alias("fact_type"), payload.alias("payload")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def invalid_references(documents: DataFrame, facts: DataFrame, known: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(section, item_id, problem) of extracted items (section, item_id, refs): unknown sections, repeated ids, items without a reference, and references that no fact of the evidence has. Empty for a valid document."""
    made = lambda df, problem: df.select("section", "item_id", F.lit(problem).alias("problem"))
    refs = documents.select("section", "item_id", F.explode("refs").alias("fact_id"))
    return (
        made(documents.filter(~F.col("section").isin(*known)), "UNKNOWN_SECTION").unionByName(made(documents.groupBy("section", "item_id").count().filter("count > 1"), "REPEATED_ID"))
        .unionByName(made(documents.filter(F.coalesce(F.size("refs"), F.lit(0)) < 1), "NO_REFERENCE")).unionByName(made(refs.join(facts.select("fact_id").distinct(), "fact_id", "left_anti"), "UNKNOWN_REFERENCE")).distinct()
    )


def owned_and_overlap(items: DataFrame, packed: DataFrame) -> DataFrame:
    """(item_id, shard_id, owned): an item is owned by its owner's shard, and an overlap in the other shards whose tables it touches."""
    own = items.join(packed.select("owner", "shard_id"), "owner").select("item_id", "shard_id", F.lit(True).alias("owned"))
    touched = items.select("item_id", F.explode("tables").alias("owner")).join(packed.select("owner", "shard_id"), "owner").select("item_id", "shard_id").distinct()
    return own.unionByName(touched.join(own.select("item_id", "shard_id"), ["item_id", "shard_id"], "left_anti").withColumn("owned", F.lit(False)))


def merged_entities(variants: DataFrame) -> DataFrame:
    """Variants (entity_id, semantic_type, refs array, payload) of an entity become one if they have at most one semantic type: union of refs, smallest payload. Entities of several types stay apart, as conflicts."""
    flat = variants.select("entity_id", "semantic_type", "payload", F.explode_outer("refs").alias("r"))
    grouped = flat.groupBy("entity_id").agg(F.countDistinct("semantic_type").alias("types"), F.max("semantic_type").alias("semantic_type"), F.array_sort(F.collect_set("r")).alias("refs"), F.min("payload").alias("payload"), F.countDistinct("payload").alias("variants"))
    return grouped.withColumn("conflict", F.col("types") > 1).drop("types")


def selection_gaps(conflicts: DataFrame, patch: DataFrame) -> DataFrame:
    """(section, id, hash, problem): every conflict variant must be resolved by hash; a patch for no conflict is one too many; a rename must keep the identity."""
    k = ["section", "id", "hash"]
    return (
        conflicts.join(patch, k, "left_anti").select(*k, F.lit("UNRESOLVED").alias("problem")).unionByName(patch.join(conflicts, k, "left_anti").select(*k, F.lit("UNKNOWN").alias("problem")))
        .unionByName(patch.filter("identity <> new_identity").select(*k, F.lit("IDENTITY_CHANGED").alias("problem")))
    )


def within_budget(rows: DataFrame, text_col: str, most: int) -> DataFrame:
    """rows, after a check that their estimated tokens fit: the sum is taken before anything is materialised."""
    total = rows.agg(F.sum(token_estimate(F.col(text_col)))).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} tokens exceed {most}")
    return rows
