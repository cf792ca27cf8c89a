from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import catalog, evidence, graph, lineage, naming, profile, semantic
from weftline.plans import catalogue
from weftline.session import checkpoint
from weftline.sources import logs


def test_entry_without_optional_parts(tmp_path):
    """The entry file imports, and keeps its other queries, where the training-data subpackage is absent."""
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ind_evidence' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_first_rule_wins_and_user_rules_stay(spark):
    e = spark.createDataFrame([("a.b_id", "bs.id", "TABLE_ID", "S"), ("a.b_id", "bs.id", "ID_SUFFIX_TO_ID", "S"), ("a.b_id", "bs.id", "USER_CONFIGURED:x", "S")], "src_key string, tgt_key string, rule string, direction_hint string")
    assert {r["rule"] for r in naming.first_match(e).collect()} == {"TABLE_ID", "USER_CONFIGURED:x"}


def test_attach(spark):
    rows = spark.createDataFrame([("a.x", "b.id", "CO_OCCURRENCE", "SQL_LOG_JOIN"), ("c.x", "d.id", "CO_OCCURRENCE", "SOURCE_INDEX"), ("e.x", "f.id", "CO_OCCURRENCE", "SQL_LOG_JOIN"), ("e.x", "f.id", "CO_OCCURRENCE", "NAMING_MATCH")], "src_key string, tgt_key string, relation_type string, evidence_type string")
    names = spark.createDataFrame([("b.id", "a.x", "TABLE_ID"), ("c.x", "d.id", "TABLE_ID"), ("e.x", "f.id", "TABLE_ID")], "src_key string, tgt_key string, rule string")
    assert [(r["src_key"], r["evidence_type"]) for r in naming.attach(rows, names).collect()] == [("a.x", "NAMING_MATCH")]


def test_index_policy_and_enhancement(spark):
    m = [("i1", "t", "a", 1, "FULL_COLUMN", True, True), ("i2", "t", "b", 1, "FULL_COLUMN", True, True), ("i2", "t", "c", 2, "FULL_COLUMN", True, True), ("i3", "t", "d", 1, "PREFIX_COLUMN", True, True), ("i4", "t", "e", 1, "FULL_COLUMN", True, False), ("i5", "t", "f", 2, "FULL_COLUMN", True, True)]
    policy = catalog.index_policy(spark.createDataFrame(m, "index string, table string, column string, ordinal int, kind string, is_unique boolean, visible boolean"))
    assert {r["key"]: (r["is_unique"], r["is_lookup"]) for r in policy.collect()} == {"t.a": (True, True), "t.b": (False, True), "t.d": (False, True)}
    columns = spark.createDataFrame([("s.x", "INT"), ("t.a", "int"), ("t.b", "bigint")], "key string, type string")
    pairs = spark.createDataFrame([("s.x", "t.a"), ("t.b", "t.a")], "src_key string, tgt_key string")
    got = {(r["src_key"], r["evidence_type"]) for r in catalog.enhanced(pairs, columns, policy).collect()}
    assert got == {("s.x", "TARGET_UNIQUE"), ("s.x", "COLUMN_TYPE_COMPATIBLE"), ("t.b", "TARGET_UNIQUE"), ("t.b", "SOURCE_INDEX")}


def test_metrics_ignore_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,), (9,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "y int")
    r = profile.metrics({"a.x": (a, "x"), "b.y": (b, "y"), "e.z": (a.limit(0), "x")}, [("a.x", "b.y"), ("e.z", "b.y")]).orderBy("src_key").collect()
    assert [tuple(x)[2:] for x in r] == [(4, 3, 2, 1, 2), (0, 0, 0, 0, 2)]


def test_paths_rules(spark):
    e = [("a", "b", "RELATIONSHIP", "0.9"), ("b", "c", "NAMING", "0.9"), ("c", "d", "NAMING", "0.9"), ("b", "a", "RELATIONSHIP", "0.9"), ("a", "z", "RELATIONSHIP", "0.12"), ("z", "y", "RELATIONSHIP", "0.9")]
    df = spark.createDataFrame([(*x[:3], Decimal(x[3]), 1) for x in e], "src string, tgt string, kind string, confidence decimal(5,4), support int")
    got = {"".join(r["path"]): str(r["confidence"]) for r in graph.paths(df, checkpoint=checkpoint).collect()}
    assert got == {"abc": "0.6750", "abcd": "0.5063"}  # not bcd (naming alone), not azy (0.09 < 0.10)
    assert {"".join(r["path"]) for r in graph.paths(df, naming_graph=True, checkpoint=checkpoint).collect()} == {"abc", "abcd", "bcd"}
    facts = graph.edges(df.withColumn("ref", F.lit("r")))
    assert facts.count() == 6


def test_components(spark):
    """Chains, a hub, loops, nulls and repeated edges, contracted whole, or in small pieces and then by rounds."""
    rng = random.Random(3)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("hub", f"h{i}") for i in range(200)] + [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(260)] + [("x", "x"), ("x", "x"), ("é", "z")]
    rng.shuffle(pairs)
    root = {n: n for p in pairs for n in p}
    moved = True
    while moved:
        moved = False
        for u, v in pairs:
            least = min(root[u], root[v])
            moved |= root[u] != least or root[v] != least
            root[u] = root[v] = least
    df = spark.createDataFrame([*pairs, (None, "w"), (None, None)], "src string, tgt string")
    want = sorted([*root.items(), ("w", "w"), (None, None)], key=str)
    for local in (None, 40):
        assert sorted((tuple(r) for r in graph.components(df, checkpoint=checkpoint, local=local).collect()), key=str) == want
    numbers = spark.createDataFrame([(10, 9), (9, 100), (7, 7)], "src long, tgt long")
    assert {tuple(r) for r in graph.components(numbers, checkpoint=checkpoint).collect()} == {(9, 9), (10, 9), (100, 9), (7, 7)}
    assert graph.components(numbers.limit(0), checkpoint=checkpoint).count() == 0


def test_fact_budget(spark):
    one = lambda n: spark.createDataFrame([(f"s{i}", "t", ["s", "t"], 1 - i / 10) for i in range(n)], "src string, tgt string, path array<string>, confidence double")
    assert [x.count() for x in graph.fact_budget(one(3), one(4), one(5), 5)] == [3, 2, 0]


def test_lineage_merge_and_bridge(spark):
    rows = spark.createDataFrame([(["b.y", "a.x"], "t.z", "VALUE", "DIRECT", 2), (["a.x", "b.y"], "t.z", "VALUE", "DIRECT", 1), (["a.x"], "#tmp.z", "CONTROL", "DIRECT", 3)], "sources array<string>, target string, flow string, transform string, ordinal long")
    got = lineage.merged(lineage.scored(rows)).orderBy("ordinal").collect()
    assert [(r["sources"], str(r["confidence"]), r["observations"]) for r in got] == [(["a.x", "b.y"], "0.9000", 2), (["a.x"], "0.5500", 1)]
    assert lineage.known_targets(rows, None).count() == 2
    uses = spark.createDataFrame([("t", 10), ("t", 3), ("t", 1), ("u", 5)], "name string, line int")
    decl = spark.createDataFrame([("t", 2, "a"), ("t", 8, "b"), ("t", 8, "c"), ("u", 4, None)], "name string, line int, source string")
    assert [tuple(r) for r in lineage.bridged(uses, decl).collect()] == [("t", 3, "a", 2)]


def test_semantic(spark):
    w = spark.createDataFrame([("c", "a", 60), ("c", "b", 50), ("c", "d", 10), ("e", "f", 5)], "component string, owner string, tokens int")
    packed = semantic.pack(w, target=100)
    assert {r["owner"]: r["shard_id"] for r in packed.collect()} == {"a": 0, "b": 1, "d": 1, "f": 1}
    with pytest.raises(Exception, match="alone has"):
        semantic.pack(w, most=40).collect()
    items = semantic.owners(spark.createDataFrame([("i", ["b", "a"], "xx"), ("j", ["d"], "é")], "item_id string, tables array<string>, payload string"))
    assert {(r["item_id"], r["owner"], r["tokens"]) for r in items.collect()} == {("i", "a", 75), ("j", "d", 75)}
    assert {tuple(r) for r in semantic.owned_and_overlap(items, packed).collect()} == {("i", 0, True), ("i", 1, False), ("j", 1, True)}
    v = spark.createDataFrame([("e", "T", ["r1"], "b"), ("e", None, ["r2"], "a"), ("g", "T", ["r"], "x"), ("g", "U", ["r"], "y")], "entity_id string, semantic_type string, refs array<string>, payload string")
    assert {r["entity_id"]: (r["refs"], r["payload"], r["conflict"]) for r in semantic.merged_entities(v).collect()} == {"e": (["r1", "r2"], "a", False), "g": (["r"], "x", True)}
    conflicts = spark.createDataFrame([("s", "1", "h1"), ("s", "2", "h2")], "section string, id string, hash string")
    patch = spark.createDataFrame([("s", "1", "h1", "k", "k2"), ("s", "3", "h", "k", "k")], "section string, id string, hash string, identity string, new_identity string")
    assert {(r["id"], r["problem"]) for r in semantic.selection_gaps(conflicts, patch).collect()} == {("2", "UNRESOLVED"), ("3", "UNKNOWN"), ("1", "IDENTITY_CHANGED")}
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("m", "a", 1), ("m", "b", 1)], "key string, identity string, v int")
    assert [r["key"] for r in semantic.identity_conflicts(rows, "key", ["identity"]).collect()] == ["m"]
    with pytest.raises(ValueError, match="exceed"):
        semantic.within_budget(items, "payload", 100)


def test_pack_without_limits(spark):
    w = spark.createDataFrame([("c", f"t{i:03}", 10_000_000 if i == 7 else 300_000) for i in range(150)], "component string, owner string, tokens long")
    assert {r["owner"]: r["shard_id"] for r in semantic.pack(w).collect()} == {f"t{i:03}": i for i in range(150)}
    with pytest.raises(Exception, match="more than 128 shards"):
        semantic.pack(w.filter("tokens < 800000"), most=semantic.MOST_TOKENS, shards=semantic.MOST_SHARDS).collect()


def test_plan_of_a_large_owner(spark):
    items = spark.createDataFrame([(i, ["a", "u"], "é" * 20_000) for i in range(50)] + [(99, ["b", "u"], "x")], "item_id int, tables array<string>, payload string")
    assert [(r["owner"], r["shard_id"]) for r in semantic.planned(items, checkpoint=checkpoint).orderBy("owner").collect()] == [("a", 0), ("b", 1)]


def test_evidence_hooks(spark):
    rows = spark.createDataFrame([("a.x", "b.y", "k", "EQUALS", "1"), ("a.x", "c.y", "k", "EQUALS", "2"), ("d.x", "b.y", None, None, None)], "src_key string, tgt_key string, discriminator string, operator string, value string")
    assert {(r["src_key"], r["tgt_key"]): (r["conditional"], r["polymorphic"]) for r in evidence.conditional(rows).collect()} == {("a.x", "b.y"): (True, True), ("a.x", "c.y"): (True, True), ("d.x", "b.y"): (False, False)}


def test_direction_of_a_hot_pair(spark):
    rows = spark.createDataFrame([("a.x", "b.id", "CO_OCCURRENCE", "SQL_LOG_JOIN")] * 300 + [(f"c{i}.x", "b.id", "CO_OCCURRENCE", "SQL_LOG_JOIN") for i in range(40)], "src_key string, tgt_key string, relation_type string, evidence_type string")
    unique = spark.createDataFrame([("b.id",)], "key string")
    plain, hot = (sorted(map(tuple, evidence.directed(rows, unique, floor=f).collect())) for f in (1_000_000, 5))
    assert plain == hot and len(hot) == 340 and {r[2] for r in map(tuple, hot)} == {"FK_LIKE"}


def test_graph_inputs_are_worked_out_once(spark, sf):
    """Nodes, edges and checks read what was worked out once, not the line items again and again."""
    for name in ("kg_closure", "kg_nodes", "kg_edges", "event_association"):
        df = catalogue.QUERIES[name](spark, sf)
        assert "parquet" not in df._jdf.queryExecution().executedPlan().toString().lower(), name
    assert catalogue.QUERIES["triplets"](spark, sf)._jdf.queryExecution().executedPlan().toString().lower().count("filescan parquet") == 1


def test_noise_and_names(spark):
    rows = spark.createDataFrame([("SELECT 1 FROM x.pg_catalog.t", ["pg_catalog.pg_class"]), ("select version()", []), ("SELECT 1", []), ("q", ["sys.t", "shop.t"])], "sql string, tables array<string>")
    assert [r["sql"] for r in logs.without_noise(rows).collect()] == ["SELECT 1", "q"]
    assert spark.range(1).select(logs.source_name(F.lit("file:///a\\b//"))).first()[0] == "/a/b"
