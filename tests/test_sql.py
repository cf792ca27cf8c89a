from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import naming
from weftline.plans import scan
from weftline.plans.sqlfacts import analyse
from weftline.sources import jdbc, logs, results, scripts
from weftline.streaming.evidence import pair_counts


def pairs(sql, **k):
    return {(p["src_key"], p["tgt_key"]) for p in analyse(sql, **k)[0].pairs}


def flows(sql, **k):
    return {(x["flow"], x["transform"], ",".join(x["sources"]), x["target"]) for x in analyse(sql, **k)[0].lineage}


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT 1 FROM a, b WHERE a.x_id = b.id", {("a.x_id", "b.id")}),
    ("SELECT 1 FROM a x JOIN a y ON x.up_id = y.id", {("a.id", "a.up_id")}),
    ("SELECT 1 FROM a x JOIN a y ON x.id = y.id", set()),
    ("SELECT 1 FROM a WHERE a.k IN (SELECT b.id FROM b)", {("a.k", "b.id")}),
    ("SELECT 1 FROM a WHERE (a.k, a.l) IN (SELECT b.k, b.l FROM b)", {("a.k", "b.k"), ("a.l", "b.l")}),
    ("SELECT 1 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.a_id = a.id)", {("a.id", "b.a_id")}),
    ("SELECT 1 FROM a JOIN (SELECT c.id AS cid FROM c) d ON d.cid = a.c_id", {("a.c_id", "c.id")}),
    ("WITH v AS (SELECT c.id FROM c), w AS (SELECT * FROM v) SELECT 1 FROM a JOIN w ON w.id = a.c_id", {("a.c_id", "c.id")}),
    ("SELECT 1 FROM a LEFT JOIN b USING (k)", {("a.k", "b.k")}),
    ("DELETE FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.id = a.b_id)", {("a.b_id", "b.id")}),
    ("SELECT 1 FROM a JOIN b ON lower(a.m) = b.m", set()),
    ("SELECT 1 FROM a JOIN b ON a.m = b.m + 1 WHERE a.k IN (1, 2) AND b.n LIKE 'x%'", set()),
    ("SELECT 1 FROM a WHERE a.k IN (SELECT sum(b.v) FROM b)", set()),
    ("SELECT 1 FROM a JOIN b x ON x.id = a.id2 JOIN c x ON x.id = a.id3", set()),
    ("SELECT id FROM a WHERE k = l", set()),
    ("SELECT 1 FROM a CROSS APPLY (SELECT TOP 1 * FROM b WHERE b.a_id = a.id ORDER BY b.z) t", {("a.id", "b.a_id")}),
    ("SELECT 1 FROM a, LATERAL (SELECT 1 FROM b WHERE b.a_id = a.id) t", {("a.id", "b.a_id")}),
    ("SELECT 1 FROM a WHERE a.k = ANY (SELECT b.id FROM b)", {("a.k", "b.id")}),
    ("UPDATE a SET v = 1 FROM b WHERE b.id = a.b_id", {("a.b_id", "b.id")}),
    ("SELECT 1 FROM a UNION ALL SELECT 1 FROM b JOIN c ON b.c_id = c.id", {("b.c_id", "c.id")}),
    ("SELECT CASE WHEN a.x = 1 THEN (SELECT b.v FROM b WHERE b.a_id = a.id) END FROM a FETCH FIRST 3 ROWS ONLY", {("a.id", "b.a_id")}),
])
def test_pairs(sql, want):
    assert pairs(sql) == want


@pytest.mark.parametrize(("sql", "want"), [
    ("INSERT INTO t (a, b) SELECT s.x, s.y + s.z FROM s", {("VALUE", "DIRECT", "s.x", "t.a"), ("VALUE", "ARITHMETIC", "s.y,s.z", "t.b")}),
    ("INSERT INTO t (a) WITH c AS (SELECT sum(s.x) AS n FROM s) SELECT c.n FROM c", {("VALUE", "AGGREGATE", "s.x", "t.a")}),
    ("INSERT INTO t (a, b) SELECT s.x, s.x FROM s", {("VALUE", "DIRECT", "s.x", "t.a"), ("VALUE", "DIRECT", "s.x", "t.b")}),
    ("UPDATE t SET a = CASE WHEN t.c > 1 THEN t.d ELSE t.e END", {("VALUE", "CASE_WHEN", "t.d,t.e", "t.a"), ("CONTROL", "CASE_WHEN", "t.c", "t.a")}),
    ("UPDATE t SET a = coalesce(t.b, 0) WHERE t.k = 3", {("VALUE", "COALESCE", "t.b", "t.a"), ("CONTROL", "DIRECT", "t.k", "t.a")}),
    ("INSERT INTO t (a) SELECT sum(s.x) OVER (PARTITION BY s.g ORDER BY s.o) FROM s", {("VALUE", "AGGREGATE", "s.x", "t.a"), ("CONTROL", "WINDOW_DERIVED", "s.g,s.o", "t.a")}),
    ("INSERT INTO t (a) SELECT concat(s.x, s.y) || s.z FROM s", {("VALUE", "CONCAT_FORMAT", "s.x,s.y,s.z", "t.a")}),
    ("MERGE INTO t USING s ON (t.k = s.k) WHEN MATCHED THEN UPDATE SET t.a = s.b", {("VALUE", "DIRECT", "s.b", "t.a"), ("CONTROL", "DIRECT", "s.k,t.k", "t.a")}),
    ("INSERT INTO t (k, a) SELECT s.k, s.a FROM s ON DUPLICATE KEY UPDATE a = a + VALUES(a)", {("VALUE", "DIRECT", "s.k", "t.k"), ("VALUE", "DIRECT", "s.a", "t.a"), ("VALUE", "ARITHMETIC", "s.a,t.a", "t.a")}),
    ("CREATE VIEW v AS SELECT s.x AS y, upper(s.z) AS w FROM s", {("VALUE", "DIRECT", "s.x", "v.y"), ("VALUE", "FUNCTION_CALL", "s.z", "v.w")}),
])
def test_lineage(sql, want):
    assert flows(sql) == want


def test_dialects_and_guards():
    assert ("VALUE", "CUMULATIVE", "s.x", "t.a") in flows("INSERT INTO t (a) SELECT sum(s.x) OVER (ORDER BY s.o) FROM s", dialect="postgres")
    f, _ = analyse("SELECT 1 FROM a JOIN b ON a.b_id = b.id AND a.kind = 'web'")
    assert f.pairs[0]["conditions"] == [{"discriminator": "kind", "operator": "EQUALS", "value": "web"}]
    assert analyse("SELECT 1 FROM a JOIN b ON a.b_id = b.id", source_type="VIEW")[0].pairs[0]["evidence_type"] == "VIEW_JOIN"
    facts, said = analyse("EXPLODE everything")
    assert not facts.pairs and said.startswith("UNKNOWN_STATEMENT")


def test_ddl():
    f, _ = analyse("CREATE TABLE c (a INT, b INT REFERENCES d (id), PRIMARY KEY (a, b), CONSTRAINT f FOREIGN KEY (a, b) REFERENCES e (x, y) ON DELETE CASCADE, UNIQUE (a))")
    fk = {(x["key"], x["other"], x["position"], x["size"]) for x in f.ddl if x["event"] == "FOREIGN_KEY"}
    assert fk == {("c.b", "d.id", 1, 1), ("c.a", "e.x", 1, 2), ("c.b", "e.y", 2, 2)}
    assert {(x["event"], x["key"], x["size"]) for x in f.ddl if x["event"] in ("PRIMARY", "UNIQUE")} == {("PRIMARY", "c.a", 2), ("PRIMARY", "c.b", 2), ("UNIQUE", "c.a", 1)}
    g, _ = analyse("CREATE INDEX i ON t (lower(a), b(10), c DESC)")
    assert [(x["event"], x["detail"]) for x in g.ddl] == [("INDEX", "EXPRESSION"), ("INDEX", "PREFIX_COLUMN"), ("INDEX", "FULL_COLUMN")]
    assert analyse("ALTER TABLE a ADD CONSTRAINT k FOREIGN KEY (b_id) REFERENCES b (id)")[0].ddl[0]["other"] == "b.id"


def test_framing(spark):
    text = "CREATE PROCEDURE p() BEGIN IF 1 THEN SELECT ';'; END IF; CASE x WHEN 1 THEN SELECT 2; END CASE; END;\nSELECT 1; -- a;b\nSELECT 2"
    got = scripts.frame(text, "f")
    assert [r["source_type"] for r in got] == ["PROCEDURE", "PLAIN_SQL", "PLAIN_SQL"] and got[0]["object_name"] == "p"
    assert [r["sql"] for r in scripts.frame("SELECT 1\nGO\nSELECT 2\nGO\n", dialect="sqlserver")] == ["SELECT 1", "SELECT 2"]
    assert scripts.frame("CREATE FUNCTION f() RETURNS TRIGGER AS $$ BEGIN x; END $$ LANGUAGE plpgsql; SELECT 1")[0]["trigger_function"]
    marked = scripts.frame("-- @begin a\nSELECT 1;\n-- @end\n-- @begin b\n-- @begin c\nSELECT 2\n")
    assert [r["error"] for r in marked] == [None, "NESTED_MARK", "MISSING_END"]
    assert scripts.framed(spark.createDataFrame([("a", None), ("b", "")], "source_name string, text string")).count() == 0


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sql").write_text("CREATE TABLE shops (id INT PRIMARY KEY);\nCREATE TABLE sales (id INT PRIMARY KEY, shop_id INT);\nSELECT 1 FROM sales s JOIN shops p ON p.id = s.shop_id;\nINSERT INTO t (a) SELECT s.id FROM sales s;\nINSERT INTO u (b) SELECT t.a FROM t;\n")
    (tmp_path / "q.log").write_text("2024 [1] LOG:  statement: SELECT 1 FROM sales s JOIN shops p ON p.id = s.shop_id\n2024 [1] LOG:  statement: SELECT 1 FROM pg_catalog.pg_class\n")
    with pytest.raises(FileNotFoundError):
        scripts.script_files(spark, [str(tmp_path / "in")], "*.nothing")
    out = scan.scan(spark, scan.Config(scripts=(str(tmp_path / "in"),), logs=(str(tmp_path / "q.log"),), dialect="postgres"))
    rel = out["relationships"].collect()
    assert [(r["src_key"], r["tgt_key"], r["relation_type"], r["subtype"]) for r in rel] == [("sales.shop_id", "shops.id", "FK_LIKE", "INFERRED_JOIN_FK")]
    assert {(r["target"], *r["sources"]) for r in out["lineage"].collect()} == {("t.a", "sales.id"), ("u.b", "t.a")}
    assert [(r["src"], r["tgt"]) for r in out["derived_lineage"].collect()] == [("sales.id", "u.b")]
    counts = results.write_document({k: out[k] for k in ("relationships", "lineage")}, str(tmp_path / "doc.json"))
    doc = json.loads((tmp_path / "doc.json").read_text())
    assert counts == doc["summary"] == {"relationships": 1, "lineage": 2} and doc["relationships"][0]["src_key"] == "sales.shop_id"
    results.write_scan_result({k: out[k] for k in ("relationships", "lineage")}, str(tmp_path / "out"))
    back = results.read_sections(spark, str(tmp_path / "out"), {"relationships": out["relationships"].schema})["relationships"]
    assert back.count() == 1
    results.publish(out["relationships"], str(tmp_path / "pub"))
    results.publish(out["relationships"], str(tmp_path / "pub"))
    assert results.published(spark, str(tmp_path / "pub")).count() == 1
    results.publish_bundle({"a": out["relationships"], "b": out["lineage"]}, str(tmp_path / "two"))
    assert results.published(spark, str(tmp_path / "two"), name="b").count() == 2
    doc = {"relationships": [{"src_key": "a.x", "tgt_key": "b.y", "relation_type": "FK_LIKE", "subtype": "S", "confidence": 0.5}], "lineage": [], "naming": []}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    assert results.read_scan_result(spark, str(tmp_path / "r.json"))["relationships"].first()["tgt_key"] == "b.y"
    a, b = (results.canonical_fingerprint(x).first()["fingerprint"] for x in (out["relationships"], out["relationships"].repartition(3)))
    assert a == b
    assert results.text_table(out["relationships"], {"src_key": 20, "tgt_key": 10}).first()[0].startswith("sales.shop_id        | shops.id")


def statements(spark, *sqls, name="s"):
    return spark.createDataFrame([(name, i, q, "PLAIN_SQL") for i, q in enumerate(sqls)], "source_name string, ordinal int, sql string, source_type string")


def test_scan_bridges_temporary_tables(spark):
    rows = statements(
        spark, "CREATE TEMPORARY TABLE tmp AS SELECT o.id AS oid, o.user_id, upper(o.code) AS c FROM orders o", "SELECT 1 FROM tmp t JOIN users u ON u.id = t.user_id", "SELECT 1 FROM tmp t JOIN codes k ON k.code = t.c",
        "CREATE TEMP TABLE again AS SELECT t.user_id AS uid FROM tmp t", "SELECT 1 FROM again a JOIN staff s ON s.id = a.uid", "INSERT INTO users (n) SELECT t.oid FROM tmp t",
    )
    out = scan.scan_statements(rows, scan.Config(dialect="postgres"))
    assert {(r["src_key"], r["tgt_key"]) for r in out["relationships"].collect()} == {("orders.user_id", "users.id"), ("orders.user_id", "staff.id")}
    assert {r["target"] for r in out["lineage"].collect()} == {"users.n"}
    hashed = statements(spark, "SELECT o.id AS oid INTO #t FROM orders o", "SELECT 1 FROM #t t JOIN lines l ON l.order_id = t.oid")
    assert {(r["src_key"], r["tgt_key"]) for r in scan.scan_statements(hashed, scan.Config(dialect="sqlserver"))["relationships"].collect()} == {("lines.order_id", "orders.id")}


def test_scan_with_catalog(spark):
    tables = {
        "users": spark.range(100).selectExpr("id", "cast(id as string) name"), "orders": spark.range(400).selectExpr("id", "id % 100 AS user_id", "id + 50 AS far_id", "id % 30 AS shop_id"),
        "shops": spark.range(30).selectExpr("id"), "far": spark.range(100).selectExpr("id"),
    }
    rows = statements(
        spark, "CREATE TABLE users (id BIGINT PRIMARY KEY)", "SELECT 1 FROM orders o JOIN users u ON u.id = o.user_id WHERE o.kind = 'a'", "SELECT 1 FROM orders o JOIN far f ON f.id = o.far_id AND o.kind = 'x'",
        "INSERT INTO orders (id) SELECT u.id FROM users u", "INSERT INTO elsewhere (id) SELECT u.id FROM users u",
    )
    rule = naming.UserRule("far", naming.Matcher(column_value="far_id"), naming.Matcher(key="far.id"))
    out = scan.scan_statements(rows, scan.Config(user_rules=(rule,)), tables=tables)
    kinds = {}
    for r in out["evidence"].collect():
        kinds.setdefault((r["src_key"], r["tgt_key"]), set()).add(r["evidence_type"])
    assert kinds["orders.user_id", "users.id"] == {"SQL_LOG_JOIN", "NAMING_MATCH", "COLUMN_TYPE_COMPATIBLE", "TARGET_UNIQUE", "VALUE_CONTAINMENT_HIGH"}
    assert "VALUE_CONTAINMENT_HIGH" not in kinds["orders.far_id", "far.id"] and "NAMING_MATCH" in kinds["orders.far_id", "far.id"]
    assert kinds["orders.shop_id", "shops.id"] == {"VALUE_CONTAINMENT_HIGH"}  # only its name suggests it
    got = {(r["src_key"], r["tgt_key"]): (r["conditional"], r["subtype"]) for r in out["relationships"].collect()}
    assert got["orders.far_id", "far.id"][0] and not got["orders.shop_id", "shops.id"][0] and got["orders.shop_id", "shops.id"][1] == "PROFILE_SUPPORTED_FK"
    assert {r["target"] for r in out["lineage"].collect()} == {"orders.id"}
    assert {"USER_CONFIGURED:far", "TABLE_ID"} <= {r["rule"] for r in out["naming"].collect()}
    assert "derived_naming" not in out and out["derived_naming"].count() >= 0 and "derived_naming" in out
    few = scan.scan_statements(rows, scan.Config(most_derived=1), tables=tables)
    assert sum(few[n].count() for n in few.DERIVED) <= 1


def test_logs_by_dialect(spark, tmp_path):
    (tmp_path / "x.sql").write_text("CREATE TABLE a (id INT PRIMARY KEY);")
    (tmp_path / "pg.log").write_text("2024 [1] LOG:  statement: SELECT 1\n\tFROM b\n\tJOIN a ON a.id = b.a_id;\n2024 [1] LOG:  duration: 3 ms\n2024 [1] LOG:  execute q: SELECT 1 FROM c JOIN a ON a.id = c.a_id\n")
    (tmp_path / "ms.log").write_text("SELECT 1 FROM b JOIN a ON a.id = b.a_id\nGO\nSELECT 1 FROM c JOIN a ON a.id = c.a_id\nGO\n")
    (tmp_path / "ora.log").write_text("SELECT 1 FROM b JOIN a ON a.id = b.a_id;\nSELECT 1 FROM c JOIN a ON a.id = c.a_id;\n")
    (tmp_path / "slow.log").write_text("# Time: x\nSELECT 1 FROM b JOIN a\nON a.id = b.a_id;\n# Time: z\nSELECT 1 FROM c JOIN a ON a.id = c.a_id;\n")
    for dialect, name in (("postgres", "pg"), ("sqlserver", "ms"), ("oracle", "ora"), ("mysql", "slow")):
        where = {"slow_logs" if name == "slow" else "logs": (str(tmp_path / f"{name}.log"),)}
        out = scan.scan(spark, scan.Config(scripts=(str(tmp_path / "x.sql"),), dialect=dialect, **where))
        assert {(r["src_key"], r["tgt_key"]) for r in out["relationships"].collect()} == {("b.a_id", "a.id"), ("c.a_id", "a.id")}, dialect


def test_batch_reports_failures(spark, tmp_path):
    out = scan.batch(spark, {"bad": scan.Config(scripts=(str(tmp_path),), pattern="*.none")}, fail_fast=False)
    assert isinstance(out["bad"], FileNotFoundError)


def test_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024 [1] LOG:  statement: SELECT 1 FROM a JOIN b ON a.b_id = b.id\n" * 3)
    rows = logs.postgres(logs.lines(spark, str(tmp_path), stream=True))
    q = pair_counts(rows).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT src_key, tgt_key, observations FROM pairs").collect()] == [("a.b_id", "b.id", 3)]


def test_mysql_slow_and_jdbc(spark):
    text = "# Time: x\n# User@Host: y\nSET timestamp=1;\nSELECT 1\nFROM t;\n# Time: z\nuse db;\nSELECT 2;\n"
    got = logs.mysql_slow(spark.createDataFrame([("s", text)], "source_name string, text string")).collect()
    assert [r["sql"] for r in got] == ["SELECT 1\nFROM t", "SELECT 2"]
    assert "'o''k'" in jdbc.catalog_query("mysql", "columns", "o'k")


def test_equal_statements_are_read_once(monkeypatch):
    """The facts of equal statements are those of one reading, for each row; statements that differ in their kind are read apart."""
    calls = []
    monkeypatch.setattr(scan, "analyse", lambda sql, dialect, kind: calls.append((sql, kind)) or analyse(sql, dialect, kind))
    texts = [("SELECT a.id FROM u a JOIN v b ON b.id = a.v_id", "PLAIN_SQL"), ("SELECT a.id FROM u a JOIN v b ON b.id = a.v_id", "VIEW"), (None, None), ("SELECT (", "PLAIN_SQL")]
    rows = [texts[i % 4] for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(400)]), pa.array(range(400), pa.int32()), pa.array([k for _, k in rows], pa.string()), pa.nulls(400, pa.string()), pa.array([t for t, _ in rows], pa.string())], names=["source_name", "ordinal", "source_type", "object_name", "sql"])
    out = pa.Table.from_batches(scan._analysed("common", ())(iter([batch, batch, batch.slice(0, 0)]))).to_pylist()
    assert len(calls) == 4 and len(out) == 800 and [r["ordinal"] for r in out[:400]] == list(range(400))
    for r, (text, kind) in zip(out, rows + rows):
        facts, said = analyse(text or "", "common", kind or "")
        assert r["tables"] == sorted(facts.tables) and [p["evidence_type"] for p in r["pairs"]] == [p["evidence_type"] for p in facts.pairs] and r["diagnostic"] == said


def test_statements_of_one_small_file_are_spread(spark, tmp_path):
    """A file of one task is read in several where its rows pay for that, and few rows are not."""
    spark.range(60_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    statements = ids.select(F.format_string("SELECT * FROM u%d WHERE id = 3", F.col("id") % 9).alias("sql"))
    assert ids.rdd.getNumPartitions() == 1 and scan.spread(statements).rdd.getNumPartitions() > 2
    assert scan.spread(statements, 1 << 40).rdd.getNumPartitions() == 1
    read = scan.analysed(statements)
    assert read.count() == 60_000 and read.select(F.explode("tables")).distinct().count() == 9
