"""Statements, scripts and log lines on which the text queries run."""

from __future__ import annotations

STATEMENTS = [
    ("shop.ddl", 0, "CREATE TABLE shops (id BIGINT PRIMARY KEY, name VARCHAR(80) NOT NULL, city_id BIGINT, UNIQUE KEY u_name (name))", "DDL_FILE"),
    ("shop.ddl", 1, "CREATE TABLE sales (id BIGINT PRIMARY KEY, shop_id BIGINT, clerk_id BIGINT, amount DECIMAL(12,2), CONSTRAINT fk_shop FOREIGN KEY (shop_id) REFERENCES shops (id) ON DELETE CASCADE, KEY i_clerk (clerk_id))", "DDL_FILE"),
    ("shop.ddl", 2, "CREATE UNIQUE INDEX u_clerk ON clerks (id)", "DDL_FILE"),
    ("report.sql", 0, "SELECT s.id FROM sales s JOIN clerks c ON s.clerk_id = c.id JOIN shops p ON p.id = s.shop_id WHERE s.kind = 'web'", "PLAIN_SQL"),
    ("report.sql", 1, "SELECT * FROM clerks a, clerks b WHERE a.boss_id = b.id", "PLAIN_SQL"),
    ("report.sql", 2, "WITH live AS (SELECT c.id FROM clerks c WHERE EXISTS (SELECT 1 FROM shifts f WHERE f.clerk_id = c.id)) SELECT 1 FROM sales s JOIN live l ON l.id = s.clerk_id", "PLAIN_SQL"),
    ("load.sql", 0, "INSERT INTO shop_totals (shop_id, total, rank_no) SELECT s.shop_id, SUM(s.amount), ROW_NUMBER() OVER (PARTITION BY p.city_id ORDER BY s.shop_id) FROM sales s JOIN shops p ON p.id = s.shop_id GROUP BY s.shop_id", "PLAIN_SQL"),
    ("load.sql", 1, "UPDATE shop_totals t SET grade = CASE WHEN t.total > 10 THEN t.total ELSE t.base END WHERE t.shop_id IN (SELECT p.id FROM shops p)", "PLAIN_SQL"),
    ("load.sql", 2, "INSERT INTO city_totals (city_id, total) SELECT p.city_id, t.total + 1 FROM shop_totals t JOIN shops p ON p.id = t.shop_id", "PLAIN_SQL"),
    ("load.sql", 3, "MERGE INTO shop_totals t USING (SELECT shop_id, amount FROM sales) s ON (t.shop_id = s.shop_id) WHEN MATCHED THEN UPDATE SET t.total = t.total + s.amount WHEN NOT MATCHED THEN INSERT (shop_id, total) VALUES (s.shop_id, s.amount)", "PLAIN_SQL"),
    ("broken.sql", 0, "VACUUM THE HALL", "PLAIN_SQL"),
]
SCRIPTS = [
    ("a.sql", "-- tables\nCREATE TABLE t (id INT);\nINSERT INTO t VALUES (1);\nDELIMITER //\nCREATE PROCEDURE p()\nBEGIN\n  UPDATE t SET id = 2;\n  SELECT 'a;b//c';\nEND//\nDELIMITER ;\nSELECT 1;\n"),
    ("b.sql", "CREATE VIEW v AS SELECT id FROM t;\nSELECT ';' AS x -- no; end\n;\n"),
]
#: Over the folder's tables: a join through a temporary table, one under a condition, a subquery; writes to known, unknown and temporary tables.
ORDER_STATEMENTS = [
    ("o.ddl", 0, "CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY)", "DDL_FILE"), ("o.ddl", 1, "CREATE TABLE nation (n_nationkey INT PRIMARY KEY)", "DDL_FILE"), ("o.ddl", 2, "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY)", "DDL_FILE"),
    ("o.sql", 0, "CREATE TEMPORARY TABLE recent AS SELECT o.o_custkey AS k, o.o_totalprice * 2 AS twice FROM orders o", "PLAIN_SQL"), ("o.sql", 1, "SELECT 1 FROM recent r JOIN customer c ON c.c_custkey = r.k", "PLAIN_SQL"),
    ("o.sql", 2, "SELECT 1 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_mktsegment = 'BUILDING'", "PLAIN_SQL"), ("o.sql", 3, "SELECT 1 FROM lineitem l WHERE l.l_orderkey IN (SELECT o.o_orderkey FROM orders o)", "PLAIN_SQL"),
    ("o.sql", 4, "INSERT INTO customer (c_custkey) SELECT s.s_custkey FROM staged s", "PLAIN_SQL"), ("o.sql", 5, "INSERT INTO elsewhere (k) SELECT c.c_custkey FROM customer c", "PLAIN_SQL"),
    ("o.sql", 6, "INSERT INTO customer (c_acctbal) SELECT sum(o.o_totalprice) FROM orders o", "PLAIN_SQL"),
]
#: What the rules give for STATEMENTS, worked out by hand: confidence is 1 minus the product of 1 minus the scores, repeats included.
RELATIONSHIPS = [
    ("sales.shop_id", "shops.id", "FK_LIKE", "DDL_DECLARED_FK", 0.972, 5, 5), ("shop_totals.shop_id", "shops.id", "FK_LIKE", "INFERRED_JOIN_FK", 0.8822, 5, 4), ("sales.clerk_id", "clerks.id", "FK_LIKE", "INFERRED_JOIN_FK", 0.7476, 5, 5),
    ("shifts.clerk_id", "clerks.id", "FK_LIKE", "INFERRED_SUBQUERY_FK", 0.7245, 3, 3), ("clerks.boss_id", "clerks.id", "FK_LIKE", "INFERRED_JOIN_FK", 0.7048, 3, 3), ("sales.shop_id", "shop_totals.shop_id", "CO_OCCURRENCE", "COLUMN_CO_OCCURRENCE", 0.55, 1, 1),
]
LINEAGE = [
    ("VALUE", "DIRECT", "sales.shop_id", "shop_totals.shop_id", 0.9, 2, 0), ("VALUE", "AGGREGATE", "sales.amount", "shop_totals.total", 0.8, 1, 1), ("CONTROL", "WINDOW_DERIVED", "sales.shop_id,shops.city_id", "shop_totals.rank_no", 0.55, 1, 2),
    ("VALUE", "CASE_WHEN", "shop_totals.base,shop_totals.total", "shop_totals.grade", 0.65, 1, 1000), ("CONTROL", "CASE_WHEN", "shop_totals.total", "shop_totals.grade", 0.55, 1, 1001), ("CONTROL", "DIRECT", "shop_totals.shop_id", "shop_totals.grade", 0.55, 1, 1002),
    ("VALUE", "DIRECT", "shops.city_id", "city_totals.city_id", 0.9, 1, 2000), ("VALUE", "ARITHMETIC", "shop_totals.total", "city_totals.total", 0.75, 1, 2001), ("VALUE", "ARITHMETIC", "sales.amount,shop_totals.total", "shop_totals.total", 0.75, 1, 3000),
    ("VALUE", "DIRECT", "sales.amount", "shop_totals.total", 0.9, 1, 3002), ("CONTROL", "DIRECT", "sales.shop_id,shop_totals.shop_id", "shop_totals.total", 0.55, 1, 3003), ("CONTROL", "DIRECT", "sales.shop_id,shop_totals.shop_id", "shop_totals.shop_id", 0.55, 1, 3004),
]
NAMING = [("clerks.boss_id", "clerks.id", "SELF_ROLE_ID"), ("sales.clerk_id", "clerks.id", "TABLE_ID"), ("sales.shop_id", "shops.id", "TABLE_ID"), ("shifts.clerk_id", "clerks.id", "TABLE_ID"), ("shop_totals.shop_id", "shops.id", "TABLE_ID")]
DDL = [
    ("COLUMN", "id", "shops.id", None, 1, 1, "bigint"), ("PRIMARY", None, "shops.id", None, 1, 1, "FULL_COLUMN"), ("COLUMN", "name", "shops.name", None, 1, 1, "varchar"), ("COLUMN", "city_id", "shops.city_id", None, 1, 1, "bigint"),
    ("UNIQUE", "u_name", "shops.name", None, 1, 1, "FULL_COLUMN"), ("COLUMN", "id", "sales.id", None, 1, 1, "bigint"), ("PRIMARY", None, "sales.id", None, 1, 1, "FULL_COLUMN"), ("COLUMN", "shop_id", "sales.shop_id", None, 1, 1, "bigint"),
    ("COLUMN", "clerk_id", "sales.clerk_id", None, 1, 1, "bigint"), ("COLUMN", "amount", "sales.amount", None, 1, 1, "decimal"), ("FOREIGN_KEY", "fk_shop", "sales.shop_id", "shops.id", 1, 1, ""), ("INDEX", "i_clerk", "sales.clerk_id", None, 1, 1, "FULL_COLUMN"),
    ("UNIQUE", "u_clerk", "clerks.id", None, 1, 1, "FULL_COLUMN"),
]
FRAMES = [
    ("a.sql", 0, "-- tables\nCREATE TABLE t (id INT)", "DDL_FILE", "TABLE", "t", 1, 2, False, None), ("a.sql", 1, "INSERT INTO t VALUES (1)", "PLAIN_SQL", None, None, 3, 3, False, None),
    ("a.sql", 2, "CREATE PROCEDURE p()\nBEGIN\n  UPDATE t SET id = 2;\n  SELECT 'a;b//c';\nEND", "PROCEDURE", "PROCEDURE", "p", 5, 9, False, None), ("a.sql", 3, "SELECT 1", "PLAIN_SQL", None, None, 11, 11, False, None),
    ("b.sql", 0, "CREATE VIEW v AS SELECT id FROM t", "VIEW", "VIEW", "v", 1, 1, False, None), ("b.sql", 1, "SELECT ';' AS x -- no; end", "PLAIN_SQL", None, None, 2, 2, False, None),
]
#: Derived relationships over the keys of the folder's tables: least confidence of the edges (a bridge's 0.55) times 0.75 for each hop after the first.
BRIDGED = [(p, round(0.55 * 0.75 ** (p.count(">") - 1) + 1e-9, 4)) for p in (
    "orders.o_custkey>customer.c_custkey>customer.c_nationkey>nation.n_nationkey", "lineitem.l_orderkey>orders.o_orderkey>orders.o_custkey>customer.c_custkey", "lineitem.l_suppkey>supplier.s_suppkey>supplier.s_nationkey>nation.n_nationkey",
    "customer.c_nationkey>nation.n_nationkey>nation.n_regionkey>region.r_regionkey", "supplier.s_nationkey>nation.n_nationkey>nation.n_regionkey>region.r_regionkey",
    "orders.o_custkey>customer.c_custkey>customer.c_nationkey>nation.n_nationkey>nation.n_regionkey>region.r_regionkey", "lineitem.l_orderkey>orders.o_orderkey>orders.o_custkey>customer.c_custkey>customer.c_nationkey>nation.n_nationkey",
    "lineitem.l_suppkey>supplier.s_suppkey>supplier.s_nationkey>nation.n_nationkey>nation.n_regionkey>region.r_regionkey",
)]
J, I, E = "SQL_LOG_JOIN", "SQL_LOG_SUBQUERY_IN", "SQL_LOG_EXISTS"
#: (name, statement, [(source, target, evidence)]): one of each shape, and shapes that give nothing.
PAIR_CASES = [
    ("comma", "SELECT 1 FROM a, b WHERE a.x_id = b.id", [("a.x_id", "b.id", J)]),
    ("self", "SELECT 1 FROM a x JOIN a y ON x.up_id = y.id", [("a.id", "a.up_id", J)]),
    ("self_same", "SELECT 1 FROM a x JOIN a y ON x.id = y.id", []),
    ("in", "SELECT 1 FROM a WHERE a.k IN (SELECT b.id FROM b)", [("a.k", "b.id", I)]),
    ("tuple_in", "SELECT 1 FROM a WHERE (a.k, a.l) IN (SELECT b.k, b.l FROM b)", [("a.k", "b.k", I), ("a.l", "b.l", I)]),
    ("exists", "SELECT 1 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.a_id = a.id)", [("a.id", "b.a_id", E)]),
    ("derived", "SELECT 1 FROM a JOIN (SELECT c.id AS cid FROM c) d ON d.cid = a.c_id", [("a.c_id", "c.id", J)]),
    ("cte", "WITH v AS (SELECT c.id FROM c), w AS (SELECT * FROM v) SELECT 1 FROM a JOIN w ON w.id = a.c_id", [("a.c_id", "c.id", J)]),
    ("using", "SELECT 1 FROM a LEFT JOIN b USING (k)", [("a.k", "b.k", J)]),
    ("delete", "DELETE FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.id = a.b_id)", [("a.b_id", "b.id", E)]),
    ("update_from", "UPDATE a SET v = 1 FROM b WHERE b.id = a.b_id", [("a.b_id", "b.id", J)]),
    ("union", "SELECT 1 FROM a UNION ALL SELECT 1 FROM b JOIN c ON b.c_id = c.id", [("b.c_id", "c.id", J)]),
    ("any", "SELECT 1 FROM a WHERE a.k = ANY (SELECT b.id FROM b)", [("a.k", "b.id", I)]),
    ("function", "SELECT 1 FROM a JOIN b ON lower(a.m) = b.m", []),
    ("arithmetic", "SELECT 1 FROM a JOIN b ON a.m = b.m + 1 WHERE a.k IN (1, 2) AND b.n LIKE 'x%'", []),
    ("aggregate_in", "SELECT 1 FROM a WHERE a.k IN (SELECT sum(b.v) FROM b)", []),
    ("twice_named", "SELECT 1 FROM a JOIN b x ON x.id = a.id2 JOIN c x ON x.id = a.id3", []),
    ("unqualified", "SELECT id FROM a WHERE k = l", []),
]
V, C = "VALUE", "CONTROL"
LINEAGE_CASES = [
    ("insert_select", "INSERT INTO t (a, b) SELECT s.x, s.y + s.z FROM s", [(V, "DIRECT", "s.x", "t.a"), (V, "ARITHMETIC", "s.y,s.z", "t.b")]),
    ("insert_cte", "INSERT INTO t (a) WITH c AS (SELECT sum(s.x) AS n FROM s) SELECT c.n FROM c", [(V, "AGGREGATE", "s.x", "t.a")]),
    ("update_case", "UPDATE t SET a = CASE WHEN t.c > 1 THEN t.d ELSE t.e END", [(V, "CASE_WHEN", "t.d,t.e", "t.a"), (C, "CASE_WHEN", "t.c", "t.a")]),
    ("update_where", "UPDATE t SET a = coalesce(t.b, 0) WHERE t.k = 3", [(V, "COALESCE", "t.b", "t.a"), (C, "DIRECT", "t.k", "t.a")]),
    ("window", "INSERT INTO t (a) SELECT sum(s.x) OVER (PARTITION BY s.g ORDER BY s.o) FROM s", [(V, "AGGREGATE", "s.x", "t.a"), (C, "WINDOW_DERIVED", "s.g,s.o", "t.a")]),
    ("concat", "INSERT INTO t (a) SELECT concat(s.x, s.y) || s.z FROM s", [(V, "CONCAT_FORMAT", "s.x,s.y,s.z", "t.a")]),
    ("merge", "MERGE INTO t USING s ON (t.k = s.k) WHEN MATCHED THEN UPDATE SET t.a = s.b", [(V, "DIRECT", "s.b", "t.a"), (C, "DIRECT", "s.k,t.k", "t.a")]),
    ("upsert", "INSERT INTO t (k, a) SELECT s.k, s.a FROM s ON DUPLICATE KEY UPDATE a = a + VALUES(a)", [(V, "DIRECT", "s.k", "t.k"), (V, "DIRECT", "s.a", "t.a"), (V, "ARITHMETIC", "s.a,t.a", "t.a")]),
    ("view", "CREATE VIEW v AS SELECT s.x AS y, upper(s.z) AS w FROM s", [(V, "DIRECT", "s.x", "v.y"), (V, "FUNCTION_CALL", "s.z", "v.w")]),
]
#: (dialect, version, profile, reason)
VERSIONS = [
    ("mysql", "8.0", "mysql-8.0", "EXACT"), ("mysql", "8.4.3", "mysql-8.0", "SAME_MAJOR"), ("mysql", "9.1", "mysql-8.0", "OLDER_MAJOR"), ("mysql", "5.5", "mysql-5.7", "SAME_MAJOR"), ("mysql", "4.1", None, "TOO_OLD"), ("postgres", "PostgreSQL 17.2", "postgres-17", "SAME_MAJOR"),
    ("postgres", "14", None, "TOO_OLD"), ("oracle", "19c", "oracle-19c", "EXACT"), ("oracle", "23.4", "oracle-21c", "OLDER_MAJOR"), ("sqlserver", "15.0.2000", "sqlserver-2019", "SAME_MAJOR"), ("sqlserver", "2022", "sqlserver-2022", "EXACT"), ("common", "1", None, "NO_DIALECT"), ("mysql", "", None, "NO_VERSION"),
]
FEATURE_CASES = [
    ("mysql", "5.7", "WITH v AS (SELECT c.id FROM c) SELECT 1 FROM a JOIN v ON v.id = a.c_id", "FEATURE_NOT_IN_mysql-5.7: cte"), ("mysql", "8.0", "WITH v AS (SELECT c.id FROM c) SELECT 1 FROM a JOIN v ON v.id = a.c_id", None),
    ("mysql", "5.7", "SELECT row_number() OVER (ORDER BY a.x) AS n FROM a", "FEATURE_NOT_IN_mysql-5.7: window"), ("sqlserver", "2016", "SELECT string_agg(a.x, ',') AS s FROM a WHERE a.y = 'greatest(1)'", "FEATURE_NOT_IN_sqlserver-2016: string_agg"),
]
#: (name, routine, [(kind, source, target)])
ROUTINE_CASES = [
    ("plpgsql", "CREATE FUNCTION f() RETURNS void AS $$ DECLARE r RECORD; n INT := 0; BEGIN FOR r IN (SELECT o.id FROM orders o JOIN users u ON u.id = o.user_id) LOOP INSERT INTO totals (k) SELECT l.amount FROM lines l WHERE l.note <> 'a;b'; END LOOP; IF EXISTS (SELECT 1 FROM a JOIN b ON b.a_id = a.id) THEN UPDATE c SET v = d.w FROM d WHERE d.c_id = c.id; END IF; RETURN QUERY SELECT 1 FROM x JOIN y ON y.x_id = x.id; END $$ LANGUAGE plpgsql",
     [("PAIR", "orders.user_id", "users.id"), ("FLOW", "lines.amount", "totals.k"), ("PAIR", "a.id", "b.a_id"), ("PAIR", "c.id", "d.c_id"), ("FLOW", "d.w", "c.v"), ("PAIR", "x.id", "y.x_id")]),
    ("plsql", "CREATE OR REPLACE PROCEDURE p IS CURSOR c IS SELECT o.id FROM orders o JOIN users u ON u.id = o.user_id; v NUMBER; BEGIN OPEN c; SELECT s.total INTO v FROM sums s JOIN kinds k ON k.id = s.kind_id; MERGE INTO t USING s2 ON (t.k = s2.k) WHEN MATCHED THEN UPDATE SET t.v = s2.v; END;",
     [("PAIR", "orders.user_id", "users.id"), ("PAIR", "kinds.id", "sums.kind_id"), ("PAIR", "s2.k", "t.k"), ("FLOW", "s2.v", "t.v")]),
    ("tsql", "CREATE PROCEDURE p AS BEGIN DECLARE @n INT = 1; IF @n > 0 BEGIN DELETE FROM a WHERE a.k IN (SELECT b.id FROM b); END ELSE INSERT INTO t (x) SELECT s.y FROM s; END",
     [("PAIR", "a.k", "b.id"), ("FLOW", "s.y", "t.x")]),
    ("mysql", "CREATE PROCEDURE p() BEGIN DECLARE done INT DEFAULT 0; DECLARE c CURSOR FOR SELECT o.id FROM orders o JOIN users u ON u.id = o.user_id; WHILE done < 3 DO UPDATE t SET a = 'x;y' WHERE EXISTS (SELECT 1 FROM q WHERE q.t_id = t.id); SET done = done + 1; END WHILE; END",
     [("PAIR", "orders.user_id", "users.id"), ("PAIR", "q.t_id", "t.id")]),
]
