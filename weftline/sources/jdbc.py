"""Live catalogs over JDBC: the catalog queries as reader options. Reading needs the vendor's driver on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "SELECT table_schema, table_name, column_name, data_type, ordinal_position, is_nullable FROM information_schema.columns WHERE table_schema = '{schema}'"
CATALOG = {
    ("mysql", "columns"): COLUMNS,
    ("postgres", "columns"): COLUMNS,
    ("sqlserver", "columns"): COLUMNS,
    ("oracle", "columns"): "SELECT owner AS table_schema, table_name, column_name, data_type, column_id AS ordinal_position, nullable AS is_nullable FROM all_tab_columns WHERE owner = '{schema}'",
    ("mysql", "constraints"): "SELECT constraint_name, table_name, column_name, ordinal_position, referenced_table_name, referenced_column_name FROM information_schema.key_column_usage WHERE table_schema = '{schema}'",
    ("postgres", "constraints"): "SELECT c.conname AS constraint_name, r.relname AS table_name, a.attname AS column_name, u.i AS ordinal_position, f.relname AS referenced_table_name, b.attname AS referenced_column_name FROM pg_constraint c JOIN pg_class r ON r.oid = c.conrelid JOIN pg_namespace n ON n.oid = r.relnamespace CROSS JOIN LATERAL unnest(c.conkey) WITH ORDINALITY u(k, i) JOIN pg_attribute a ON a.attrelid = r.oid AND a.attnum = u.k LEFT JOIN pg_class f ON f.oid = c.confrelid LEFT JOIN pg_attribute b ON b.attrelid = f.oid AND b.attnum = c.confkey[u.i] WHERE n.nspname = '{schema}'",
    ("sqlserver", "constraints"): "SELECT fk.name AS constraint_name, OBJECT_NAME(c.parent_object_id) AS table_name, COL_NAME(c.parent_object_id, c.parent_column_id) AS column_name, c.constraint_column_id AS ordinal_position, OBJECT_NAME(c.referenced_object_id) AS referenced_table_name, COL_NAME(c.referenced_object_id, c.referenced_column_id) AS referenced_column_name FROM sys.foreign_key_columns c JOIN sys.foreign_keys fk ON fk.object_id = c.constraint_object_id WHERE SCHEMA_NAME(fk.schema_id) = '{schema}'",
    ("oracle", "constraints"): "SELECT c.constraint_name, c.table_name, k.column_name, k.position AS ordinal_position, r.table_name AS referenced_table_name, r.column_name AS referenced_column_name FROM all_constraints c JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name LEFT JOIN all_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name AND r.position = k.position WHERE c.owner = '{schema}' AND c.constraint_type IN ('P', 'U', 'R')",
    ("mysql", "indexes"): "SELECT index_name, table_name, column_name, seq_in_index AS ordinal_position, non_unique, sub_part, is_visible FROM information_schema.statistics WHERE table_schema = '{schema}'",
    ("postgres", "indexes"): "SELECT i.relname AS index_name, t.relname AS table_name, a.attname AS column_name, k.n AS ordinal_position, x.indisunique AS is_unique FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY k(att, n) LEFT JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.att WHERE n.nspname = '{schema}'",
    ("sqlserver", "indexes"): "SELECT i.name AS index_name, OBJECT_NAME(i.object_id) AS table_name, COL_NAME(c.object_id, c.column_id) AS column_name, c.key_ordinal AS ordinal_position, i.is_unique FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id WHERE OBJECT_SCHEMA_NAME(i.object_id) = '{schema}'",
    ("oracle", "indexes"): "SELECT c.index_name, c.table_name, c.column_name, c.column_position AS ordinal_position, i.uniqueness, i.visibility FROM all_ind_columns c JOIN all_indexes i ON i.owner = c.index_owner AND i.index_name = c.index_name WHERE c.table_owner = '{schema}'",
    ("mysql", "objects"): "SELECT routine_type AS object_type, routine_name AS object_name, routine_definition AS definition FROM information_schema.routines WHERE routine_schema = '{schema}' UNION ALL SELECT 'VIEW', table_name, view_definition FROM information_schema.views WHERE table_schema = '{schema}' UNION ALL SELECT 'TRIGGER', trigger_name, action_statement FROM information_schema.triggers WHERE trigger_schema = '{schema}'",
    ("postgres", "objects"): "SELECT CASE p.prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS object_type, p.proname AS object_name, pg_get_functiondef(p.oid) AS definition FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace WHERE n.nspname = '{schema}' AND p.prokind IN ('p', 'f') UNION ALL SELECT 'VIEW', viewname, definition FROM pg_views WHERE schemaname = '{schema}' UNION ALL SELECT 'MATERIALIZED_VIEW', matviewname, definition FROM pg_matviews WHERE schemaname = '{schema}'",
    ("sqlserver", "objects"): "SELECT o.type_desc AS object_type, o.name AS object_name, m.definition FROM sys.sql_modules m JOIN sys.objects o ON o.object_id = m.object_id WHERE SCHEMA_NAME(o.schema_id) = '{schema}'",
    ("oracle", "objects"): "SELECT type AS object_type, name AS object_name, line, text AS definition FROM all_source WHERE owner = '{schema}'",
}


def catalog_query(dialect: str, what: str, schema: str) -> str:
    """The query for columns, constraints, indexes or objects. The schema name is quoted as a literal."""
    return CATALOG[dialect, what].replace("{schema}", schema.replace("'", "''"))


def read(spark: SparkSession, url: str, dialect: str, what: str, schema: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=catalog_query(dialect, what, schema), **options).load()
