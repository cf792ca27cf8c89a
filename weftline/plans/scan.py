"""The scan: statements and catalog to relationships, lineage, naming and derived paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import evidence_score
from ..operators import catalog, evidence, graph, lineage, naming, profile
from ..session import checkpoint
from ..sources import logs, scripts
from . import profiles
from .sqlfacts import analyse

_COND = pa.struct([("discriminator", pa.string()), ("operator", pa.string()), ("value", pa.string())])
_PAIR = pa.struct([("src_key", pa.string()), ("tgt_key", pa.string()), ("evidence_type", pa.string()), ("join_kind", pa.string()), ("line", pa.int32()), ("self_join", pa.bool_()), ("conditions", pa.list_(_COND))])
_LINE = pa.struct([("sources", pa.list_(pa.string())), ("target", pa.string()), ("flow", pa.string()), ("transform", pa.string()), ("mapping", pa.string())])
_DDL = pa.struct([("event", pa.string()), ("name", pa.string()), ("key", pa.string()), ("other", pa.string()), ("position", pa.int32()), ("size", pa.int32()), ("detail", pa.string())])
ANALYSED = (
    "source_name string, ordinal int, source_type string, object_name string, sql string, tables array<string>, diagnostic string, "
    "pairs array<struct<src_key:string,tgt_key:string,evidence_type:string,join_kind:string,line:int,self_join:boolean,conditions:array<struct<discriminator:string,operator:string,value:string>>>>, "
    "lineage array<struct<sources:array<string>,target:string,flow:string,transform:string,mapping:string>>, ddl array<struct<event:string,name:string,key:string,other:string,position:int,size:int,detail:string>>"
)
TEMPORARY = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|LOCAL\s+)?TEMP(?:ORARY)?\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.$]+)"
#: A chain of temporary tables is followed for so many steps.
CHAIN = 5
#: Statements whose facts a task remembers; bytes of input, as the optimizer estimates them, for which a task of its own pays.
KNOWN, PIECE = 20_000, 16_384
ROUTINES = ("PROCEDURE", "FUNCTION", "TRIGGER", "PACKAGE", "PACKAGE_BODY", "EVENT")
STARTS = frozenset(("INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "SELECT"))


@dataclass(frozen=True)
class Config:
    """What a scan reads and how it decides."""

    scripts: tuple[str, ...] = ()
    pattern: str = "*.sql"
    logs: tuple[str, ...] = ()
    dialect: str = "common"
    version: str = ""
    min_confidence: str = "0.30"
    longest_path: int = 5
    profile: profile.Options = field(default_factory=profile.Options)
    user_rules: tuple[naming.UserRule, ...] = ()
    most_derived: int = 0
    slow_logs: tuple[str, ...] = ()


def body_statements(sql: str) -> list[str]:
    """The data statements in a routine's body, of any of the dialects' languages.

    The body is cut at semicolons, and before a statement that follows THEN, ELSE, LOOP, DO or BEGIN, outside strings, comments and brackets. Of each piece, what begins with INSERT, UPDATE, DELETE, MERGE, WITH or
    SELECT is a statement (of cursors, loops and RETURN QUERY as well), and so is a query in brackets of what stands before it, such as that of a loop or a condition.
    """
    body = re.sub(r"--[^\n]*|/\*.*?\*/", "", sql, flags=re.S)
    m = re.search(r"\bBEGIN\b|\bAS\s+\$\w*\$|\bIS\b|\bAS\b", body, re.I)
    body = re.sub(r"\$\w*\$", " ", body[m.end() :] if m else body)
    pieces, start, depth, opener, merging = [], 0, 0, False, False
    for t in scripts.TOKEN.finditer(body):
        word = t.group().upper()
        if word.isspace():
            continue
        if depth == 0 and opener and word in STARTS and not merging:  # a MERGE has its own THEN
            pieces.append(body[start : t.start()])
            start = t.start()
        merging = merging or depth == 0 and word == "MERGE"
        depth += (word == "(") - (word == ")")
        if word == ";" and depth <= 0:
            pieces.append(body[start : t.start()])
            start, depth, merging = t.end(), 0, False
        opener = word in ("THEN", "ELSE", "LOOP", "DO", "BEGIN")
    out = []
    for piece in [*pieces, body[start:]]:
        depth, inside, at = 0, 0, None
        for t in scripts.TOKEN.finditer(piece):
            word = t.group().upper()
            if word == "(":
                depth += 1
                inside = t.end() if depth == 1 else inside
            elif word == ")":
                depth -= 1
                if depth == 0 and re.match(r"\s*(?:SELECT|WITH)\b", piece[inside : t.start()], re.I):
                    out.append(piece[inside : t.start()].strip())
            elif depth == 0 and word in STARTS:
                at = t.start()
                break
        if at is not None and not re.match(r"(?:UPDATE|DELETE|INSERT)\s+(?:OF|ON|OR)\b", piece[at:], re.I):
            out.append(re.sub(r"\bEND\b(?:\s+(?:LOOP|IF|WHILE|REPEAT))?\s*$", "", piece[at:], flags=re.I).strip())
    return out


def _analysed(dialect: str, keep: tuple[str, ...], version: str = ""):
    profile = profiles.select(dialect, version)[0]

    def one(sql: str | None, kind: str | None) -> tuple:
        made = [analyse(s, dialect, kind or "") for s in (body_statements(sql or "") if kind in ROUTINES else [sql or ""])]
        facts = [f for f, _ in made]
        said = [d for _, d in made if d] + [f"FEATURE_NOT_IN_{profile.id}: {f}" for f in profiles.unknown_features(sql or "", profile)]
        return sorted({t for f in facts for t in f.tables}), "; ".join(said) or None, *([x for f in facts for x in getattr(f, k)] for k in ("pairs", "lineage", "ddl"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            at: dict[tuple, int] = {}
            texts, kinds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sql", "source_type"))
            rows = pa.array([at.setdefault(k, len(at)) for k in zip(texts, kinds)], pa.int32())
            if len(known) > KNOWN:
                known.clear()
            for k in at:
                if k not in known:
                    known[k] = one(*k)
            out = list(zip(*(known[k] for k in at))) or [()] * 5
            own = ["source_name", "ordinal", "source_type", "object_name", "sql", *keep]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in own]
            types = (pa.list_(pa.string()), pa.string(), pa.list_(_PAIR), pa.list_(_LINE), pa.list_(_DDL))
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(v, t).take(rows) for v, t in zip(out, types)], names=own + ["tables", "diagnostic", "pairs", "lineage", "ddl"])

    return each


def spread(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """rows in several tasks for each core, where a file of few bytes, and so of few tasks, may hold very many: one task for `piece` bytes at most. Streams, and what has enough tasks as it is, stay."""
    if rows.isStreaming:
        return rows
    spark = rows.sparkSession
    tasks = 3 * spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    whole = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return rows.repartition(min(tasks, size // piece)) if 2 * piece <= size < tasks * whole else rows


def analysed(statements: DataFrame, dialect: str = "common", keep: tuple[str, ...] = (), version: str = "") -> DataFrame:
    """A row for each statement (sql; source_name, ordinal, source_type, object_name if there) with its tables, pairs, lineage, DDL and diagnostic. Equal statements are read once in a task, and tasks are evened out, see spread(); a failing statement costs only a diagnostic, and so does what the version (see profiles.select) doesn't know."""
    kinds = {"source_name": "string", "ordinal": "int", "source_type": "string", "object_name": "string"}
    rows = statements.select("sql", *[(F.col(c) if c in statements.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()], *keep)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in statements.schema if f.name in keep)
    head, tail = ANALYSED.split("tables array", 1)
    return spread(rows).mapInArrow(_analysed(dialect, keep, version), f"{head}{extra}tables array{tail}")


def pair_evidence(read: DataFrame) -> DataFrame:
    """The evidence of column pairs seen in SQL, and of declared keys in DDL."""
    ordinal = F.coalesce("ordinal", F.lit(0))
    seen = read.select("source_name", "source_type", ordinal.alias("o"), F.posexplode("pairs").alias("i", "p")).select(
        "p.src_key", "p.tgt_key", F.lit("CO_OCCURRENCE").alias("relation_type"), "p.evidence_type", "source_type", F.col("source_name").alias("source"), evidence_score(F.col("p.evidence_type")).alias("score"),
        F.concat_ws(":", F.lit("stmt"), F.col("o"), F.col("p.line")).alias("detail"), "p.conditions", (F.col("o") * 1000 + F.col("i")).cast("long").alias("ordinal"),
    )
    declared = read.select("source_name", "source_type", ordinal.alias("o"), F.posexplode("ddl").alias("i", "d")).filter("d.event = 'FOREIGN_KEY'").select(
        F.col("d.key").alias("src_key"), F.col("d.other").alias("tgt_key"), F.lit("FK_LIKE").alias("relation_type"), F.lit("DDL_FOREIGN_KEY").alias("evidence_type"), "source_type", F.col("source_name").alias("source"),
        evidence_score(F.lit("DDL_FOREIGN_KEY")).alias("score"), F.concat_ws(":", F.lit("ddl"), F.col("o"), F.col("d.position"), F.col("d.size")).alias("detail"),
        F.array().cast("array<struct<discriminator:string,operator:string,value:string>>").alias("conditions"), (F.col("o") * 1000 + F.col("i")).cast("long").alias("ordinal"),
    )
    return seen.unionByName(declared)


def ddl_columns(read: DataFrame) -> DataFrame:
    d = read.select(F.explode("ddl").alias("d")).select("d.*").filter("event = 'COLUMN'")
    table = F.regexp_replace("key", r"\.[^.]*$", "")
    return d.select("key", table.alias("table"), F.regexp_extract("key", r"([^.]*)$", 1).alias("column"), F.col("detail").alias("type")).distinct()


def ddl_unique(read: DataFrame) -> DataFrame:
    """(key) of single-column unique and primary keys; composite members aren't unique by themselves."""
    return read.select(F.explode("ddl").alias("d")).select("d.*").filter("event IN ('UNIQUE', 'PRIMARY') AND size = 1 AND detail = 'FULL_COLUMN'").select("key").distinct()


def used_columns(read: DataFrame) -> DataFrame:
    """(key, table, column) of the columns in DDL and pairs."""
    keys = read.select(F.explode("pairs").alias("p")).select(F.explode(F.array("p.src_key", "p.tgt_key")).alias("key")).unionByName(ddl_columns(read).select("key")).distinct()
    return keys.select("key", F.regexp_replace("key", r"\.[^.]*$", "").alias("table"), F.regexp_extract("key", r"([^.]*)$", 1).alias("column"))


def temporary_tables(read: DataFrame) -> DataFrame:
    """(source_name, table): those that a source creates as temporary, and names that begin with #."""
    made = read.select("source_name", F.lower(F.regexp_extract("sql", TEMPORARY, 1)).alias("table")).filter("`table` <> ''")
    hashed = read.select("source_name", F.explode("tables").alias("table")).filter(F.col("table").startswith("#"))
    return made.unionByName(hashed).distinct()


def bridge(found: DataFrame, read: DataFrame) -> DataFrame:
    """Evidence whose columns of temporary tables are replaced by what they were last filled from, directly and from one column, in the same source at or before the statement; without that, it goes."""
    table = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    temp = checkpoint(temporary_tables(read))
    if temp.isEmpty():
        return found
    line = F.coalesce("ordinal", F.lit(0)).cast("long")
    filled = read.select("source_name", line.alias("line"), F.explode("lineage").alias("l")).filter("l.flow = 'VALUE'").select("source_name", "line", table(F.col("l.target")).alias("table"), "l.*")
    single = F.when((F.size("sources") == 1) & (F.col("transform") == "DIRECT"), F.col("sources")[0])
    declared = checkpoint(filled.join(temp, ["source_name", "table"], "left_semi").select(F.concat_ws("|", "source_name", "target").alias("name"), "line", single.alias("source")))
    marked = temp.select(F.col("source_name").alias("source"), "table", F.lit(True).alias("__temp"))
    out = found.withColumn("__line", F.floor(F.col("ordinal") / 1000).cast("long")).withColumn("__id", F.monotonically_increasing_id())
    for end in ("src_key", "tgt_key"):
        done, now = None, checkpoint(out.withColumn("table", table(F.col(end))).join(marked, ["source", "table"], "left").drop("table"))
        for _ in range(CHAIN):
            plain, open_ = now.filter("__temp IS NULL").drop("__temp"), now.filter("__temp").drop("__temp")
            done = plain if done is None else done.unionByName(plain)
            if open_.isEmpty():
                break
            met = lineage.bridged(open_.withColumn("name", F.concat_ws("|", "source", end)).withColumn("line", F.col("__line")).withColumnRenamed("source", "__source"), declared)
            next_ = met.withColumn(end, F.col("source")).withColumn("__line", F.col("decl_line")).drop("name", "line", "source", "decl_line").withColumnRenamed("__source", "source")
            now = checkpoint(next_.withColumn("table", table(F.col(end))).join(marked, ["source", "table"], "left").drop("table"))
        out = done
    return out.filter("src_key <> tgt_key").select(*found.columns)


def profiled(directed: DataFrame, names: DataFrame, columns: DataFrame, tables: dict[str, DataFrame], options: profile.Options) -> DataFrame:
    """VALUE_* evidence of the candidate pairs within the budget: pairs seen in statements, and pairs that only their names suggest, which need containment. At most max_pairs pairs reach the driver, as names."""
    seen = directed.groupBy("src_key", "tgt_key", "relation_type").agg(F.bool_or(F.col("evidence_type").isin("DDL_FOREIGN_KEY", "METADATA_FOREIGN_KEY")).alias("declared"), F.bool_or(F.col("evidence_type").isin(*evidence.PREDICATES)).alias("sql"), F.count("*").alias("observations"))
    seen = seen.select("src_key", "tgt_key", "relation_type", "declared", F.when(F.col("declared"), "DECLARED").when(F.col("sql"), "SQL_PREDICATE").otherwise("CO_OCCURRENCE").alias("priority"), "observations", F.lit(False).alias("proposed"))
    fresh = names.join(seen.select("src_key", "tgt_key"), ["src_key", "tgt_key"], "left_anti").select("src_key", "tgt_key").distinct().select("src_key", "tgt_key", F.lit("FK_LIKE").alias("relation_type"), F.lit(False).alias("declared"), F.lit("NAMING").alias("priority"), F.lit(0).cast("long").alias("observations"), F.lit(True).alias("proposed"))
    candidates = seen.unionByName(fresh).withColumn("subtype", F.lit("COLUMN_CO_OCCURRENCE"))
    chosen = checkpoint(profile.budgeted(profile.eligible(candidates, columns, options=options), options))
    pairs = [(r[0], r[1]) for r in chosen.select("src_key", "tgt_key").collect()]
    lookup = {f"{t}.{c}".lower(): (df, c) for t, df in tables.items() for c in df.columns}
    if not pairs:
        return directed.select("src_key", "tgt_key", "relation_type", "evidence_type", "score", "detail").limit(0)
    measured = profile.metrics({k: lookup[k] for p in pairs for k in p}, pairs).join(chosen.select("src_key", "tgt_key", "relation_type", "declared", "proposed"), ["src_key", "tgt_key"])
    decided = checkpoint(profile.decide(measured, options, declared=F.col("declared")))
    kept = decided.filter("NOT proposed").unionByName(profile.new_relationships(decided.filter("proposed")))
    made = lambda rows, kind, ratio: rows.select("src_key", "tgt_key", "relation_type", kind.alias("evidence_type"), evidence_score(kind).alias("score"), F.col(ratio).alias("detail"))
    return made(kept.filter("evidence_type IS NOT NULL"), F.col("evidence_type"), "ratio").unionByName(made(kept.filter("negative"), F.lit("VALUE_MISMATCH"), "missing_ratio"))


def scan_statements(statements: DataFrame, config: Config = Config(), extra_evidence: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """relationships (with conditional and polymorphic), lineage, naming, derived_relationships, derived_lineage, derived_naming, diagnostics and evidence of a table of statements.

    tables: the catalog, by name. With it, evidence is enhanced by equal types, naming rules see all of its columns, lineage is kept for its tables only, and pairs are profiled on the data (config.profile).
    Derived results are planned when they are asked for; config.most_derived limits them in all (0: no limit).
    """
    read = checkpoint(logs.without_noise(analysed(statements, config.dialect, version=config.version)))
    found = checkpoint(bridge(pair_evidence(read), read))
    if extra_evidence is not None:
        found = found.unionByName(extra_evidence, allowMissingColumns=True)
    columns, unique, known = used_columns(read), ddl_unique(read), catalog.columns_of(tables) if tables else None
    if known is not None:
        columns = columns.unionByName(known.select("key", "table", "column")).distinct()
    pairs = found.select("src_key", "tgt_key").distinct()
    named = naming.table_id(columns).unionByName(naming.id_suffix(pairs, columns)).unionByName(naming.self_role(pairs, columns))
    if config.user_rules:
        named = named.unionByName(naming.user_rules(columns, list(config.user_rules)))
    hints = checkpoint(naming.first_match(named))
    names = naming.merged(hints)
    directed = checkpoint(evidence.directed(evidence.fold_co_occurrence(found), unique, hints))
    key = ["src_key", "tgt_key", "relation_type"]
    own = checkpoint(directed.select(*key).distinct())
    scored = lambda kind: evidence_score(F.col(kind) if isinstance(kind, str) else kind)
    more = catalog.ddl_evidence(own.select("src_key", "tgt_key"), _inventory(read)).groupBy("src_key", "tgt_key", "evidence_type").agg(F.min("observation").alias("detail"))
    more = more.join(own, ["src_key", "tgt_key"]).select(*key, "evidence_type", scored("evidence_type").alias("score"), "detail")
    matched = own.join(hints.groupBy("src_key", "tgt_key").agg(F.min("rule").alias("detail")), ["src_key", "tgt_key"]).select(*key, F.lit("NAMING_MATCH").alias("evidence_type"), scored(F.lit("NAMING_MATCH")).alias("score"), "detail")
    every = directed.unionByName(more.unionByName(matched), allowMissingColumns=True)
    if known is not None:
        typed = catalog.type_compatible(own, known).join(own, ["src_key", "tgt_key"]).select(*key, "evidence_type", "score", F.lit("").alias("detail"))
        every = every.unionByName(typed.unionByName(profiled(directed, hints, known, tables, config.profile)), allowMissingColumns=True)
    every = checkpoint(every)
    structural = every.filter(F.col("evidence_type").isin(*evidence.PREDICATES)).select("src_key", "tgt_key", F.explode_outer("conditions").alias("c")).select("src_key", "tgt_key", "c.discriminator", "c.operator", "c.value")
    flags = evidence.conditional(structural)
    no = F.lit(False)
    relationships = evidence.relationships(every, config.min_confidence).join(flags, ["src_key", "tgt_key"], "left").withColumns({c: F.coalesce(c, no) for c in ("conditional", "polymorphic")})
    relationships = checkpoint(relationships.orderBy(F.desc("confidence"), "src_key", "tgt_key", "relation_type"))
    flows = read.select("source_name", "source_type", "object_name", F.coalesce("ordinal", F.lit(0)).alias("o"), F.posexplode("lineage").alias("i", "l")).select("source_name", "source_type", "object_name", "l.*", (F.col("o") * 1000 + F.col("i")).cast("long").alias("ordinal"))
    flows = lineage.known_targets(flows, known.select("table") if known is not None else None, temporary_tables(read).select("table"))
    flows = checkpoint(lineage.merged(lineage.scored(flows)))
    diagnostics = read.filter("diagnostic IS NOT NULL").select(F.lit("PARSE_WARNING").alias("type"), F.col("source_name").alias("source"), F.coalesce("ordinal", F.lit(0)).alias("line"), F.col("diagnostic").alias("message"))
    return Results({"evidence": every, "relationships": relationships, "lineage": flows, "naming": names, "diagnostics": diagnostics}, config)


class Results(dict):
    """A scan's results by name; derived paths, which take a job for each hop, are built when one is first read."""

    DERIVED = ("derived_relationships", "derived_lineage", "derived_naming")

    def __init__(self, facts: dict[str, DataFrame], config: Config):
        super().__init__(facts)
        self.config = config

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.DERIVED:
            raise KeyError(name)
        options = {"longest": self.config.longest_path, "checkpoint": checkpoint}
        keys = self["relationships"].filter("relation_type = 'FK_LIKE' AND NOT conditional").select(F.col("src_key").alias("src"), F.col("tgt_key").alias("tgt"), "confidence")
        named = self["naming"].select(F.col("src_key").alias("src"), F.col("tgt_key").alias("tgt"), F.lit("NAMING").alias("kind"), F.lit("0.20").cast("decimal(5,4)").alias("confidence"), F.lit(1).alias("support")).distinct()
        made = (
            graph.derived_relationships(keys, **options), graph.derived_lineage(lineage.edges(self["lineage"].filter("flow = 'VALUE'")), **options), graph.paths(named, naming_graph=True, **options)
        ) if self.config.most_derived else None
        if made:
            self.update(zip(self.DERIVED, graph.fact_budget(*made, self.config.most_derived)))
        elif name == "derived_relationships":
            self[name] = graph.derived_relationships(keys, **options)
        elif name == "derived_lineage":
            self[name] = graph.derived_lineage(lineage.edges(self["lineage"].filter("flow = 'VALUE'")), **options)
        else:
            self[name] = graph.paths(named, naming_graph=True, **options)
        return self[name]


def _inventory(read: DataFrame) -> DataFrame:
    d = read.select("source_name", F.coalesce("ordinal", F.lit(0)).alias("o"), F.explode("ddl").alias("d")).filter("d.event IN ('INDEX', 'UNIQUE', 'PRIMARY')")
    return d.select("d.key", F.col("d.event").alias("role"), "d.size", F.concat_ws(":", "source_name", "o", "d.name").alias("observation"))


def scan(spark: SparkSession, config: Config, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Scripts and logs of the config, framed, read and assembled; tables: see scan_statements(). Logs of Oracle and SQL Server are plain scripts, framed as these."""
    columns = ["source_name", "ordinal", "sql", "source_type", "object_name"]
    statements = scripts.framed(scripts.script_files(spark, list(config.scripts), config.pattern), config.dialect).select(*columns)
    whole = lambda paths: spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("text"))
    if config.logs:
        if config.dialect in ("oracle", "sqlserver"):
            read = scripts.framed(whole(config.logs), config.dialect).select(*columns)
        elif config.dialect == "postgres":
            read = logs.postgres(logs.postgres_entries(whole(config.logs)))
        else:
            read = logs.mysql_general(logs.lines(spark, list(config.logs)))
        statements = statements.unionByName(read, allowMissingColumns=True)
    if config.slow_logs:
        statements = statements.unionByName(logs.mysql_slow(whole(config.slow_logs)), allowMissingColumns=True)
    return scan_statements(statements, config, tables=tables)


def batch(spark: SparkSession, configs: dict[str, Config], fail_fast: bool = True) -> dict[str, dict[str, DataFrame] | Exception]:
    """Several scans on one session; a failing one is reported, and the rest skipped if fail_fast."""
    out: dict[str, dict[str, DataFrame] | Exception] = {}
    for name, config in configs.items():
        try:
            out[name] = scan(spark, config)
        except Exception as e:  # noqa: BLE001
            out[name] = e
            if fail_fast:
                break
    return out
