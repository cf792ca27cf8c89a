"""Results in and out: JSON documents, text tables, sharded and atomic writes, fingerprints."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RELATIONSHIP = "src_key string, tgt_key string, relation_type string, subtype string, confidence decimal(5,4)"
LINEAGE = "sources array<string>, target string, flow string, transform string, confidence decimal(5,4)"
NAMING = "id string, src_key string, tgt_key string, rule string, direction_hint string"


def read_scan_result(spark: SparkSession, path: str, sections: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The sections of scan results (JSON documents, one for each file) as DataFrames, each with source_name. A document that breaks the schema fails the read."""
    sections = sections or {"relationships": RELATIONSHIP, "lineage": LINEAGE, "naming": NAMING}
    fields = lambda text: ",".join(f"{p.split(' ')[0]}:{p.split(' ', 1)[1]}" for p in text.split(", "))
    schema = ", ".join(f"{name} array<struct<{fields(text)}>>" for name, text in sections.items())
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("source_name", F.col("_metadata.file_path"))
    return {name: read.select("source_name", F.explode(name).alias("x")).select("source_name", "x.*") for name in sections}


def write_scan_result(facts: dict[str, DataFrame], path: str) -> None:
    """A folder for each section, as JSON lines, and `summary` with the number of rows of each. A section is complete once its _SUCCESS file is there."""
    spark = next(iter(facts.values())).sparkSession
    counts = []
    for name, df in facts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts.append((name, spark.read.schema(df.schema).json(f"{path}/{name}").count()))
    spark.createDataFrame(counts, "section string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_document(facts: dict[str, DataFrame], path: str) -> dict[str, int]:
    """One JSON document of all sections and a summary of their numbers, at a local path; rows come partition by partition, so the driver never holds a section, and the file appears whole by a rename."""
    import os

    counts: dict[str, int] = {}
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write("{")
        for name, df in facts.items():
            f.write(f"{json.dumps(name)}: [")
            n = 0
            for n, row in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator(), 1):
                f.write(("," if n > 1 else "") + "\n" + row[0])
            counts[name] = n
            f.write("],\n")
        f.write(f'"summary": {json.dumps(counts)}}}\n')
    os.replace(f"{path}.part", path)
    return counts


def read_sections(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, path: str, version: str) -> None:
    """path/CURRENT names the version that readers take; it is replaced by one rename, which on a local or HDFS folder is atomic. Versions before the last are then removed."""
    fs_, fs = _fs(spark, path)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/__next")
    part = next(f.getPath() for f in fs.listStatus(fs_.Path(f"{path}/__next")) if f.getPath().getName().startswith("part-"))
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs_.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    old = current(spark, path)
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(part, context.makeQualified(fs_.Path(f"{path}/CURRENT")), options)
    fs.delete(fs_.Path(f"{path}/__next"), True)
    for f in fs.listStatus(fs_.Path(path)):
        if f.isDirectory() and f.getPath().getName() not in (version, old):
            fs.delete(f.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The published version of path, if any."""
    fs_, fs = _fs(spark, path)
    if not fs.exists(fs_.Path(f"{path}/CURRENT")):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written to a folder of its own under path, to which path/CURRENT then points: readers (see published) see the old result or the new one, whole, and a failed write changes nothing."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{path}/{version}")
    _commit(df.sparkSession, path, version)


def published(spark: SparkSession, path: str, fmt: str = "parquet", name: str = "") -> DataFrame:
    """The published result; `name` is a result of a bundle."""
    if (version := current(spark, path)) is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(fmt).load(f"{path}/{version}/{name}".rstrip("/"))


def publish_bundle(results: dict[str, DataFrame], path: str) -> None:
    """Several results published together, by one rename after all are written."""
    version = f"v-{uuid.uuid4().hex}"
    for name, df in results.items():
        df.write.parquet(f"{path}/{version}/{name}")
    _commit(next(iter(results.values())).sparkSession, path, version)


def write_shards(bundle: DataFrame, path: str, shard_col: str = "shard_id") -> None:
    bundle.write.mode("overwrite").partitionBy(shard_col).json(path)


def text_table(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Rows as lines of fixed-width cells, for a text sink."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in columns.items()]
    return df.select(F.rtrim(F.concat_ws(" | ", *cells)).alias("value"))


def canonical_fingerprint(df: DataFrame, volatile: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """(n, fingerprint): SHA-256 over the sorted hashes of the rows, columns in name order, volatile ones left out; row order doesn't matter, repeats do.

    The rows' hashes are summed up by their first byte before they meet, so no task holds more than 256 digests at the end.
    """
    columns = sorted(c for c in df.columns if c not in volatile)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    number = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(38,0)")
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), *[F.sum(number(1 + 8 * i)).alias(f"s{i}") for i in range(8)])
    line = F.concat_ws(":", "p", "n", *[F.col(f"s{i}").cast("string") for i in range(8)])
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("fingerprint"))
