"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hot import HOT_ROWS, HOT_SHARE, hot_join  # noqa: F401
from ..session import checkpoint, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bitmaps of 4 KB that only() broadcasts at most.
MOST_BITMAPS = 16_384


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and its columns can be pruned."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a table of written() that no result reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files of finished steps stay on disk until the driver's garbage is collected, so it is, here."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, ids: DataFrame, key: str, most: int = MOST_BITMAPS) -> DataFrame:
    """The rows of df whose number (key, a long) is among those of ids (the same column). df isn't shuffled: ids come as bitmaps of 32,768 numbers, by broadcast; of more bitmaps than `most`, df is shuffled after all."""
    bits = ids.select(F.bitmap_bucket_number(key).alias("__bucket"), F.bitmap_bit_position(key).alias("__at")).repartition("__bucket")
    bits = checkpoint(bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")))
    if bits.count() > most:
        return df.join(ids.select(key), key, "left_semi")
    byte = f"cast(conv(hex(substring(__bits, cast(bitmap_bit_position({key}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return df.withColumn("__bucket", F.bitmap_bucket_number(key)).join(F.broadcast(bits), "__bucket").filter(f"shiftright({byte}, cast(bitmap_bit_position({key}) % 8 as int)) % 2 = 1").select(*[f"`{c}`" for c in df.columns])


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def named(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only what an operator reads, under fixed names (more: name=column), so further columns of df can't clash with its own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in more.items()])
