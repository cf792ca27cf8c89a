"""Beyond the batch product: pair counts over a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import analysed


def pair_counts(statements: DataFrame, dialect: str = "common") -> DataFrame:
    """(src_key, tgt_key, evidence_type, observations) of a stream or table of statements (sql, source_type, ...), for update or complete mode: state is one counter for each pair."""
    pairs = analysed(statements, dialect).select(F.explode("pairs").alias("p")).select("p.*")
    return pairs.groupBy("src_key", "tgt_key", "evidence_type").agg(F.count("*").alias("observations"))


def windowed_counts(statements: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", dialect: str = "common") -> DataFrame:
    """The same by event-time window; statements later than `late` are dropped by the watermark."""
    rows = analysed(statements.withWatermark(time_col, late), dialect, keep=(time_col,)).select(F.col(time_col), F.explode("pairs").alias("p"))
    return rows.groupBy(F.window(time_col, window), "p.src_key", "p.tgt_key").agg(F.count("*").alias("observations"))
