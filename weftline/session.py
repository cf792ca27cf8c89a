"""The session's shared folder, for cutting lineage so that a lost executor costs only its running tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local session. A cluster must set it."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    path = shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return df.checkpoint()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """The package, as a zip, to the Python workers of this application, so that they needn't have it installed or on their path."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
