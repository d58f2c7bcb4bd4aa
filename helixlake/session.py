"""Session helpers: the shared folder, and cutting a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs in one JVM (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="helixlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; later stages no longer depend on the lineage above."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as a Parquet table in the shared folder and read back: what comes before is done once, and each reader takes the columns it needs."""
    at = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to be sent to all tasks of a join if it has been counted and has at most ``most`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Nothing is sent where the package's folder is on PYTHONPATH or is the working directory, as
    local executors inherit both; a cluster that has the package installed should set PYTHONPATH.
    """
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or root in {Path(p).resolve() for p in paths if p}:
        return
    target = Path(tempfile.mkdtemp(prefix="helixlake-")) / "helixlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*root.glob("helixlake/**/*.py"), *root.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
