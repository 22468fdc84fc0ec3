"""Session defaults and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gaugeworks", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator expects (UTC clock, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Read event times, which are stored without a zone, as UTC, and give the executors this package
    for the functions that run in Python workers."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="gaugeworks-code-")  # on the driver; Spark hands it out
        spark.sparkContext.addPyFile(
            shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        )
        _shipped.add(app)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for staged tables, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="gaugeworks-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    Used where several passes read the same derived rows: the derivation runs once, later passes
    prune columns, and a lost executor only re-reads files.
    """
    spark = prepare(df.sparkSession)
    path = f"{checkpoint_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
