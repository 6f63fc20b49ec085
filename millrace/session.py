"""Session defaults, table loading and checkpoint placement."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started.

    On one machine its folder goes on the workers' path; a cluster gets the package as a zip.
    """
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return spark
    root = Path(__file__).resolve().parents[1]
    if sc.master.startswith("local"):
        known = [p for p in (sc.environment.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(root), *known])
    else:
        packed = Path(tempfile.mkdtemp(prefix="millrace-package-")) / "millrace.zip"  # served by the driver
        with zipfile.ZipFile(packed, "w") as z:
            for file in sorted((root / "millrace").rglob("*.py")):
                z.write(file, file.relative_to(root))
        sc.addPyFile(str(packed))
    sc._millrace_shipped = True
    return spark


def load(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """One table of a data directory, pruned to `columns` when given."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def as_instant(df: DataFrame, *names: str) -> DataFrame:
    """NTZ columns as UTC timestamps: watermarks and epoch arithmetic reject NTZ."""
    for name in names:
        if isinstance(df.schema[name].dataType, T.TimestampNTZType):
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for `DataFrame.checkpoint`.

    Checkpoints are deleted once nothing refers to them, unless the session says otherwise.
    The session's own setting (`spark.checkpoint.dir`) wins. A temporary folder is
    made only in single-process local mode, where every task shares the machine.
    """
    sc = spark.sparkContext
    settings, cleaned = sc._jsc.sc().conf(), "spark.cleaner.referenceTracking.cleanCheckpoints"
    if not settings.contains(cleaned):
        settings.set(cleaned, "true")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    sc.setCheckpointDir(named)
    return named
