"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sluicewatch") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; choose one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluicewatch-ckpt-"))


#: How many times its file's size a written table counts as: rows of names repeat, so they take 10 to 20 times that in memory.
PACKED = 16.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, **how: str) -> DataFrame:
    """Write once under the checkpoint folder and go on from the written table; ``how`` goes to the writer.

    A lost executor re-reads the files instead of replaying a loop. The planner is told how far the
    files are packed (unless the session says so itself), so it broadcasts one side of a join, which
    passes the driver, only when that side is small in memory too. Shuffle files of the write go when
    it ends: nothing reads them again, and they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if float(spark.conf.get(_FACTOR, "1.0")) == 1.0:
        spark.conf.set(_FACTOR, str(PACKED))
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.options(**how).parquet(path)
    finally:
        spark.conf.set(_CLEANED, kept)
    return spark.read.schema(df.schema).parquet(path)
