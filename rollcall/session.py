"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SALTS_CONF = "spark.rollcall.salts"
CHUNK_CONF = "spark.rollcall.chunkRows"


def build_session(app: str = "rollcall", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session for local runs; on a cluster spark-submit supplies master, memory and partition counts."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def salt_count(df: DataFrame) -> int:
    """How many slices a hot key is cut into by the salted joins."""
    return int(df.sparkSession.conf.get(SALTS_CONF, "8"))


def chunk_rows(df: DataFrame) -> int:
    """Upper bound on the rows of one window partition or one Arrow block."""
    return int(df.sparkSession.conf.get(CHUNK_CONF, "16384"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one already set; a scratch folder only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="rollcall-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
