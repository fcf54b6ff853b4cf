"""Parquet storage of the engine's tables, laid out by a hash of the job.

One directory per job would mean millions of tiny directories, so jobs share a fixed number of
``job_bucket`` directories: a filter on some jobs reads only their buckets. Rows are dealt to writers in ranges of about
equal size, so a hot job is written by as many tasks as its share of the rows asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def job_bucket(job):
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def store(table: DataFrame, path: str, spread: list[str], mode: str = "overwrite") -> None:
    """Writes a table; ``spread`` names columns that vary inside one job."""
    marked = table.withColumn("job_bucket", job_bucket(F.col("job_id"))).withColumn("_slice", F.xxhash64(*spread))
    marked.repartitionByRange("job_bucket", "job_id", "_slice").drop("_slice").write.mode(mode).partitionBy("job_bucket").parquet(path)


def load(spark: SparkSession, path: str, jobs: list[str] | None = None) -> DataFrame:
    """Reads a table; for given jobs only their bucket directories and matching row groups are read."""
    table = spark.read.parquet(path)
    if jobs is None:
        return table.drop("job_bucket")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, jobs))).alias("job_id")).select(job_bucket(F.col("job_id")).alias("b"))
    buckets = sorted({row["b"] for row in wanted.collect()})
    return table.filter(F.col("job_bucket").isin(buckets) & F.col("job_id").isin(jobs)).drop("job_bucket")
