"""Spark helpers of this subpackage: written tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of its own only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="rollcall-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back; the files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rollcall-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column ``doc``, so that no column name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges(a, b)``, both longs: one row (node, component) per node.

    Alternates large and small stars: each node's neighbours move to the smallest of them, so the number of rounds
    grows with the logarithm of the longest path. A round joins on a node with Spark's skew splitting and keeps at most
    one row per edge; rounds end as soon as all links are stars, which takes one count per node to see. Both halves of a round
    are written, so that the driver never plans one inside the other. Loops and repeated edges do no harm; no edges give no rows.
    """
    links = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    while not _are_stars(links):
        links = stored(_small_star(stored(_large_star(links))))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end: the smaller ends are then the components."""
    ends = links.selectExpr("a AS node", "1 AS up", "0 AS down").unionByName(links.selectExpr("b AS node", "0 AS up", "1 AS down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
    return both.where("b > a").join(lowest, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(lowest, "a").where("b <> m").selectExpr("b AS a", "m AS b")
    return moved.unionByName(lowest.selectExpr("a", "m AS b")).where("a <> b").distinct()
