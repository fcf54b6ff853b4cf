"""Bounded blocks of vectors for numpy work inside tasks.

A job's rows are cut into blocks of about ``chunk_rows`` rows by a hash of their id. Spark groups and
shuffles blocks, numpy does the arithmetic of one block, so a hot job is many blocks and never one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import stored
from rollcall.operators.joins import join_facts
from rollcall.session import chunk_rows

BLOCK = ["job_id", "block"]


def cut_blocks(points: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Adds ``block`` so that no (keys, block) group holds much more than ``limit`` rows.

    Only keys of more than ``limit`` rows are listed, one row for at least as many points. The list is written first, so
    Spark knows its size and moves the points, with their vectors, for a large list only.
    """
    size = limit or chunk_rows(points)
    large = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks")).where("_blocks > 1")
    return join_facts(points.dropna(subset=keys), stored(large), keys, spread=["point_id"], how="left").withColumn(
        "block", F.pmod(F.xxhash64("point_id"), F.coalesce("_blocks", F.lit(1)))
    ).drop("_blocks")


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new attribute ids, so both sides of a cogroup may share an origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise squared distances; the expanded form keeps the memory at one number per pair."""
    out = a @ b.T
    out *= -2.0
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(out, 0.0, out=out)
