"""Near-duplicate stage of the pipeline: SimHash groups, and what they miss of edited copies by verified MinHash links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import minhash, simhash
from rollcall.llm.shared import components, packed, stored, unpacked

SHINGLE = 5


def deduplicated(docs: DataFrame, width: int = SHINGLE, radius: int = simhash.RADIUS, least: float = minhash.LIKENESS) -> DataFrame:
    """The documents with one of each group, the one with the smallest id, and the columns of ``docs``.

    Texts link whose SimHash fingerprints of ``width``-word shingles differ in ``radius`` or fewer bits, and texts whose
    shingle sets have a Jaccard similarity of ``least`` or more; a group is what is reachable by both. A radius of three bits holds
    few edited copies at a similarity of 0.8, and a covering of the dozen bits that they differ in is not selective; hence the
    second kind of link. Null text counts as empty, texts without words are one group, ids that are null come last. Of
    rows that share the smallest id one stays, chosen by a hash of its text; rows that agree in id and text are one. An empty
    table gives no rows; other columns are carried along.
    """
    keyed = packed(docs).withColumn("row", F.xxhash64("doc.doc_id", "doc.text"))
    texts = keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    prints = stored(simhash.fingerprints(texts, width).distinct())
    by_print = simhash.groups(prints, radius).select(F.col("doc_id").alias("row"), F.col("component_id").alias("near"))
    by_sets = minhash.near_duplicates(texts, width, least).distinct().select(F.col("doc_id").alias("row"), F.col("component_id").alias("alike"))
    both = stored(by_print.join(by_sets, "row"))
    merged = components(both.where("near <> alike").select(F.col("near").alias("a"), F.col("alike").alias("b")).distinct())
    group = both.join(merged.withColumnRenamed("node", "near"), "near", "left").select("row", F.coalesce("component", "near").alias("group"))
    ids = keyed.select("row", F.col("doc.doc_id").cast("long").alias("id")).distinct()
    least_row = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("f")
    kept = stored(group.join(ids, "row").groupBy("group").agg(least_row).select(F.col("f.row").alias("row")))
    stay = keyed.join(kept, "row", "left_semi")
    if not keyed.groupBy("row").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["row"])
    return unpacked(stay, docs)
