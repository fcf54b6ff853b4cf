"""Mixing sources to target weights (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.shared import WORD, packed, stored, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
#: Rows one sorted slice of a source holds on average.
SLICE_ROWS = 2_000


def words_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Targets of ``sources(source, source_size)``, one row per source, as (source, source_size, target).

    Sources in code point order, null last, get the weights in turn and share ``share`` times all sizes. A target stops
    at ``epochs`` times its source's size and the excess is shared by weight among the rest until none is above. In
    order of cap per weight that is one running sum: the first sources whose cap lies below the level are full.
    The windows see one row per source, never documents. A source without words has target 0; no sources, no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = caps.select(
        "source", "source_size", "_w", "_cap", F.row_number().over(by_cap).alias("_n"),
        (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))).alias("_open"),
    )
    full = F.col("_cap") * F.col("_open") <= F.col("_left") * F.col("_w")
    level = F.min(F.when(~full, F.struct("_n", "_left", "_open"))).over(all_rows)
    return levels.withColumn("_level", level).select(
        "source", "source_size",
        F.when(full, F.col("_cap")).otherwise(F.col("_w") * F.col("_level._left") / F.col("_level._open")).alias("target"),
    )


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken).

    Every document gets a key from the MD5 of seed and id. Within a source, documents lie in key order; slices of the
    key range are summed first, a running sum over the slices (one row per source and slice) gives each slice its
    start, and a running sum inside the slice gives each document its own. With target = e whole passes + rest, a
    document is taken e times, and once more as far as the first ``rest`` words of the order reach; the one document at
    the cut is taken in part, so a source's taken words are its target rounded down to whole words.
    A hot source only has more slices. Reruns agree; rows with the same id lie next to each other by size.
    Null text counts 0 words, null source is a source, null id has a key of its own; an empty table gives no rows.
    Only doc_id, text and source are read.
    """
    sizes = stored(docs.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"),
    ))
    digits = 0
    rows = sizes.count()
    while rows > SLICE_ROWS * 16**digits:
        digits += 1
    sliced = sizes.withColumn("_slice", F.substring("_key", 1, digits))
    totals = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_slice_size"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_slice_size").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_slice_size").over(before), F.lit(0))).drop("_slice_size")
    plan = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "_slice", "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d._slice = p._slice"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    reach = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_within")))
    return joined.select(
        "doc_id", "d.source", "size", "source_size", "target", (whole * F.col("size") + reach).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix is made of, with the columns of ``docs``: one row for each whole pass and one for the part.

    A part is the text up to its last taken word. Documents of which nothing is taken go. Documents without any word
    take nothing and go. Rows that share an id are told apart by their text; identical rows share one decision each.
    """
    keyed = packed(docs).withColumn("id", F.xxhash64("doc.doc_id", "doc.text", "doc.source"))
    own = keyed.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    taken = mix(own, **options).where("taken > 0").groupBy("doc_id").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    copies = keyed.join(taken.withColumnRenamed("doc_id", "id"), "id").withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(F.col("doc.text"))
    changed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(words < F.col("size"), F.length("cut").cast("long")).otherwise(F.col("doc.n_chars"))
    return unpacked(copies.withColumn("cut", cut), docs, **changed)
