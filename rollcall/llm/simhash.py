"""SimHash near-duplicates through covering locality-sensitive hashing (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import components, packed, partitions, stored, unpacked
from rollcall.llm.words import by_bytes

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Hashes whose bits are counted at once.
COUNTED = 1 << 14
#: Members of one bucket that are compared with one another directly; larger buckets are split by further masks.
BUCKET = 1 << 14


def masks(radius: int = RADIUS, bits: range | list[int] = range(BITS)) -> list[int]:
    """Bit masks such that any ``radius`` bit positions are outside at least one of them.

    Every position gets one of the 2**(radius+1) - 1 nonzero vectors of radius + 1 bits, all about equally often, and
    the mask of a nonzero vector v has the positions whose vector has an odd product with v. Any ``radius`` vectors
    leave some v to which all of them are even, so two fingerprints that differ there agree under v's mask.
    """
    vectors = (1 << (radius + 1)) - 1
    given = {position: i % vectors + 1 for i, position in enumerate(bits)}
    return [sum(1 << p for p, vector in given.items() if (vector & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 hashes of a text's word shingles, lower-cased from A to Z; 0 without words."""
    words = text.encode().lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not words:
        return 0
    if len(words) <= width:
        digests = [xxhash.xxh64_digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1))
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(digests), COUNTED):
        block = np.frombuffer(b"".join(digests[first : first + COUNTED]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if c * 2 > len(digests) else "0" for c in counts), 2)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        prints = np.array([fingerprint(t or "", width) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint of every whole text as a signed long; null text counts as empty."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(partial(_fingerprint_rows, width=width), "doc_id long, print long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(rows: DataFrame, table_masks: list[int], first_table: int = 0) -> DataFrame:
    """Every print once per mask: (table, key, print), tables numbered from ``first_table``."""
    pairs = [F.struct(F.lit(first_table + i).cast("long").alias("table"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(table_masks)]
    return rows.select("print", F.explode(F.array(*pairs)).alias("m")).select("m.table", "m.key", "print")


def _forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For every print the position of the first print of its group, groups linked at ``radius`` or fewer bits."""
    root = np.arange(prints.size)
    for i in range(prints.size - 1):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1
        if near.size and (root[near] != root[i]).any():
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _link_rows(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Reads prints sorted by table and key; writes links between them, and the members of buckets that are too large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("table", pa.int64()), ("over", pa.bool_())])
    held = [np.zeros(0, np.int64)] * 3
    large = None  # the bucket whose members are passed on

    def links(table, key, prints, last: bool):
        """Links of all buckets that are complete; returns them and where the rest begins."""
        edges = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [table.size]))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        out = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            members = prints[a:b].view(np.uint64)
            root = _forest(members, radius)
            moved = np.flatnonzero(root != np.arange(root.size))
            out.append(np.stack((members[moved].view(np.int64), members[root[moved]].view(np.int64))))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        return pairs, (int(ends[-1]) if ends.size else 0)

    def batch_of(a, b, table, over):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(table), pa.array(np.full(a.size, over))], schema=schema)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "print")]
        if large is not None and rows[0].size:
            same = (rows[0] == large[0]) & (rows[1] == large[1])
            yield batch_of(rows[2][same], rows[2][same], rows[0][same], True)
            rows = [r[~same] for r in rows]
            large = large if not rows[0].size else None
        held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not held[0].size:
            continue
        pairs, rest = links(*held, last=False)
        if pairs.size:
            yield batch_of(pairs[0], pairs[1], np.zeros(pairs.shape[1], np.int64), False)
        held = [h[rest:] for h in held]
        if held[0].size > bucket:
            large = (held[0][0], held[1][0])
            yield batch_of(held[2], held[2], held[0], True)
            held = [h[:0] for h in held]
    if held[0].size > 1:
        pairs, _ = links(*held, last=True)
        if pairs.size:
            yield batch_of(pairs[0], pairs[1], np.zeros(pairs.shape[1], np.int64), False)


def print_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join the distinct ``prints(print)`` into the groups that ``radius`` or fewer differing bits make.

    Each print meets the others once per covering mask. Links of a bucket form a forest: a hot bucket gives no more links
    than members. A bucket of over ``bucket`` members is not compared: its members differ in the positions outside its
    mask only, so the same construction over those positions splits it, again and again, until a mask leaves ``radius``
    positions or fewer and the whole bucket is one group. No pair within the radius is ever left out.
    """
    n = partitions(prints.sparkSession)
    level, found = masks(radius), None
    keyed = _keys(prints, level)
    while keyed is not None:
        in_order = keyed.repartition(n, "table", "key").sortWithinPartitions("table", "key", "print")
        out = stored(in_order.mapInArrow(partial(_link_rows, radius=radius, bucket=bucket), "a long, b long, table long, over boolean"))
        links = out.where("NOT over").select("a", "b")
        found = links if found is None else found.unionByName(links)
        keyed, finer = None, []
        for row in out.where("over").select("table").distinct().collect():  # masks, not buckets: no more than there are tables
            members = out.where(F.col("over") & (F.col("table") == row.table)).select(F.col("a").alias("print"))
            outside = [p for p in range(BITS) if not level[row.table] >> p & 1]
            if len(outside) <= radius:  # a bucket is one group: its smallest member stands for it
                same = members.withColumn("key", F.col("print").bitwiseAND(F.lit(_signed(level[row.table]))))
                least = same.groupBy("key").agg(F.min("print").alias("b"))
                found = found.unionByName(same.join(least, "key").select(F.col("print").alias("a"), "b"))
                continue
            part = _keys(members, [level[row.table] | m for m in masks(radius, outside)], len(finer))
            finer += [level[row.table] | m for m in masks(radius, outside)]
            keyed = part if keyed is None else keyed.unionByName(part)
        level = finer
    return found


def groups(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(print, doc_id, component_id) of ``prints(doc_id, print)``, a row per row: the smallest id its links reach.

    Equal prints are one node with its smallest id, so copies are not expanded into pairs. Null ids are never the
    smallest unless a group has no other; an empty table gives no rows.
    """
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    joined = components(print_links(nodes.select("print"), radius, bucket))
    labelled = nodes.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = labelled.join(least, "component").select("print", "component_id")
    return prints.join(of_print, "print").select("print", "doc_id", "component_id")


def hex_print(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Fingerprints of whole texts (null: empty; no words: zero, linked like any other) link at ``radius`` or fewer
    differing bits. Repeated rows and equal texts fall together; other columns are not read; an empty table gives no rows.
    """
    found = groups(stored(fingerprints(docs, width)), radius, bucket)
    return found.select("doc_id", hex_print(F.col("print")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The documents with one of each group, the one with the smallest id, and the columns of ``docs``.

    Of rows that share that id one stays, chosen by a hash of its text; a group without any id keeps one row per fingerprint.
    """
    keyed = packed(docs).withColumn("row", F.xxhash64("doc.doc_id", "doc.text"))
    texts = keyed.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").alias("text"))
    prints = stored(fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), width).withColumnRenamed("doc_id", "row").join(
        texts.select("row", F.col("id").alias("doc_id")).distinct(), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("f")
    of_print = stored(prints.groupBy("print").agg(first))  # one row per print before anything meets on it
    group = groups(of_print.select("f.doc_id", "print"), radius, bucket).select("print", "component_id")
    alone = F.when(F.col("component_id").isNull(), F.col("print"))
    kept = of_print.join(group, "print").groupBy("component_id", alone).agg(F.min("f").alias("f")).select("f.row")
    stay = keyed.join(kept, "row", "left_semi")
    if not prints.groupBy("row").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["row"])
    return unpacked(stay, docs)
