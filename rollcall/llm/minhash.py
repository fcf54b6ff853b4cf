"""Document fingerprints by MinHash (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import components, partitions, stored
from rollcall.llm.words import by_bytes, hash_shingles, hash_words

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
LIKENESS = 0.8
#: How far under the wanted similarity a signature's estimate may lie before a pair is dropped: some seven deviations.
DOUBT = 0.25
#: Pairs of one band bucket, classes outside its head's component times members, up to which all are compared.
HOT = 256
#: Shingles that one matrix of permuted hashes covers.
BLOCK = 512
#: Bits of a parity sketch, a power of two.
SKETCH = 1024

_RNG = np.random.default_rng(20_000)
_FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct word shingles; fewer words count as one shingle, none give nothing."""
    return np.unique(hash_shingles(hash_words(text.encode().split()), width))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest value of each universal hash a*x + b over the shingles; all ones without shingles."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    for first in range(0, hashes.size, BLOCK):
        permuted = hashes[None, first : first + BLOCK] * _FACTORS
        permuted += _SHIFTS
        np.minimum(least, permuted.min(axis=1), out=least)
    return (least >> np.uint64(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of permutations with the same minimum: an estimate of the Jaccard similarity of the shingle sets."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes with equal lowest bits, in 64-bit words.

    The sketches of two sets differ in the parities of what only one of them holds: in no more bits than there are such hashes.
    """
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# --- neighbours by id -------------------------------------------------------------------------------------------------


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt into id ranges and sorted, each range followed by a guest: the row that comes after its last one.

    Columns (_range, _guest, _key, doc_id, text). Ranges start at quantiles of the ids, so they have about equal rows; the
    only list on the driver are those starts, one per shuffle partition. Null ids come first. Equal ids lie in one
    range, by text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 2 * partitions(docs.sparkSession)
    cuts = keyed.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()
    starts = sorted({cuts.least, *cuts.cuts}) if cuts.least is not None else [0]
    at = F.array(*[F.lit(s) for s in starts])
    own = F.size(F.filter(at, lambda s: s <= F.col("_key")))
    before = F.when(own > 1, own - 1).otherwise(F.lit(len(starts)))
    wrapped = F.when(own > 1, 1).otherwise(2)
    places = F.when(F.array_contains(at, F.col("_key")), F.array(F.struct(own.alias("r"), F.lit(0).alias("g")), F.struct(before.alias("r"), wrapped.alias("g")))).otherwise(
        F.array(F.struct(own.alias("r"), F.lit(0).alias("g"))))
    dealt = keyed.withColumn("p", F.explode(places)).select(F.col("p.r").alias("_range"), F.col("p.g").alias("_guest"), "_key", "doc_id", "text")
    return dealt.repartition(partitions(docs.sparkSession), "_range").sortWithinPartitions("_range", "_guest", "_key", "text")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    last = None  # range, id, text and signature of the row that waits for its next one

    def finish(text: str, own: np.ndarray) -> tuple:
        _, doc, before, mark = last
        changed = edited(before, text)
        other = signature(shingles(changed, width))
        bands = int((bands_of(mark) == bands_of(other)).sum())
        return (doc, len(before), hashlib.sha256(changed.encode()).hexdigest(), written(mark), written(other), likeness(mark, other), likeness(mark, own), bands)

    for batch in by_bytes(batches, "text"):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "text"))
        for part, guest, doc, text in zip(*columns, strict=True):
            if last is not None and last[0] == part:
                own = signature(shingles(text, width))
                out.append(finish(text, own))
                last = None if guest else (part, doc, text, own)
            elif not guest:
                last = (part, doc, text, signature(shingles(text, width)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)


def written(mark: np.ndarray) -> str:
    """A signature as lower-case hexadecimal digits, four per permutation."""
    return mark.astype(">u2").tobytes().hex()


def edit_report(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, a row per row of ``docs``.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited). Null text
    counts as empty. The next document is the next by id, after the last the first; rows with equal ids follow one
    another by text; null ids come first. A sole document is its own next. An empty table gives no rows.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, bands_edited int"
    )
    return with_next(docs).mapInArrow(partial(_fingerprint_rows, width=width), schema)


# --- near duplicates --------------------------------------------------------------------------------------------------


def bands_of(mark: np.ndarray) -> np.ndarray:
    """One 64-bit number per band of the signature."""
    return np.ascontiguousarray(mark).view(np.uint64)


def _band_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
        keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        bands = pa.array([bands_of(signature(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), keys, bands], ["doc_id", "mark", "key", "bands"])


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
        keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        columns = [keys, *(pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), sketch))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "shingles", "sketch"])


def _likely_rows(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(batch.num_rows, -1) for c in ("x", "y"))
        near = (x == y).mean(axis=1) >= least
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])


def near_duplicates(docs: DataFrame, width: int = SHINGLE, least: float = LIKENESS) -> DataFrame:
    """(doc_id, component_id): documents whose shingle sets have a Jaccard similarity of ``least`` or more link.

    Texts with equal shingles are one class. The classes' signature bands meet in Spark; in a band every class is
    compared with its bucket's head first, a class that meets most others over all bands, so a group of copies gives a star
    and not all its pairs. Then the classes that are still outside
    the component of a head meet the members of the bucket in other components than their own: all of them where these are ``HOT`` pairs
    or fewer, else those that the head does not rule out (``_past_heads``), none of which can be lost.
    Pairs whose signatures put them ``DOUBT`` or more under ``least`` go,
    Jaccard is computed on the whole shingle sets of the others: a second pass over the texts makes the sets of classes that
    share a band, and of no others. Two sets at 0.8 share a band of four permutations with a probability over 0.9999999, and the
    signatures keep them with one over 0.99999999. Texts without words are one class. Null text counts as
    empty; null ids count only where a group has no other; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(partial(_band_rows, width=width), "doc_id long, mark long, key binary, bands array<long>"))
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("place")
    classes = rows.groupBy("key").agg(place, F.first("bands").alias("bands")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes.select("class", "key", F.col("place.doc_id").alias("first"), F.col("place.mark").alias("mark"), "bands"))
    shared = _shared(classes)
    sets = _sets(texts, classes.join(shared.select("class").distinct(), "class", "left_semi"), width)
    linked = stored(_alike(_pairs(shared.where("class <> head"), "class", "head"), classes, sets, least))
    members = _members(shared.where("n > 2"), components(linked))
    pairs = _within(members.where("NOT hot"))
    if not members.where("hot").isEmpty():
        pairs = pairs.unionByName(_past_heads(members.where("hot"), sets, least)).distinct()
    joined = components(linked.unionByName(_alike(stored(pairs), classes, sets, least)))
    named = classes.select("key", "class", "first").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key").join(named.join(ids, "component").select("key", "component_id"), "key").select("doc_id", "component_id")


def _shared(classes: DataFrame) -> DataFrame:
    """(band, key, class, n, head) of the buckets of two classes or more, n members each.

    A bucket turns to its member that meets most others over all bands, and its head is the class that most buckets of this
    member turn to: an edited copy stands back for its original even where the edit has parted the two.
    """
    banded = stored(classes.select("class", F.posexplode("bands").alias("band", "key")))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(banded.join(sizes, ["band", "key"]))
    back = (-F.col("class")).alias("back")
    turned = met.join(met.groupBy("class").agg(F.sum("n").alias("others")), "class").groupBy("band", "key").agg(F.max(F.struct("others", back)).alias("to"))
    votes = met.join(turned, ["band", "key"]).groupBy("class", "to").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("class").agg(F.max(F.struct("votes", "to")).alias("most")).select((-F.col("class")).alias("back"), (-F.col("most.to.back")).alias("head"))
    heads = turned.select("band", "key", F.col("to.back").alias("back")).join(chosen, "back").drop("back")
    return stored(met.join(heads, ["band", "key"]))


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b), a over b, of two columns of classes."""
    return rows.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, shingles, sketch) of the wanted classes, from one text of each."""
    known = F.coalesce("doc_id", F.lit(0)).alias("known")
    places = wanted.select(F.coalesce("first", F.lit(0)).alias("known"), "mark").distinct()
    found = texts.select(known, "mark", "text").join(places, ["known", "mark"], "left_semi").distinct()
    made = found.select("text").mapInArrow(partial(_shingle_rows, width=width), "key binary, shingles array<long>, sketch array<long>")
    return stored(made.join(wanted.select("key", "class"), "key").groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")))


def _members(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """Members (band, key, class, head, component, outside, hot) of the buckets that hold classes outside their head's component."""
    of_class = joined.select(F.col("node").alias("class"), "component")
    of_head = joined.select(F.col("node").alias("head"), F.col("component").alias("main"))
    placed = shared.join(of_class, "class", "left").join(of_head, "head", "left").withColumn("component", F.coalesce("component", "class"))
    placed = placed.withColumn("outside", F.col("component") != F.coalesce("main", "head"))
    left = placed.where("outside").groupBy("band", "key").agg((F.count("*") * (F.first("n") - 1) > HOT).alias("hot"))
    return stored(placed.join(left, ["band", "key"]).select("band", "key", "class", "head", "component", "outside", "hot"))


def _within(members: DataFrame) -> DataFrame:
    """Pairs of the classes outside with all members of their buckets in other components, the head apart."""
    x = members.where("outside").select("band", "key", F.col("class").alias("x"), F.col("component").alias("cx"))
    y = members.where("class <> head").select("band", "key", F.col("class").alias("y"), F.col("component").alias("cy"), "outside")
    return _pairs(x.join(y, ["band", "key"]).where("cx <> cy AND (NOT outside OR x > y)"), "x", "y")


def _past_heads(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of the classes outside with members under the same head in other components that can be alike.

    The family's core is the head and every shingle that over half of the classes under it hold, whether the head does or not; a set's
    other shingles are its own. Alike sets share ``least`` / (1 + ``least``) of both sizes. What a set shares with the core is known, so is
    how many own shingles it has to share with the smallest set under the head, m. Is it one at least, alike sets share one of the
    first own - m + 1 of both sets' own, the rarest first: their first common one has the others behind it. Or all that they
    share is the core's, then each shares enough with the core for both sizes. In either case their sketches
    differ in no more bits than alike sets in shingles.
    """
    under = members.where("class <> head").groupBy("class", "head").agg(F.first("component").alias("component"), F.first("outside").alias("outside"))
    of_head = sets.select(F.col("class").alias("head"), F.col("shingles").alias("of_head"))
    parted = stored(under.join(sets, "class").join(of_head, "head").select(
        "class", "head", "component", "outside", "sketch", F.size("shingles").alias("size"), F.array_except("shingles", "of_head").alias("own")))
    families = parted.groupBy("head").agg(F.count("*").alias("classes"), F.min("size").alias("least_size"))
    held = parted.select("class", "head", F.explode("own").alias("shingle"))
    several = held.groupBy("head", "shingle").agg(F.count("*").alias("n")).where("n > 1").join(families.select("head", "classes"), "head")
    core = F.col("n") * 2 > F.col("classes")
    met = held.join(several, ["head", "shingle"]).groupBy("class", "head").agg(
        F.count_if(core).alias("in_core"), F.sort_array(F.collect_list(F.when(~core, F.struct("n", "shingle")))).alias("ranked"))
    told = parted.withColumn("own", F.size("own")).join(met, ["class", "head"], "left").join(families.select("head", "least_size"), "head")
    told = stored(told.withColumn("shared", F.col("size") - F.col("own") + F.coalesce("in_core", F.lit(0))))
    part = least / (1 + least)
    lacking = part * (F.col("size") + F.greatest("least_size", F.lit(least) * F.col("size"))) - F.col("shared")
    first = F.size("ranked") + 1 - F.greatest(F.lit(1), F.ceil(lacking - 1e-6).cast("int"))  # those that no other class has come before them
    rare = stored(told.where(F.size("ranked") > 0).withColumn("rare", F.explode(F.slice("ranked", 1, F.greatest(first, F.lit(0))))).select(
        "head", F.col("rare.shingle").alias("shingle"), "class", "component", "outside", "size", "sketch"))
    differing = sum((F.bit_count(F.col("kx")[i].bitwiseXOR(F.col("ky")[i])) for i in range(SKETCH // 64)), F.lit(0))
    near = (F.expr("cx <> cy AND (NOT outside OR x > y)")
            & (F.least("sx", "sy") >= F.lit(least) * F.greatest("sx", "sy") - 1e-6)
            & (differing <= (1 - 2 * part) * (F.col("sx") + F.col("sy")) + 1e-6))
    x = [F.col(c).alias(n) for c, n in (("class", "x"), ("component", "cx"), ("size", "sx"), ("sketch", "kx"))]
    y = [F.col(c).alias(n) for c, n in (("class", "y"), ("component", "cy"), ("size", "sy"), ("sketch", "ky"), ("outside", "outside"))]
    found = _pairs(rare.where("outside").select("head", "shingle", *x).join(rare.select("head", "shingle", *y), ["head", "shingle"]).where(near), "x", "y")

    close = told.where("outside").where(lacking <= 1e-6).select("head", F.col("shared").alias("shared_x"), *x)
    enough = F.least("shared_x", "shared") >= part * (F.col("sx") + F.col("sy")) - 1e-6
    return found.unionByName(_pairs(close.join(told.select("head", "shared", *y), "head").where(enough & near), "x", "y"))


def _alike(pairs: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike enough: first by their signatures, then by the sets."""
    x = classes.select(F.col("class").alias("a"), F.col("bands").alias("x"))
    y = classes.select(F.col("class").alias("b"), F.col("bands").alias("y"))
    likely = pairs.join(x, "a").join(y, "b").mapInArrow(partial(_likely_rows, least=least - DOUBT), "a long, b long")
    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = likely.join(of_a, "a").join(of_b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - shared
    return both.where((every > 0) & (shared >= F.lit(least) * every)).select("a", "b")
