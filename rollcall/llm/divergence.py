"""How far the sources of a language lie apart in their terms, with equal texts tokenized once (operator 13)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.shared import partitions, stored
from rollcall.llm.words import by_bytes

#: Documents of a language that must hold a term, and the ranks that the term report goes to.
LEAST_DOCS, TOP = 10, 10
#: Scale of the shares, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
#: Sources of one text that travel in one row.
TOGETHER = 4096
#: Terms of sources that a task sums up before it hands them on.
HELD = 300_000
#: Sources of one block, and (source, term) entries of one bucket of terms, in the comparison of pairs.
BLOCK, BUCKET = 256, 1 << 18
#: Entry pairs looked at in one numpy step.
STEP = 1 << 20

# Upper-case ASCII letters become lower case, whatever is no term character becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_LETTERS).split()


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each different text of a language once, with its copies per source: (lang, text binary, sources array<(source, n)>).

    Texts are told apart by their SHA-256. Copies are summed before they are shuffled, the text itself moves once; a
    text of very many sources comes in several rows of about ``TOGETHER`` sources.
    """
    rows = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "CAST(coalesce(text, '') AS BINARY) AS text")
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    slices = max(1, -(-rows.select("source").distinct().count() // TOGETHER))
    lists = copies.groupBy("lang", "digest", F.pmod(F.xxhash64("source"), F.lit(slices)).alias("slice")).agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(lists, ["lang", "digest"]).select("lang", "text", "sources")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (lang, source, term, docs, n) of a task's texts; a text is tokenized once for all its sources.

    Texts come by language and first source, so that the sums of one group are handed on before the next one starts.
    """
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    holders: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in counts.items():
            documents = holders[lang, source]
            terms = pa.array(list(held), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(held), pa.string()), pa.array([source] * len(held), pa.string()), terms,
                    pa.array([documents[t] for t in held], pa.int64()), pa.array(list(held.values()), pa.int64()),
                ],
                ["lang", "source", "term", "docs", "n"],
            )
        counts.clear()
        holders.clear()

    group = None
    for batch in by_bytes(batches, "text"):
        for lang, text, sources in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources")), strict=True):
            if group != (group := (lang, len(sources) > 1, sources[0]["source"])) and not group[1]:
                yield from flush()
            terms = terms_of(text)
            if not terms:
                continue
            different = set(terms)
            tally = None
            for entry in sources:
                key, n = (lang, entry["source"]), entry["n"]
                if n == 1:
                    counts[key].update(terms)
                    holders[key].update(different)
                    continue
                tally = tally or Counter(terms)
                held, documents = counts[key], holders[key]
                for term, k in tally.items():
                    held[term] += k * n
                    documents[term] += n
            if len(sources) > 1 and sum(map(len, counts.values())) > HELD or len(sources) == 1 and len(counts[lang, sources[0]["source"]]) > HELD:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences ``n`` of each term in each group, and the group's documents ``docs`` that hold it: (lang, source, term, docs, n).

    Rows of one term and language lie in one partition: they are as many as tasks and sources, whatever its occurrences.
    """
    rows = distinct_texts(docs).sortWithinPartitions("lang", F.size("sources") > 1, F.col("sources")[0]["source"])
    rows = rows.mapInArrow(_count_rows, "lang string, source string, term string, docs long, n long")
    return rows.repartition(partitions(docs.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """Terms that enough documents of their language hold: (lang, source, term, n, n_lang, first), ``first`` once per lang and term."""
    of_term = Window.partitionBy("lang", "term")
    rows = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("_docs"), F.sum("n").over(of_term).alias("n_lang"),
        (F.min("source").over(of_term) == F.col("source")).alias("first"),
    )
    return rows.where(F.col("_docs") >= LEAST_DOCS).drop("_docs")


def share(n: str, total: str, kept: str) -> str:
    """The share of a term in billionths, exact; 0 where nothing is kept."""
    return (
        f"CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {ADDED} AS DECIMAL(20,0))) "
        f"div CAST({total} + {ADDED} * {kept} AS DECIMAL(20,0)) ELSE 0 END"
    )


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared difference over sum, rounded down; shares are at most 1e9 + 1, so that squares fit 64 bits."""
    d = p - q
    return d * d // np.maximum(p + q, 1)


def _compare(table: pa.Table) -> pa.Table:
    """Sums of gaps over one bucket of terms, for the pairs of sources of two blocks.

    Rows without a term state the sources: number, share ``p0`` of an absent term, kept terms. Over all kept terms the
    sum is what each side's terms give against an absent term, corrected where both sides hold the term, plus the gap
    of two absent ones for all others; that last part depends on counts alone and is added in bucket 0.
    """
    lang, bucket = table.column("lang")[0].as_py(), table.column("bucket")[0].as_py()
    stated = table.filter(pa.compute.is_null(table.column("term")))
    order = np.argsort(stated.column("idx").to_numpy())
    ids, p0, held = (stated.column(c).to_numpy()[order].astype(np.int64) for c in ("idx", "p0", "n_terms"))
    names = [stated.column("source")[int(k)].as_py() for k in order]
    kept = stated.column("kept")[0].as_py()
    blocks = ids // BLOCK

    rows = table.filter(pa.compute.is_valid(table.column("term")))
    code = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    at = np.searchsorted(ids, rows.column("idx").to_numpy())
    order = np.lexsort((at, code))
    code, at, p = code[order], at[order], rows.column("p").to_numpy()[order].astype(np.int64)
    ends = np.searchsorted(code, code, side="right")  # where an entry's term ends

    sums = np.zeros((ids.size, ids.size), np.int64)
    both = np.zeros((ids.size, ids.size), np.int64)
    for i in range(ids.size):
        own = np.flatnonzero(at == i)
        values, times = np.unique(p[own], return_counts=True)
        for first in range(0, values.size, max(1, STEP // ids.size)):
            part = slice(first, first + max(1, STEP // ids.size))
            sums[i] += (gap(values[part, None], p0[None, :]) * times[part, None]).sum(axis=0)
        others = ends[own] - own - 1  # later sources that hold the same term
        reach = np.cumsum(others)
        first = 0
        while first < own.size:
            last = max(first + 1, int(np.searchsorted(reach, (reach[first - 1] if first else 0) + STEP, side="right")))
            n = others[first:last]
            mine = np.repeat(own[first:last], n)
            theirs = mine + 1 + np.arange(mine.size) - np.repeat(np.cumsum(n) - n, n)
            j = at[theirs]
            change = gap(p[mine], p[theirs]) - gap(p[mine], p0[j]) - gap(p0[i], p[theirs]) + gap(p0[i], p0[j])
            np.add.at(both[i], j, change)
            first = last
    a, b = np.triu_indices(ids.size, 1)
    if blocks.size and blocks[0] != blocks[-1]:
        a, b = a[blocks[a] != blocks[b]], b[blocks[a] != blocks[b]]
    value = sums[a, b] + sums[b, a] + both[a, b]
    if bucket == 0:
        value += (kept - held[a] - held[b]) * gap(p0[a], p0[b])
    return pa.table(
        {
            "lang": pa.array([lang] * a.size, pa.string()),
            "one": pa.array([names[k] for k in a], pa.string()),
            "other": pa.array([names[k] for k in b], pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Value of every pair of sources of a language, both ways: (lang, source, item, value).

    Entries meet in tiles of two source blocks and one bucket of terms; a tile gives one row per pair of its sources,
    however many terms they share.
    """
    tiles = f"explode(transform(sequence(0, cast(floor((sources - 1) / {BLOCK}) AS INT)), x -> struct(least(x, block) AS lo, greatest(x, block) AS hi))) AS tile"
    numbered = groups.withColumn("block", F.expr(f"cast(floor(idx / {BLOCK}) AS INT)"))
    stated = numbered.withColumn("bucket", F.explode(F.expr("sequence(0L, buckets - 1)"))).selectExpr("*", tiles)
    dealt = entries.join(numbered.select("lang", "source", "idx", "sources", "block", "buckets"), ["lang", "source"])
    dealt = dealt.selectExpr("*", "pmod(xxhash64(term), buckets) AS bucket", tiles)
    columns = ["lang", "bucket", "tile.lo", "tile.hi", "idx"]
    rows = stated.selectExpr(*columns, "source", "CAST(NULL AS STRING) AS term", "CAST(NULL AS BIGINT) AS p", "p0", "n_terms", "kept").unionByName(
        dealt.selectExpr(*columns, "CAST(NULL AS STRING) AS source", "term", "p", "CAST(NULL AS BIGINT) AS p0", "CAST(NULL AS BIGINT) AS n_terms", "CAST(NULL AS BIGINT) AS kept")
    )
    found = rows.groupBy("lang", "bucket", "lo", "hi").applyInArrow(_compare, "lang string, one string, other string, value long")
    found = found.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    return found.select("lang", "value", F.explode(F.expr("array(struct(one AS source, other AS item), struct(other AS source, one AS item))")).alias("way")).select(
        "lang", "way.source", "way.item", "value"
    )


def audit(docs: DataFrame) -> DataFrame:
    """Distance of each source from the others of its language, and the terms that set it apart.

    Returns (lang, source, part, item, value, rank). Part ``pair`` has every other source of the language, value the
    sum over all kept terms of floor((p - q)^2 / (p + q)); part ``term`` the ``TOP`` kept terms that the source uses
    more than its language, with the same figure of that term. Larger values come first, then items in UTF-8 order.
    Kept are terms that at least ``LEAST_DOCS`` documents of the language hold, repeated rows counted each. p and q are
    in billionths and exact.
    Nulls in lang, source and text read as ''. Groups whose documents hold no term still count as sources; a language
    without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs; an empty table
    gives no rows; other columns are not read.
    """
    docs = docs.select("lang", "source", "text")
    kept = stored(kept_terms(term_counts(docs)))
    per_lang = kept.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("n_entries"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    by_lang = Window.partitionBy("lang")
    groups = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source").distinct()
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    groups = groups.selectExpr("*", f"{share('0', 'total', 'kept')} AS p0", f"greatest(1L, cast(ceil(n_entries / {BUCKET}) AS BIGINT)) AS buckets")
    groups = groups.withColumn("idx", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("sources", F.count("*").over(by_lang))
    groups = stored(groups)  # a row per source of a language

    entries = kept.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    entries = entries.selectExpr("lang", "source", "term", f"{share('n', 'total', 'kept')} AS p", f"{share('n_lang', 'lang_total', 'kept')} AS q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.where("p > q").selectExpr("lang", "source", "term AS item", "((p - q) * (p - q)) div (p + q) AS value")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    pairs = _pairs(entries, groups).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
