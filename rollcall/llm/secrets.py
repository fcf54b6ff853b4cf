"""Secret scans through a trigram inverted index (operator 5), with built-in Spark functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import packed, unpacked

#: Documents whose postings lie in one row of the index, on average.
SEGMENT_ROWS = 2048
#: Largest number of spellings a piece of a regex is written out to.
SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """A regex (the same in Java, RE2 and Python) and the shortest length of one of its groups in a match that counts."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0


# The base kinds, in the order of equal starts.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run of these characters ends only where no more follow, so its least length may stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """What a text must hold to match: some set of lower-case trigrams, all of it. None: no trigram is mandatory.

    Literals, small classes, optional parts, groups and branches are written out to their spellings; anything else ends
    a spelling. The query is a disjunction of conjunctions in which no conjunction contains another.
    """
    _, query = _sequence(re._parser.parse(pattern))
    return query


def _all_of(*queries):
    """Conjunction of queries; where the product grows too large, the first alone is a weaker query that still holds."""
    out = None
    for query in queries:
        if query is None:
            continue
        if out is None:
            out = query
        elif len(out) * len(query) <= SPELLINGS:
            out = _least(a | b for a, b in product(out, query))
    return out


def _least(sets) -> frozenset[frozenset[str]]:
    sets = set(sets)
    return frozenset(s for s in sets if not any(other < s for other in sets))


def _of_spellings(spellings: set[str]):
    if any(len(s) < 3 for s in spellings):
        return None
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spellings)


def _sequence(items) -> tuple[set[str] | None, frozenset | None]:
    """Spellings of a sequence if they are few, and its query."""
    run, exact, query = {""}, True, None
    for op, value in items:
        name = str(op)
        spellings, inner = _item(name, value)
        if spellings is not None and len(run) * len(spellings) <= SPELLINGS:
            run = {a + b for a, b in product(run, spellings)}
            if name not in ("MAX_REPEAT", "MIN_REPEAT") or value[0] == value[1] or value[:2] == (0, 1):
                continue
        exact = False
        query, run = _all_of(query, _of_spellings(run), inner), {""}
    query = _all_of(query, _of_spellings(run))
    return (run if exact else None), query


def _item(name: str, value) -> tuple[set[str] | None, frozenset | None]:
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, None
    if name == "IN":
        chars = set()
        for kind, member in value:
            if str(kind) == "LITERAL":
                chars.add(chr(member).lower())
            elif str(kind) == "RANGE" and member[1] - member[0] < 8:
                chars |= {chr(c).lower() for c in range(member[0], member[1] + 1)}
            else:
                return None, None
        return (chars if len(chars) <= 8 else None), None
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        spellings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        queries = [q for _, q in parts]
        return spellings, (_least(c for q in queries for c in q) if all(q is not None for q in queries) else None)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        spellings, query = _sequence(inner)
        if spellings is None:
            return None, query if least else None
        if (least, most) == (0, 1):
            return spellings | {""}, None
        if 1 <= least <= 4 and len(spellings) ** least <= SPELLINGS:
            return {"".join(p) for p in product(spellings, repeat=least)}, None
    return None, None


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row per segment of documents, a column ``t0, t1, ...`` per trigram with the rows that hold it.

    ``docs`` has (row, text). Trigrams are looked up in the lower-cased text; a segment is a hash range of ``row``, so
    no posting list outgrows a segment however common its trigram is.
    """
    segments = max(1, -(-docs.count() // SEGMENT_ROWS))
    lowered = docs.select("row", F.lower("text").alias("_low"))
    held = lowered.select("row", *[F.contains("_low", F.lit(t)).alias(f"t{i}") for i, t in enumerate(trigrams)])
    return held.groupBy(F.pmod("row", F.lit(segments)).alias("_segment")).agg(
        *[F.collect_list(F.when(F.col(f"t{i}"), F.col("row"))).alias(f"t{i}") for i in range(len(trigrams))]
    )


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows that may match indexed rules, as (row, rules array<string>): postings intersected and united per rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    index = postings(docs, trigrams)

    def rows_of(query) -> Column:
        found = None
        for conjunction in sorted(sorted(c) for c in query):
            both = F.array_distinct(F.col(f"t{trigrams.index(conjunction[0])}"))
            for trigram in conjunction[1:]:
                both = F.array_intersect(both, F.col(f"t{trigrams.index(trigram)}"))
            found = both if found is None else F.array_union(found, both)
        return found

    hits = index.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), rows_of(q).alias("rows")) for kind, q in queries.items()
    ])).alias("hit")).select("hit.kind", F.explode("hit.rows").alias("row"))
    return hits.groupBy("row").agg(F.collect_set("kind").alias("rules"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule as array of (start, rank, end, kind): code points from 0, end exclusive; leftmost, not overlapping.

    What lies between the matches and the matches themselves, measured in turn, give the positions.
    """
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"))), counted, lambda a, c: F.struct(a.gap.alias("gap"), a.size.alias("size"), F.length(c).alias("counted")))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state.at + x.gap
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x.size).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x.size).alias("at"), F.when(x.counted >= rule.shortest, F.array_append(state.spans, span)).otherwise(state.spans).alias("spans"))

    matched = F.filter(sizes, lambda x: x.size.isNotNull())
    return F.aggregate(matched, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda state: state.spans)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Finds secrets in every whole text: (doc, spans), the row as a struct and array<struct<start,rank,end,kind>>.

    Rules with mandatory trigrams are verified only in the rows that the index gives for them; rules without any run
    over every row. Rows meet their candidates by a hash of id and text, which need not be unique: it only decides
    where to look. Null text counts as empty and has no spans; null ids and repeated rows are kept; other columns pass
    through whatever their names; spans of different kinds may overlap and come by start, then in the order of the
    rules. An empty table gives no rows.
    """
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = packed(docs).withColumn("row", F.xxhash64("doc.doc_id", "doc.text"))
    indexed = {r.kind for r in rules if trigram_query(r.pattern) is not None}
    found = rows.join(candidates(rows.select("row", F.col("doc.text").alias("text")), rules), "row", "left") if indexed else rows
    none = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string>>")
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(text, rule, rank)
        each.append(F.when(F.array_contains("rules", rule.kind), spans).otherwise(none) if rule.kind in indexed else spans)
    return found.select("doc", F.array_sort(F.concat(*each)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _equals(value: str):
    return lambda x: x == value


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts and spans per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    spans = F.col("spans")
    base = [r.kind for r in BASE]
    return scan(docs.select("doc_id", "text"), rules).select(
        F.col("doc.doc_id").alias("doc_id"),
        *[F.size(F.filter(F.transform(spans, lambda s: s.kind), _equals(kind))).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(written(F.filter(spans, lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )


def masked(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans become one. n_chars follows the text.

    Rows without spans, null texts among them, are unchanged.
    """
    text = F.col("doc.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state.at + 1, s.start - state.at)
        return F.when(s.start >= state.at, F.struct(s.end.alias("at"), F.concat(state.out, gap, F.lit(mask)).alias("out"))).otherwise(
            F.struct(F.greatest(state.at, s.end).alias("at"), state.out.alias("out")))

    rest = lambda state: F.concat(state.out, F.substring(text, state.at + 1, F.length(text)))
    hidden = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(text)
    changed = {"text": F.col("hidden")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("hidden").cast("long")).otherwise(F.col("doc.n_chars"))
    return unpacked(scan(docs, rules).withColumn("hidden", hidden), docs, **changed)
