"""One query per operator over its whole table, with DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import bpe, divergence, embeddings, minhash, mixing, quality, secrets, simhash, substrings, suffix_tree, token_counts, urls, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
l AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by(rest / free, n) AS level FROM l WHERE cap * free > rest * w),
t AS (SELECT source, source_size, CASE WHEN cap * free <= rest * w THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM l LEFT JOIN v ON true),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d),
j AS (
  SELECT p.doc_id, p.size, p.ahead, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - ahead)) AS BIGINT) AS taken FROM j
"""


@_query
def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@_query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def _secrets_oracle() -> str:
    """Every rule over every text, without an index: lengths between and of the matches, added up."""
    stated = {"access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}  # the base kinds as given
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern, group, shortest = stated.get(rule.kind, (rule.pattern, rule.group, rule.shortest))
        pattern = pattern.replace("'", "''")
        parts.append(f"""
  SELECT n, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
    'rank': {rank}, 'size': length(m[i]), 'kind': '{rule.kind}', 'ok': length(g[i]) >= {shortest}}}), lambda x: x.ok)) AS s
  FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
p AS (SELECT n, s.kind AS kind, CAST(s.start AS BIGINT) AS b, s.rank AS r, s.kind || ':' || CAST(CAST(s.start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s.start + s.size AS BIGINT) AS VARCHAR) AS w FROM f),
a AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(w, ',' ORDER BY b, r) FILTER (r < 3) AS base, string_agg(w, ',' ORDER BY b, r) AS spans
  FROM p GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)
"""


ORACLES["op5_secret_scan"] = _secrets_oracle()


@_query
def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, folder, "documents"), with_text=False)


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT g.doc_id, list(i) AS lost FROM g JOIN m ON g.g = m.g AND m.least < g.doc_id GROUP BY g.doc_id),
c AS (SELECT doc_id, list(DISTINCT k) AS cut FROM (SELECT doc_id, unnest(lost) AS i FROM r), unnest(range(i, i + 13)) AS u(k) GROUP BY doc_id),
x AS (SELECT p.doc_id, string_agg(p.w[p.k], ' ' ORDER BY p.k) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) p
  LEFT JOIN (SELECT doc_id, unnest(cut) AS k FROM c) q ON p.doc_id = q.doc_id AND p.k = q.k WHERE q.k IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(c.cut), 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


@_query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, folder, "labels")))


@_query
def op1_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edit_report(_table(spark, folder, "documents"))


@_query
def op9_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(_table(spark, folder, "documents"))


@_query
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


@_query
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


@_query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS (SELECT lang, source, term, coalesce(n, 0) AS n, n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT x.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY x.lang, source) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (n_lang + 2)) // (total + 2 * v) AS q FROM x JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@_query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(_table(spark, folder, "documents"))
