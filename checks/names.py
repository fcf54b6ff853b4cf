"""Transcript queries: T1-T20."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import with_views
from rollcall.functions import text as tx
from rollcall.operators import names
from rollcall.session import salt_count

TEXT = with_views("text_v")
BLOCKED = ", ".join(f"'{w}'" for w in tx.BLOCKED_WORDS)


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def clean_sql(raw: str) -> str:
    marks = f"regexp_replace(trim({raw}), '^[.,!?]+|[.,!?]+$', '', 'g')"
    cut = f"regexp_replace(regexp_replace({marks}, '\\s+and\\s+i''?m\\b.*$', '', 'is'), '\\s+from\\b.*$', '', 'is')"
    squeezed = f"trim(regexp_replace({cut}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({marks}, '^i''?m\\b', 'i') THEN '' ELSE {squeezed} END"


def valid_sql(name: str) -> str:
    return f"""({name} <> '' AND len(string_split({name}, ' ')) <= 3 AND len([w for w in string_split({name}, ' ')
      if length(w) < 2 or lower(w) in ({BLOCKED}) or not regexp_full_match(w, '[A-Za-z][A-Za-z''\\-]*')]) = 0)"""


def heard_cte(source: str, text: str, ids: str, out: str) -> str:
    """Valid name hits of every text; the third rule is matched without lookahead and then filtered."""
    arms = []
    for rule, (pattern, score) in enumerate(tx.NAME_RULES):
        plain = pattern.replace(r"(?!i'?m\b)", "")
        drop = " WHERE lower(raw) NOT IN ('im', 'i''m')" if plain != pattern else ""
        arms.append(f"""SELECT {ids}, {rule} AS rule, {score} AS score, pos, raw FROM (SELECT {ids},
  generate_subscripts(m, 1) AS pos, unnest(m) AS raw FROM (SELECT {ids}, regexp_extract_all({text}, '{q(plain)}', 1, 'i') AS m FROM {source}) x) y{drop}""")
    union = "\nUNION ALL ".join(arms)
    return f"""{out}_raw AS ({union}),
{out}_named AS (SELECT {ids}, rule, score, pos, {clean_sql('raw')} AS name FROM {out}_raw),
{out} AS (SELECT * FROM {out}_named WHERE {valid_sql('name')})"""


def firsts_cte(hits: str, ids: str, out: str) -> str:
    return f"""{out} AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY rule, pos) - 1 AS name_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY {ids}, lower(name) ORDER BY rule, pos) AS rn FROM {hits}) z WHERE rn = 1)"""


IDS = "job_id, seg_idx, source_video, start_s, text"
HEARD = TEXT + ",\n" + heard_cte("text_v", "text", IDS, "hits") + ",\n" + firsts_cte("hits", IDS, "heard")


@query("t1_clean_segments", TEXT + """ SELECT job_id, seg_idx, trim(text) AS text FROM text_v
  WHERE trim(text) <> '' AND start_s <= CASE WHEN source_video = 'user' THEN 40 ELSE 25 END""")
def _(t):
    limited = t.text.withColumn("limit_s", F.when(F.col("source_video") == "user", 40.0).otherwise(25.0))
    return names.clean_segments(limited, "limit_s").select("job_id", "seg_idx", "text")


@query("t2_name_hits", HEARD + " SELECT job_id, seg_idx, rule, score, name FROM hits")
def _(t):
    found = t.text.withColumn("hit", F.explode(tx.spoken_names(F.col("text"))))
    return found.select("job_id", "seg_idx", "hit.rule", "hit.score", "hit.name")


@query("t3_clean_names", TEXT + f""" SELECT job_id, seg_idx, name FROM (SELECT job_id, seg_idx, {clean_sql('text')} AS name FROM text_v) q
  WHERE {valid_sql('name')}
UNION ALL SELECT 'part', p_partkey, p_name FROM part""")
def _(t):
    texts = t.text.select("job_id", "seg_idx", "text").unionByName(
        t.table("part").select(F.lit("part").alias("job_id"), F.col("p_partkey").alias("seg_idx"),
                               F.concat(F.lit(" "), "p_name", F.lit(" from here!")).alias("text"))
    )
    return texts.withColumn("name", tx.clean_name(F.col("text"))).filter(tx.valid_name(F.col("name"))).select("job_id", "seg_idx", "name")


@query("t4_spoken_names", HEARD + " SELECT job_id, seg_idx, name, score FROM heard")
def _(t):
    return tx.with_spoken_names(t.text).select("job_id", "seg_idx", F.explode("spoken").alias("s")).select(
        "job_id", "seg_idx", "s.name", "s.score"
    )


EVENTS = HEARD + """,
ev AS (SELECT job_id, seg_idx, source_video, text AS transcript, name_idx, name, start_s + 0.35 AS ts_s,
  score + CASE WHEN start_s + 0.35 < 120 THEN 5 ELSE 0 END AS confidence FROM heard),
ctx AS (SELECT job_id, source_video, seg_idx, string_agg(text, ' ' ORDER BY first_s) AS context FROM (
  SELECT e.job_id, e.source_video, e.seg_idx, s.text, min(s.start_s) AS first_s FROM (SELECT DISTINCT job_id, source_video, seg_idx, ts_s FROM ev) e
  JOIN text_v s ON s.job_id = e.job_id AND s.source_video = e.source_video AND s.start_s BETWEEN e.ts_s - 2 AND e.ts_s + 12
  GROUP BY ALL) g GROUP BY ALL)"""


def events(t):
    return names.name_events(t.text.withColumn("clip_idx", F.lit(0)))


@query("t5_name_events", EVENTS + " SELECT job_id, source_video, seg_idx, name_idx, name, ts_s, confidence FROM ev")
def _(t):
    return events(t).select(
        "job_id", "source_video", "event_ord.seg_idx", "event_ord.name_idx", "name", F.col("timestamp").alias("ts_s"), "confidence"
    )


@query("t6_context", EVENTS + """ SELECT e.job_id, e.source_video, e.seg_idx, e.name_idx, c.context FROM ev e JOIN ctx c
  ON c.job_id = e.job_id AND c.source_video = e.source_video AND c.seg_idx = e.seg_idx""")
def _(t):
    return events(t).select(
        "job_id", "source_video", "event_ord.seg_idx", "event_ord.name_idx", F.col("context_transcript").alias("context")
    )


DEDUPE = with_views("event_v", recursive=True) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, source_video, lower(name) ORDER BY confidence DESC, event_id) AS r FROM event_v),
fold AS (SELECT job_id, source_video, lower(name) AS lname, event_id, r, [ts_s] AS kept, TRUE AS keep FROM ranked WHERE r = 1
  UNION ALL SELECT e.job_id, e.source_video, f.lname, e.event_id, e.r,
    CASE WHEN len([x for x in f.kept if abs(x - e.ts_s) <= 90]) = 0 THEN list_append(f.kept, e.ts_s) ELSE f.kept END,
    len([x for x in f.kept if abs(x - e.ts_s) <= 90]) = 0
  FROM fold f JOIN ranked e ON e.job_id = f.job_id AND e.source_video = f.source_video AND lower(e.name) = f.lname AND e.r = f.r + 1)"""


@query("t8_keep_best_repeats", DEDUPE + " SELECT job_id, source_video, lname, event_id FROM fold WHERE keep")
def _(t):
    kept = names.keep_best_repeats(t.event.withColumn("event_ord", F.col("event_id")))
    return kept.select("job_id", "source_video", F.lower("name").alias("lname"), "event_id")


@query("t8_kept_spoken_names", HEARD.replace("WITH text_v", "WITH RECURSIVE text_v", 1) + """,
e0 AS (SELECT *, score + CASE WHEN start_s + 0.35 < 120 THEN 5 ELSE 0 END AS conf FROM heard),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, source_video, lower(name) ORDER BY conf DESC, seg_idx, name_idx) AS r FROM e0),
fold AS (SELECT job_id, source_video, lower(name) AS lname, seg_idx, r, [start_s] AS kept, TRUE AS keep FROM ranked WHERE r = 1
  UNION ALL SELECT e.job_id, e.source_video, f.lname, e.seg_idx, e.r,
    CASE WHEN len([x for x in f.kept if abs(x - e.start_s) <= 90]) = 0 THEN list_append(f.kept, e.start_s) ELSE f.kept END,
    len([x for x in f.kept if abs(x - e.start_s) <= 90]) = 0
  FROM fold f JOIN ranked e ON e.job_id = f.job_id AND e.source_video = f.source_video AND lower(e.name) = f.lname AND e.r = f.r + 1)
SELECT job_id, source_video, lname, seg_idx FROM fold WHERE keep""")
def _(t):
    return names.keep_best_repeats(events(t)).select(
        "job_id", "source_video", F.lower("name").alias("lname"), "event_ord.seg_idx"
    )


# Texts with spelled names, built from part names. {dash} and {gap} spell a word.
SPELLED = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN w2 ELSE w1 END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'spelled ' || {dash1}
    WHEN 1 THEN 'I''m from ' || p_brand || ' but it is ' || {gap2} || ' with a K'
    WHEN 2 THEN {dash1} || ' and, ' || {gap2} || ', it''s an R'
    WHEN 3 THEN 'spelled with a B. with an ' || substr(w2, 1, 1)
    WHEN 4 THEN w1 || ' pronounced as ' || w2 || '. ' || {dash2}
    ELSE 'My name is ' || p_name || ' from ' || p_brand || ', pronunciation is ' || w1 END AS text,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'call  me ' || w2 || ' from here' WHEN 2 THEN 'with a T and ' || {gap1}
    ELSE 'so   here we are' END AS context
FROM (SELECT p_partkey, p_name, p_brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part) p"""


def _spell(join: str, split: str) -> str:
    return SPELLED.format(**{
        f"{style}{n}": f"{join}({split}(w{n}, ''), '{mark}')" for style, mark in (("dash", "-"), ("gap", " ")) for n in (1, 2)
    })


SPELL_SQL = f"WITH spell_v AS ({_spell('array_to_string', 'string_split')})"


def spelled(t):
    t.table("part").createOrReplaceTempView("part")
    return t.sql(_spell("array_join", "split"))


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def merge_sql(a: str, b: str) -> str:
    a, b = squeeze_sql(a), squeeze_sql(b)
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' OR {a} = {b} THEN {a} ELSE {a} || ' ' || {b} END"


def location_sql(text: str) -> str:
    tries = []
    for pattern in tx.LOCATION_PATTERNS:
        raw = f"regexp_replace(trim(regexp_extract({text}, '{q(pattern)}', 1, 'i')), '^[.,!?]+|[.,!?]+$', '', 'g')"
        place = squeeze_sql(f"regexp_replace(regexp_replace({raw}, '\\s+and\\s+i''?m\\b.*$', '', 'is'), '\\s+but\\b.*$', '', 'is')")
        tries.append(f"CASE WHEN {place} <> '' AND lower({place}) NOT IN ({BLOCKED}) THEN {place} END")
    return f"coalesce({', '.join(tries)}, '')"


def spellings_sql(text: str) -> str:
    dashed = "regexp_replace(upper(s), '[\\s\\-]+', '-', 'g')"
    found = f"[{dashed} for s in regexp_extract_all({text}, '{q(tx.LETTERS_PATTERN)}', 0, 'i')]"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def letters_sql(text: str) -> str:
    last = [f"upper(regexp_extract_all({text}, '{q(p)}', 1, 'i')[-1])" for p in tx.CLARIFICATION_PATTERNS]
    listed = f"[x for x in [{', '.join(last)}] if x is not null]"
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


def bare(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def relates_sql(spelling: str, name: str) -> str:
    a, b = bare(spelling), bare(name)
    return f"""({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})
      OR CASE WHEN length({a}) = length({b}) THEN hamming({a}, {b}) <= 2 ELSE FALSE END
      OR (length({a}) >= 4 AND length({b}) >= 4 AND right({a}, 4) = right({b}, 4))
      OR (length({a}) >= 4 AND length({b}) >= 4 AND right({a}, 3) = right({b}, 3))))"""


def details_cte(source: str, ids: str, transcript: str, name: str, context: str) -> str:
    """Stages d1 to d6 of the introduction details over ``source``."""
    apply = f"""({relates_sql('name_spelling', 'name')} AND NOT (len(string_split({squeeze_sql('name')}, ' ')) > 1
      AND length({bare('name_spelling')}) > length({bare('name')}) + 2) AND abs(length({bare('name_spelling')}) - length({bare('name')})) <= 3)"""
    spoken = bare("name_spelling")
    proper = f"CASE WHEN length({spoken}) <= 3 THEN upper({spoken}) ELSE upper(left({spoken}, 1)) || substr({spoken}, 2) END"
    said = [f"regexp_matches(txt, '{q(p)}', 'i')" for p in tx.PRONUNCIATION_PATTERNS]
    what = [f"trim(regexp_extract(txt, '{q(p)}', 1, 'i'))" for p in tx.PRONUNCIATION_PATTERNS]
    return f"""d1 AS (SELECT {ids}, {name} AS name, {merge_sql(transcript, context)} AS txt FROM {source}),
d2 AS (SELECT *, {location_sql('txt')} AS location, {spellings_sql('txt')} AS spellings, {letters_sql('txt')} AS letters FROM d1),
d3 AS (SELECT *, [s for s in spellings if {relates_sql('s', 'name')}] AS related FROM d2),
d4 AS (SELECT *, len(related) = 0 AND len(spellings) > 0 AS borrowed,
  CASE WHEN len(related) > 0 THEN [s for s in related if length({bare('s')}) = list_max([length({bare('r')}) for r in related])][1]
    WHEN len(spellings) > 0 THEN spellings[-1] ELSE '' END AS offered FROM d3),
d5 AS (SELECT *, CASE WHEN offered = '' OR len([l for l in letters if l <> left(offered, 1)]) = 0 THEN offered
    ELSE [l for l in letters if l <> left(offered, 1)][-1] || substr(offered, 2) END AS name_spelling,
  CASE WHEN name = '' OR len([l for l in letters if l <> upper(left(name, 1))]) = 0 THEN name
    ELSE [l for l in letters if l <> upper(left(name, 1))][-1] || substr(name, 2) END AS by_letter FROM d4),
d6 AS (SELECT *, CASE WHEN name_spelling <> '' AND {apply} THEN {proper} WHEN len(letters) > 0 THEN by_letter ELSE name END AS display_name,
  coalesce(nullif(CASE WHEN {said[0]} THEN {what[0]} WHEN {said[1]} THEN {what[1]} ELSE '' END, ''), replace(name_spelling, '-', ' ')) AS pronunciation FROM d5),
d7 AS (SELECT *, concat_ws('; ', CASE WHEN borrowed THEN '{tx.OTHER_NAME_NOTE}' END,
  CASE WHEN len(letters) > 0 AND by_letter = display_name THEN array_to_string(['Spelled with a ' || l || ' on camera' for l in letters], '; ') END) AS spelling_note,
  CASE WHEN display_name <> name THEN name END AS name_heard FROM d6)"""


DETAILS = SPELL_SQL + ",\n" + details_cte("spell_v", "p_partkey", "text", "name", "context")


def detailed(t):
    return tx.with_intro_details(spelled(t), "text", "name", "context")


@query("t9_locations", TEXT + f" SELECT job_id, seg_idx, {location_sql('text')} AS location FROM text_v")
def _(t):
    return t.text.select("job_id", "seg_idx", tx.location(F.col("text")).alias("location"))


@query("t10_letter_spellings", SPELL_SQL + f""" SELECT p_partkey, array_to_string({spellings_sql("text || ' ' || context")}, '|') AS spellings FROM spell_v""")
def _(t):
    text = F.concat_ws(" ", "text", "context")
    return spelled(t).select("p_partkey", F.array_join(tx.letter_spellings(text), "|").alias("spellings"))


@query("t11_clarifications", SPELL_SQL + f""" SELECT p_partkey, array_to_string(['Spelled with a ' || l || ' on camera' for l in {letters_sql("text || ' ' || context")}], '|') AS notes FROM spell_v""")
def _(t):
    letters = tx.clarified_letters(F.concat_ws(" ", "text", "context"))
    return spelled(t).select("p_partkey", F.array_join(tx.clarification_notes(letters), "|").alias("notes"))


NAME_PAIRS = "SELECT p.p_partkey, s.s_suppkey, split_part(p.p_name, ' ', 1) AS a, split_part(o.p_name, ' ', 2) AS b FROM part p JOIN supplier s ON s.s_nationkey = p.p_partkey % 25 JOIN part o ON o.p_partkey = s.s_suppkey"


@query("t12_spelling_relates", f"WITH n AS ({NAME_PAIRS}) SELECT p_partkey, s_suppkey, {relates_sql('a', 'b')} AS related FROM n")
def _(t):
    part, supplier = t.table("part"), t.table("supplier")

    def letters(word: int):
        return tx.letters_only(F.split_part("p_name", F.lit(" "), F.lit(word)))

    # Letters are taken once per part and supplier. Few bytes make many pairs, so the tasks of the join are given: none are put together by size.
    tasks, salts = int(t.spark.conf.get("spark.sql.shuffle.partitions")), salt_count(part)
    spelled_as = part.select("p_partkey", (F.col("p_partkey") % 25).alias("s_nationkey"), letters(1).alias("a"))
    named = supplier.join(part.select(F.col("p_partkey").alias("s_suppkey"), letters(2).alias("b")), "s_suppkey").select("s_suppkey", "s_nationkey", "b")
    keys = ["s_nationkey", "_salt"]
    pairs = spelled_as.withColumn("_salt", F.pmod(F.xxhash64("p_partkey"), F.lit(salts)).cast("int")).repartition(tasks, *keys).join(
        named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(tasks, *keys), keys
    )
    return pairs.select("p_partkey", "s_suppkey", tx.related_letters(F.col("a"), F.col("b")).alias("related"))


@query("t13_best_spelling", DETAILS + " SELECT p_partkey, offered, borrowed FROM d4")
def _(t):
    text = tx.merge_texts(F.col("text"), F.col("context"))
    rows = spelled(t).withColumn("s", tx.letter_spellings(text)).withColumn("best", tx.best_spelling(F.col("s"), F.col("name")))
    borrowed = (F.col("best") == "") & (F.size("s") > 0)
    return rows.select(
        "p_partkey", F.when(borrowed, F.try_element_at("s", F.lit(-1))).otherwise(F.col("best")).alias("offered"), borrowed.alias("borrowed")
    )


@query("t14_clarified", DETAILS + " SELECT p_partkey, name_spelling, by_letter FROM d5")
def _(t):
    letters = tx.clarified_letters(tx.merge_texts(F.col("text"), F.col("context")))
    rows = detailed(t).withColumn("_l", letters)
    return rows.select("p_partkey", "name_spelling", tx.clarify_name(F.col("name"), F.col("_l")).alias("by_letter"))


@query("t15_display_name", DETAILS + " SELECT p_partkey, display_name FROM d6")
def _(t):
    return detailed(t).select("p_partkey", "display_name")


@query("t16_pronunciation", DETAILS + " SELECT p_partkey, pronunciation FROM d6")
def _(t):
    return detailed(t).select("p_partkey", "pronunciation")


@query("t17_merged_text", SPELL_SQL + f" SELECT p_partkey, {merge_sql('text', 'context')} AS txt FROM spell_v")
def _(t):
    return spelled(t).select("p_partkey", tx.merge_texts(F.col("text"), F.col("context")).alias("txt"))


DETAIL_COLUMNS = ["location", "name_spelling", "spelling_note", "pronunciation", "name_heard"]


@query("t18_intro_details", DETAILS + f" SELECT p_partkey, display_name, {', '.join(DETAIL_COLUMNS)} FROM d7")
def _(t):
    return detailed(t).select("p_partkey", "display_name", *DETAIL_COLUMNS)


STORED = """stored AS (SELECT job_id, seg_idx, source_video, start_s + 0.35 AS ts_s, text AS transcript,
  CASE seg_idx % 3 WHEN 0 THEN 'Cory' WHEN 1 THEN 'Rory Ann' ELSE 'red' END AS name,
  CASE seg_idx % 5 WHEN 0 THEN 'Kory' WHEN 1 THEN '' END AS name_heard FROM text_v)"""
ENRICH = HEARD + ",\n" + STORED + """,
based AS (SELECT s.*, coalesce(h.name, s.name) AS base FROM stored s LEFT JOIN (SELECT job_id, seg_idx, name FROM heard WHERE name_idx = 0) h
  ON h.job_id = s.job_id AND h.seg_idx = s.seg_idx),
""" + details_cte("based", "job_id, seg_idx, name_heard AS earlier", "transcript", "base", "''")


def stored(t):
    seg = F.col("seg_idx")
    return t.text.select(
        "job_id", "seg_idx", "source_video", (F.col("start") + 0.35).alias("timestamp"), F.col("text").alias("transcript"),
        F.when(seg % 3 == 0, "Cory").when(seg % 3 == 1, "Rory Ann").otherwise("red").alias("name"),
        F.when(seg % 5 == 0, "Kory").when(seg % 5 == 1, "").alias("name_heard"), F.lit("").alias("context_transcript"),
    )


@query("t19_enrich_detections", ENRICH + """ SELECT job_id, seg_idx, display_name AS name, location, name_spelling, spelling_note,
  pronunciation, coalesce(name_heard, earlier) AS name_heard FROM d7""")
def _(t):
    return names.enrich_detections(stored(t)).select("job_id", "seg_idx", "name", *DETAIL_COLUMNS)


def talk_clips(t):
    """What the user says is the main clip of a conversation."""
    return t.text.select("job_id", "source_video", (F.col("source_video") == "user").alias("is_main")).distinct()


BOUNDED = """,
nx AS (SELECT job_id, ts_s, lead(ts_s) OVER (PARTITION BY job_id ORDER BY ts_s) AS next_s FROM (SELECT DISTINCT job_id, ts_s FROM stored) q),
bctx AS (SELECT job_id, ts_s, string_agg(text, ' ' ORDER BY first_s) AS context FROM (SELECT n.job_id, n.ts_s, s.text, min(s.start_s) AS first_s
  FROM nx n JOIN text_v s ON s.job_id = n.job_id AND s.source_video = 'user' AND s.start_s BETWEEN n.ts_s - 2 AND least(n.ts_s + 12, n.next_s - 0.5) GROUP BY ALL) g GROUP BY ALL)"""


@query("t7_bounded_context", HEARD + ",\n" + STORED + BOUNDED + " SELECT * FROM bctx")
def _(t):
    return names.bounded_contexts(stored(t), t.text, talk_clips(t)).select(
        "job_id", F.col("timestamp").alias("ts_s"), F.col("context_transcript").alias("context")
    )


REFRESH = HEARD + ",\n" + STORED + BOUNDED + """,
based AS (SELECT s.*, coalesce(h.name, nullif(s.name_heard, ''), s.name) AS base, coalesce(c.context, '') AS context FROM stored s
  LEFT JOIN (SELECT job_id, seg_idx, name FROM heard WHERE name_idx = 0) h ON h.job_id = s.job_id AND h.seg_idx = s.seg_idx
  LEFT JOIN bctx c ON c.job_id = s.job_id AND c.ts_s = s.ts_s),
""" + details_cte("based", "job_id, seg_idx, name_heard AS earlier", "transcript", "base", "context")


@query("t20_refresh_details", REFRESH + """ SELECT job_id, seg_idx, display_name AS name, location, name_spelling, spelling_note,
  pronunciation, coalesce(name_heard, earlier) AS name_heard FROM d7""")
def _(t):
    return names.refresh_details(stored(t), t.text, talk_clips(t)).select("job_id", "seg_idx", "name", *DETAIL_COLUMNS)
