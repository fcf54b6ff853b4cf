"""Names, places and spellings in transcript text, by worked examples."""

import re

import pytest
from pyspark.sql import functions as F

from rollcall.functions import scalars
from rollcall.functions import text as tx
from rollcall.operators import names, report


def _names(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    rows = tx.with_spoken_names(df).orderBy("n").collect()
    return [[(s.name, s.score) for s in r.spoken] for r in rows]


def test_name_rules(spark):
    assert _names(spark, [
        "Hi, I'm Cory and I'm from Ohio.",
        "this is great",
        "My name is Mary Ann. Call me Mary, this is MARY",
        "I'm Al Green and I'm currently here",
        "hello im Bo, my name is the boss",
        "So I'm back and I'm from Utah",
        "My name is\u00a0Zed",
        "my name is Jo Ann from here",
        "",
    ]) == [
        [("Cory", 35.0)], [], [("Mary Ann", 40.0), ("MARY", 25.0)], [("Al Green", 32.0)], [("Bo", 30.0)],
        [], [("Zed", 40.0)], [("Jo Ann", 40.0)], [],
    ]


def test_blocked_and_malformed_names(spark):
    df = spark.createDataFrame(
        [("Cory and I'm here",), (" I'm Bo",), ("Ann Lee from Utah",), ("a b",), ("One Two Three Four",), ("x2 y",), (" Bo-Jo, ",), ("here",)], "raw string"
    )
    got = df.select(F.when(tx.valid_name(tx.clean_name(F.col("raw"))), tx.clean_name(F.col("raw"))).alias("n")).collect()
    assert [r.n for r in got] == ["Cory", None, "Ann Lee", None, None, None, "Bo-Jo", None]


def _details(spark, transcript, name, context=""):
    df = spark.createDataFrame([(transcript, name, context)], "transcript string, name string, context string")
    return tx.with_intro_details(df, "transcript", "name", "context").first()


@pytest.mark.parametrize("transcript,name,expected", [
    ("Hi, I'm Cory and I'm from Ohio.", "Cory", {"location": "Ohio", "display_name": "Cory", "name_heard": None, "spelling_note": ""}),
    ("Cory with a K", "Cory", {"display_name": "Kory", "name_heard": "Cory", "spelling_note": "Spelled with a K on camera"}),
    ("spelled C - O - R - Y", "Cory", {"name_spelling": "C-O-R-Y", "display_name": "Cory", "pronunciation": "C O R Y"}),
    ("that is K-O-R-I", "Cory", {"name_spelling": "K-O-R-I", "display_name": "Kori", "name_heard": "Cory"}),
    ("A-B-C and Z Z Z Z Z Z", "Cory", {"name_spelling": "Z-Z-Z-Z-Z-Z", "display_name": "Cory", "spelling_note": tx.OTHER_NAME_NOTE}),
    ("J-O then J-O-E", "Joe", {"name_spelling": "J-O-E", "display_name": "JOE", "name_heard": "Joe"}),
    ("it's J-O-E", "Joe", {"name_spelling": "S-J-O-E", "display_name": "Sjoe"}),  # the s after the apostrophe is a letter too
    ("Cory, C-O-R-Y with a K", "Cory", {"name_spelling": "K-O-R-Y", "display_name": "Kory", "spelling_note": "Spelled with a K on camera"}),
    ("it's pronounced as Koh-ree, yes", "Cory", {"pronunciation": "Koh-ree"}),
    ("I'm from here. from New York and I'm glad", "Bo", {"location": ""}),
    ("from the north but raised south", "Bo", {"location": "the north"}),
])
def test_details(spark, transcript, name, expected):
    row = _details(spark, transcript, name)
    assert {k: row[k] for k in expected} == expected


def test_detection_keeps_name_of_transcript_or_event(spark):
    df = spark.createDataFrame(
        [("j", "red", "This is widget. Call me red", "")], "job_id string, name string, transcript string, context_transcript string"
    )
    assert names.enrich_detections(df).first().name == "widget"
    assert names.enrich_detections(df, base="event").first().name == "red"


def test_context_is_distinct_and_in_order(spark):
    segments = spark.createDataFrame(
        [("j", "m", 0, 0, 0.0, "one"), ("j", "m", 0, 1, 10.0, "My name is Bo"), ("j", "m", 0, 2, 12.0, "one more"), ("j", "m", 0, 3, 14.0, "My name is Bo"),
         ("j", "m", 0, 4, 22.35, "edge"), ("j", "m", 0, 5, 22.5, "late"), ("j", "x", 0, 6, 11.0, "other clip")],
        "job_id string, source_video string, clip_idx int, seg_idx long, start double, text string",
    )
    got = {r.event_ord.seg_idx: r for r in names.name_events(segments).collect()}
    assert got[1].context_transcript == "My name is Bo one more edge"
    assert got[1].timestamp == 10.35 and got[1].confidence == 45.0


def test_detail_lines(spark):
    df = spark.createDataFrame(
        [("Kory", "Cory", "Ohio", "K O R Y", "", "note"), ("Bo", "Bo", "", "", "", "")],
        "name string, name_heard string, location string, pronunciation string, name_spelling string, spelling_note string",
    )
    got = [r.detail_lines for r in report.detail_lines(df).collect()]
    assert got == [["From: Ohio", "Pronunciation: K O R Y", "Heard as: Cory", "note"], []]


def test_a_small_file_of_parts_makes_pairs_in_many_tasks(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(i, f"word{i} other{i}") for i in range(500)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(250)], "s_suppkey long, s_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = entry.queries()["t12_spelling_relates"](spark, str(tmp_path))
    from pyspark.sql import functions as F

    tasks = pairs.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 500 * 10
    assert len(tasks) > 4


def test_stems_lose_dots_and_underscores_at_both_ends(spark):
    texts = {"..a  b..": "a_b", "": "intro", "._._": "intro", "x" + "." * 9 + "y_": "x.........y", "é": "intro", "." * 200_000 + "a" + "._" * 100_000 + "b": "a" + "._" * 100_000 + "b"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.safe_stem(F.col("t"), "intro").alias("stem")).collect()
    assert {r.t: r.stem for r in rows} == texts


def test_stems_replace_whatever_the_ranges_leave_out_and_do_so_once(spark):
    texts = [f"a{chr(c)}{chr(c)}b" for c in [*range(1, 0x250), 0x2028, 0xFFFD, 0x1F600]] + ["-.a-", "a\\b", "a]b^c", "\u0130\u212a"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", scalars.safe_stem(F.col("t"), "intro").alias("stem"))
    plain = {t: re.sub("[^A-Za-z0-9._-]+", "_", t).strip("._") or "intro" for t in texts} | {None: "intro"}
    assert {r.t: r.stem for r in rows.collect()} == plain
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
