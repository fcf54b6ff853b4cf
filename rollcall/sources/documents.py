"""Stored JSON documents, one folder per job, as tables.

Documents with records are cut inside the splits of their files (``structural.py``), so one of any size spreads over many
tasks; clip lists and labels, which have one entry per clip or face, are parsed as a whole. ``name`` may be a pattern: files
of one folder are one document in the order of their names, as ``sinks.write_lines`` leaves them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from rollcall import schemas
from rollcall.operators.ordered import number_sorted
from rollcall.sources.structural import ROOT, job_of, read_documents


def _read(spark: SparkSession, base: str, name: str, schema: DataType) -> DataFrame:
    """(job_id, doc) for every ``<base>/<job>/<name>``; no file gives no rows, a malformed one ends the read with its error."""
    try:
        texts = spark.read.text(f"{base}/*/{name}", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType().add("job_id", "string").add("doc", schema))
    return parse(texts.select(job_of(F.col("_metadata.file_path")).alias("job_id"), "value"), schema)


def parse(texts: DataFrame, schema: DataType) -> DataFrame:
    """(job_id, doc) from document texts (job_id, value)."""
    return texts.select("job_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("doc"))


def records(lines: DataFrame, section: int, schema: DataType, place: str, record: str) -> DataFrame:
    """(job_id, place, record) of one section of a document's numbered lines, numbered from 0 in document order.

    A line holds one record after its comma, so each is parsed where it is and no job's document is put together.
    """
    inner = lines.where((F.col("section") == section) & (F.abs("ord") < 2**62))
    numbered = number_sorted(inner.select("job_id", F.col("ord").alias("_ord"), F.regexp_replace("line", "^,", "").alias("line")), ["job_id"], ["_ord"], place)
    return numbered.select("job_id", place, F.from_json("line", schema, {"mode": "FAILFAST"}).alias(record))


def _box(values: Column) -> Column:
    return F.struct(*[F.get(values, F.lit(i)).alias(side) for i, side in enumerate(("x1", "y1", "x2", "y2"))])


def observations(docs: DataFrame) -> DataFrame:
    """Observations of parsed faces documents, in document order."""
    return observation_rows(docs.select("job_id", F.posexplode("doc.observations").alias("obs_id", "o")))


def observation_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id", F.col("obs_id").cast("long").alias("obs_id"), F.coalesce("o.source_video", F.lit("")).alias("source_video"),
        "o.timestamp", _box(F.col("o.bbox")).alias("bbox"), "o.embedding", "o.lip_openness",
        F.coalesce("o.cluster_id", F.lit("")).alias("cluster_id"),
    )


def speaker_segments(docs: DataFrame) -> DataFrame:
    """Segments of parsed speakers documents, in document order."""
    return segment_rows(docs.select("job_id", F.posexplode("doc.segments").alias("seg_idx", "s")))


def segment_rows(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.col("seg_idx").cast("long").alias("seg_idx"), "s.speaker_id", "s.start", "s.end")


def mappings(docs: DataFrame) -> DataFrame:
    """Mappings of parsed correlation documents with their place, which decides shared faces."""
    return mapping_rows(docs.select("job_id", F.posexplode("doc.speaker_face_mappings").alias("mapping_order", "m")))


def mapping_rows(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "m.*", F.col("mapping_order").cast("long").alias("mapping_order"))


def lower_thirds(docs: DataFrame) -> DataFrame:
    """Lower thirds of parsed correlation documents, in document order."""
    return third_rows(docs.select("job_id", F.posexplode("doc.lower_thirds").alias("seg_idx", "t")))


def third_rows(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.col("seg_idx").cast("long").alias("seg_idx"), "t.*")


def detections(docs: DataFrame) -> DataFrame:
    """Detections of parsed documents, in document order."""
    return detection_rows(docs.select("job_id", F.posexplode("doc").alias("ord", "d")))


def detection_rows(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.col("ord").cast("long").alias("ord"), "d.*")


DETECTIONS_DOC = ArrayType(StructType([f for f in schemas.DETECTIONS if f.name not in ("job_id", "ord")]))


def _read_records(spark: SparkSession, files: str, doc: StructType | ArrayType, section: str, place: str, record: str) -> DataFrame:
    """(job_id, place, record) of one section of all documents; no file gives no rows, a malformed one ends the read with its error."""
    members = {ROOT: doc} if isinstance(doc, ArrayType) else {f.name: f.dataType for f in doc}
    wanted = {name for name, kind in members.items() if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)}
    schema = members[section].elementType
    found = read_documents(spark, files, wanted, {section})
    if found is None:
        return spark.createDataFrame([], StructType().add("job_id", "string").add(place, "long").add(record, schema))
    return found[0].select("job_id", F.col("place").alias(place), F.from_json("text", schema, {"mode": "FAILFAST"}).alias(record))


def read_observations(spark: SparkSession, base: str, name: str = "faces.json") -> DataFrame:
    """Observations in document order."""
    return observation_rows(_read_records(spark, f"{base}/*/{name}", schemas.FACES_DOC, "observations", "obs_id", "o"))


def read_clusters(spark: SparkSession, base: str, name: str = "faces.json") -> DataFrame:
    rows = _read_records(spark, f"{base}/*/{name}", schemas.FACES_DOC, "face_clusters", "place", "c")
    return rows.select(
        "job_id", "c.cluster_id", "c.sample_count", _box(F.col("c.representative_bbox")).alias("representative_bbox"), "c.thumbnail_path"
    )


def read_face_envelopes(spark: SparkSession, base: str, name: str = "faces.json") -> DataFrame:
    """The plain members of faces documents; the arrays of records are not put together for them."""
    plain = StructType([f for f in schemas.FACES_DOC if f.name in ("video", "sampled_videos", "noise_count", "estimated_people")])
    found = read_documents(spark, f"{base}/*/{name}", {"face_clusters", "observations"})
    if found is None:
        return spark.createDataFrame([], StructType([StructField("job_id", StringType()), *plain]))
    return parse(found[1].withColumnRenamed("text", "value"), plain).select("job_id", "doc.*")


def read_clip_lists(spark: SparkSession, base: str) -> DataFrame:
    return _read(spark, base, "clips.json", schemas.CLIPS_DOC).select("job_id", "doc.*")


def read_speaker_segments(spark: SparkSession, base: str, name: str = "speakers.json") -> DataFrame:
    """Segments in document order."""
    return segment_rows(_read_records(spark, f"{base}/*/{name}", schemas.SPEAKERS_DOC, "segments", "seg_idx", "s"))


def read_mappings(spark: SparkSession, base: str, name: str = "correlation.json") -> DataFrame:
    """Mappings with their place, which decides shared faces."""
    return mapping_rows(_read_records(spark, f"{base}/*/{name}", schemas.CORRELATION_DOC, "speaker_face_mappings", "mapping_order", "m"))


def read_lower_thirds(spark: SparkSession, base: str, name: str = "correlation.json") -> DataFrame:
    """Lower thirds in document order."""
    return third_rows(_read_records(spark, f"{base}/*/{name}", schemas.CORRELATION_DOC, "lower_thirds", "seg_idx", "t"))


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """The object's keys are the face ids."""
    return _read(spark, base, "labels.json", schemas.LABELS_DOC).select("job_id", F.explode("doc").alias("face_id", "name"))


def read_detections(spark: SparkSession, base: str, name: str = "all_detected_names.json") -> DataFrame:
    """Detections in document order; jobs without the file have none."""
    return detection_rows(_read_records(spark, f"{base}/*/{name}", DETECTIONS_DOC, ROOT, "ord", "d"))
