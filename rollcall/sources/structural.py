"""Large JSON documents read by many tasks: a structural index over the splits of a document's files.

Text arrives cut at every ``}``, so a document spreads over the splits that Spark makes of its files. One pass tells how each
split changes quote parity and bracket depth, for a start outside and inside a string; composing these few rows gives the
state in which every split begins. A second pass counts records where they lie and keeps what a split's borders cut in two;
only that is put together. A third pass hands the records on, numbered, one by one, and writes none of them in between.
Documents never become one row.

A document is an object whose members may be arrays of records, or one array of records. Its files follow each other by name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.session import cut_lineage

#: What changes the state: escapes, quotes and brackets.
TOKEN = re.compile(r'\\.|["\[\]{}]', re.DOTALL)
#: An object without objects, without arrays in arrays, and without escapes or brackets in its strings.
FLAT = re.compile(r'\{(?:[^"\\\[\]{}]++|"[^"\\\[\]{}]*+"|\[(?:[^"\\\[\]{}]++|"[^"\\\[\]{}]*+")*+\])*+\}')
#: Name of the records of a document that is one array, and what stands for a member that is an object.
ROOT, OBJECT = "", "{"
#: Rows handed on at once.
ROWS = 2_000

SPLIT = "job_id string, path string, start long"


def job_of(path: Column) -> Column:
    """The name of a file's folder, without a partition's ``job_id=``."""
    folder = F.url_decode(F.regexp_extract(path, "([^/]+)/[^/]+$", 1))
    return F.regexp_replace(folder, "^job_id=", "")


def job_name(path: str) -> str:
    """``job_of`` for one path, inside a task that meets the same path many times."""
    return unquote_plus(path.rsplit("/", 2)[-2]).removeprefix("job_id=")


def pieces(spark: SparkSession, pattern: str) -> DataFrame | None:
    """The text of all files between the closing braces, with its file and split; None where no file is."""
    try:
        text = spark.read.option("lineSep", "}").text(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    meta = F.col("_metadata")
    return text.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), "value")


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Splits in the order in which a task reads them, each with its text in parts; every part but a file's first opens with the brace that ended the one before."""

    def runs() -> Iterator[tuple[tuple, str]]:
        for batch in batches:
            if batch.num_rows:
                path, start = batch.column("path"), batch.column("start")
                new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
                values = batch.column("value").to_pylist()
                for low, high in itertools.pairwise([0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), batch.num_rows]):
                    place = [batch.column(c)[low].as_py() for c in ("path", "start", "size")]
                    yield (job_name(place[0]), *place), "}".join(values[low:high])

    rows = runs()
    waiting = next(rows, None)
    while waiting is not None:
        key = waiting[0]

        def texts(key: tuple = key) -> Iterator[str]:
            nonlocal waiting
            first = key[2] == 0
            while waiting is not None and waiting[0] == key:
                yield waiting[1] if first else "}" + waiting[1]
                first = False
                waiting = next(rows, None)

        yield key, texts()


class Passage:
    """How a text changes the state, for a start outside a string and for one inside: depth gained, whether it ends in a string, arrays opened by depth.

    What is outside a string for one start is inside for the other, so each bracket counts for one of them.
    """

    def __init__(self) -> None:
        self.in_string = False  # for the start outside a string; the other way round for the other
        self.depth = [0, 0]
        self.opened: tuple[dict[int, str], dict[int, str]] = ({}, {})  # depth before an opening bracket, counted from the start -> the string before it
        self.string: list[str | None] = [None, None]

    def read(self, text: str) -> None:
        at = past = 0
        while token := TOKEN.search(text, past):
            mark, past = token.group(), token.end()
            if mark == '"':
                self.string[not self.in_string] = text[at : token.start()]
                self.in_string, at = not self.in_string, past
            elif mark in "[{":
                way = int(self.in_string)
                self.opened[way][self.depth[way]] = OBJECT if mark == "{" else self.string[way] or ROOT
                flat = FLAT.match(text, token.start()) if mark == "{" and not way else None
                if flat:
                    past = flat.end()
                    at = text.rfind('"', at, past) + 1 or at
                else:
                    self.depth[way] += 1
            elif mark in "]}":
                self.depth[int(self.in_string)] -= 1


PASSAGE = f"{SPLIT}, size long, n_bytes long, root string, ends_in_string array<boolean>, gain array<long>, opened array<map<long,string>>"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("job_id", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("n_bytes", pa.int64()), ("root", pa.string()),
        ("ends_in_string", pa.list_(pa.bool_())), ("gain", pa.list_(pa.int64())), ("opened", pa.list_(pa.map_(pa.int64(), pa.string()))),
    ])
    for (job, path, start, size), texts in by_split(batches):
        passage, n_bytes, root = Passage(), 0, ""
        for text in texts:
            n_bytes += len(text.encode())
            root = root or text.lstrip()[:1]
            passage.read(text)
        yield pa.RecordBatch.from_pydict({
            "job_id": [job], "path": [path], "start": [start], "size": [size], "n_bytes": [n_bytes], "root": [root],
            "ends_in_string": [[passage.in_string, not passage.in_string]], "gain": [passage.depth], "opened": [[list(o.items()) for o in passage.opened]],
        }, schema)


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """State in which each split of a document begins; one row per split comes in. A document of one split needs none."""
    rows = rows.sort_values(["path", "start"]).reset_index(drop=True)
    missing = (rows["size"] - rows.groupby("path")["n_bytes"].transform("sum")).to_numpy()
    last = ~rows.duplicated("path", keep="last").to_numpy()
    in_string, depth, section, root = False, 0, ROOT, ""
    out = []
    for row, lacks, ends in zip(rows.itertuples(), missing, last, strict=True):
        root = root or row.root
        closing = bool(ends and lacks == 1)  # a closing brace at the very end of a file is not read as text
        out.append((row.job_id, row.path, row.start, in_string, depth, section, root, closing))
        way = int(in_string)
        opened = dict(row.opened[way])
        outer = 1 if root == "{" else 0
        section = opened.get(outer - depth, section)
        in_string, depth = bool(row.ends_in_string[way]), depth + int(row.gain[way])
        depth -= closing and not in_string
    if in_string or depth:
        raise ValueError(f"malformed JSON document of {rows.job_id.iloc[0]}: {rows.path.iloc[-1]} ends inside a value")
    return pd.DataFrame(out if len(out) > 1 else [], columns=["job_id", "path", "start", "in_string", "depth", "section", "root", "closing"])


class Cutter:
    """Cuts the records of one split, given the state in which it begins."""

    def __init__(self, in_string: bool, depth: int, section: str, root: str, wanted: set[str]):
        self.in_string, self.depth, self.section = in_string, depth, section
        self.inside = 3 if root == "{" else 2  # depth of a record's members
        self.wanted = wanted
        self.string: str | None = None
        self.record: list[str] | None = [] if depth >= self.inside and section in wanted else None
        self.cut_before = self.record is not None  # the record began in an earlier split
        self.rest: list[str] = []

    def in_records(self) -> bool:
        return self.depth >= self.inside - 1 and self.section in self.wanted

    def read(self, text: str) -> Iterator[tuple[bool, str, str]]:
        """Records that end in the text: (whether it began earlier, section, text)."""
        at = quote = 0  # where the part that is not handed on begins, and the string that is open

        def keep(end: int) -> None:
            if self.record is not None:
                self.record.append(text[at:end])
            elif not self.in_records():
                self.rest.append(text[at:end])

        past = 0
        while token := TOKEN.search(text, past):
            mark, past = token.group(), token.end()
            if mark == '"':
                if self.in_string:
                    self.string = text[quote : token.start()]
                self.in_string, quote = not self.in_string, token.end()
            elif self.in_string or mark[0] == "\\":
                continue
            elif mark in "[{":
                if self.depth == self.inside - 2:
                    keep(token.end())
                    at = token.end()
                    self.section = OBJECT if mark == "{" else (self.string or ROOT) if self.inside == 3 else ROOT
                elif mark == "{" and self.depth == self.inside - 1 and self.in_records():
                    flat = FLAT.match(text, token.start())
                    if flat:
                        at = past = flat.end()
                        yield False, self.section, flat.group()
                        continue
                    self.record, self.cut_before, at = [], False, token.start()
                self.depth += 1
            else:
                if self.depth == self.inside and self.record is not None:
                    keep(token.end())
                    at = token.end()
                    yield self.cut_before, self.section, "".join(self.record)
                    self.record = None
                elif self.depth == self.inside - 1 and self.in_records():
                    at = token.start()  # commas and blanks between records go
                self.depth -= 1
        keep(len(text))


def _cutters(batches: Iterator[pa.RecordBatch], states: dict, wanted: set[str]) -> Iterator[tuple[tuple, Cutter, Iterator[list[tuple[bool, str, str]]]]]:
    """Each split with its cutter and, part by part, the records that end in it."""
    for (job, path, start, size), texts in by_split(batches):
        first = next(texts)
        state = states.get((path, start), (False, 0, ROOT, first.lstrip()[:1], None))
        cutter = Cutter(*state[:4], wanted)

        def parts(first=first, texts=texts, state=state, cutter=cutter, size=size) -> Iterator[list[tuple[bool, str, str]]]:
            n_bytes = 0
            for text in itertools.chain([first], texts):
                yield list(cutter.read(text))
                n_bytes += len(text.encode())
            if state[4] or state[4] is None and n_bytes + 1 == size:
                yield list(cutter.read("}"))

        yield (job, path, start), cutter, parts()


INDEX = f"{SPLIT}, idx long, kind string, section string, text string"


def _index_rows(batches: Iterator[pa.RecordBatch], states: dict, wanted: set[str]) -> Iterator[pa.RecordBatch]:
    """Per split: its records per section (``idx``), what its borders cut, and what belongs to no record."""
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for split, cutter, parts in _cutters(batches, states, wanted):
        rows, counts = [], {}
        for part in parts:
            for before, section, record in part:
                if before:
                    rows.append((*split, -1, "head", section, record))
                else:
                    counts[section] = counts.get(section, 0) + 1
        if cutter.record is not None:
            kind = "middle" if cutter.cut_before else "tail"
            rows.append((*split, counts.get(cutter.section, 0), kind, cutter.section, "".join(cutter.record)))
        rows += [(*split, n, "count", section, "") for section, n in counts.items()]
        rows.append((*split, 0, "rest", ROOT, "".join(cutter.rest)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["job_id", "path", "start", "idx", "kind", "section", "text"]
        )


def _record_rows(batches: Iterator[pa.RecordBatch], states: dict, wanted: set[str], kept: set[str], starts: dict) -> Iterator[pa.RecordBatch]:
    """Records of the ``kept`` sections that no border cuts, numbered from what ``starts`` says of their split."""
    for (job, path, start), _, parts in _cutters(batches, states, wanted):
        places = {section: starts.get((path, start, section), 0) for section in kept}
        for part in parts:
            sections, numbers, texts = [], [], []
            for before, section, record in part:
                if section in kept and not before:
                    sections.append(section)
                    numbers.append(places[section])
                    texts.append(record)
                    places[section] += 1
            for low in range(0, len(texts), ROWS):
                some = slice(low, low + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([job] * len(texts[some]), pa.string()), pa.array(sections[some], pa.string()), pa.array(numbers[some], pa.int64()), pa.array(texts[some], pa.string())],
                    ["job_id", "section", "place", "text"],
                )


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """Records that borders of splits cut: a tail, splits that lie wholly inside, and the head of a later split."""
    out, open_, parts = [], None, []
    for row in rows.sort_values(["path", "start", "idx"]).itertuples():
        if row.kind == "tail":
            open_, parts = row, [row.text]
        else:
            parts.append(row.text)
            if row.kind == "head":
                out.append((open_.job_id, open_.path, open_.start, open_.idx, open_.section, "".join(parts)))
    return pd.DataFrame(out, columns=["job_id", "path", "start", "idx", "section", "text"])


def split_states(text: DataFrame) -> dict[tuple[str, int], tuple]:
    """State at the beginning of the splits of all documents that have several, as a map that goes to the tasks.

    Entries are as many as the scan's own splits at most, each of which the driver holds anyway.
    """
    passages = text.mapInArrow(_passages, PASSAGE)
    states = passages.groupBy("job_id").applyInPandas(_compose, f"{SPLIT}, in_string boolean, depth long, section string, root string, closing boolean")
    return {(r.path, r.start): (r.in_string, r.depth, r.section, r.root, r.closing) for r in states.collect()}


def read_documents(spark: SparkSession, pattern: str, wanted: set[str], kept: set[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Records and envelopes of all documents whose files match ``pattern``; None where no file does.

    Records: (job_id, section, place, text), ``place`` counting from 0 in document order per section; ``wanted`` names the
    members that hold records, ``ROOT`` a document that is one array; of these the ``kept`` ones are handed on, all if not given.
    Envelopes: (job_id, text), the document with the wanted members' arrays emptied. A document that ends inside a value raises an
    error; an empty array gives no records.
    """
    text = pieces(spark, pattern)
    if text is None:
        return None
    kept = wanted if kept is None else kept
    states = spark.sparkContext.broadcast(split_states(text))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index_rows(batches, states.value, wanted)

    rows = cut_lineage(text.mapInArrow(index, INDEX))
    torn = cut_lineage(rows.filter(F.col("kind").isin("tail", "middle", "head")).groupBy("job_id").applyInPandas(
        _stitch, f"{SPLIT}, idx long, section string, text string"
    ))
    keys = ["job_id", "path", "start", "section"]
    counted = rows.filter("kind = 'count'").select(*keys, F.col("idx").alias("n")).unionByName(torn.select(*keys, F.lit(1).cast("long").alias("n")))
    before = W.partitionBy("job_id", "section").orderBy("path", "start").rowsBetween(W.unboundedPreceding, -1)
    begun = cut_lineage(counted.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # A row per later split of a document and section, as in ``split_states``; a document of one split needs none.
    starts = spark.sparkContext.broadcast({(r.path, r.start, r.section): r._before for r in begun.filter(F.col("_before") > 0).collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _record_rows(batches, states.value, wanted, kept, starts.value)

    whole = text.mapInArrow(cut, "job_id string, section string, place long, text string")
    mended = torn.filter(F.col("section").isin(*kept)).join(begun, keys).select("job_id", "section", (F.col("_before") + F.col("idx")).alias("place"), "text")
    parts = F.array_sort(F.collect_list(F.struct("path", "start", "text")))
    envelopes = rows.filter("kind = 'rest'").groupBy("job_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(mended), envelopes
