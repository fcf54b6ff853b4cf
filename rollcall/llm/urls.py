"""URL filters: rules, then host word segmentation and naive Bayes (operator 7)."""

from __future__ import annotations

import re
import string
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import stored
from rollcall.llm.words import by_bytes

# The stated rules, (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Words that mark a url as unwanted when they stand in it on their own; from them the classifier learns which others do.
SEEDS = (
    "adult", "bet", "bets", "betting", "casino", "cracked", "escort", "gamble", "gambling", "jackpot", "keygen", "lottery", "malware",
    "nude", "phishing", "pills", "poker", "porn", "scam", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)

#: Words of the segmentation and of the classifier that every task knows have at least this share of all counted words, at
#: most 500,000. A shortcut only: rarer words meet the urls that hold them in joins.
SHARE = 2e-6
LONGEST = 24
#: Segmented names that a task remembers.
REMEMBERED = 50_000

_NAME = re.compile(r"[a-z]+")


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path of a url; both empty for null or without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or above it and whose path begins the url's, and its action; else null."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verb)).otherwise(action)
    return rule, action


@dataclass
class Segmenter:
    """Splits names into words by the most likely unigram sequence (Viterbi)."""

    logs: dict[str, float]
    total: float

    def unknown(self, size: int) -> float:
        """A word that was never counted is the less likely the longer it is."""
        return -np.log(max(self.total, 1)) - size * np.log(10)

    def split(self, name: str, rarer: dict[str, float] | None = None) -> list[str]:
        """Words of a name; ``rarer`` has the logs of words in it that the segmenter itself does not hold."""
        logs = ChainMap(rarer, self.logs) if rarer else self.logs
        best, back = [0.0], [0]
        rare = [self.unknown(n) for n in range(LONGEST + 1)]
        for end in range(1, len(name) + 1):
            least = max(0, end - LONGEST)
            scores = [(best[a] + logs.get(name[a:end], rare[end - a]), a) for a in range(least, end)]
            score, start = max(scores)
            best.append(score)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]

    def words(self, text: str, known: dict[str, list[str]], rarer: list[tuple[str, float]] | None = None) -> list[str]:
        """Words of all names (runs of a to z) of a host and path; ``rarer`` are all rare words that lie in its names."""
        out = []
        for name in _NAME.findall(text):
            if name not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[name] = self.split(name, {w: x for w, x in rarer or () if w in name})
            out += known[name]
        return out


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one counts: the log odds of block against allow."""

    prior: float
    odds: dict[str, float]

    def score(self, words: list[str]) -> float:
        """Log odds that the prior and the words held here give."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def _counted(words: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Counts of ``words(word, n)`` that reach the share, the other ones, and the total of all."""
    counts = stored(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= SHARE * total), counts.where(F.col("n") < SHARE * total), total


def learn_words(pages: DataFrame, seeds=SEEDS) -> tuple[Segmenter, DataFrame]:
    """Unigram counts of the words in all urls and page texts; ``pages`` has url and html, either may be null.

    The segmenter holds the words that reach the share; the others come as a table (word, log).
    """
    addresses = F.split(F.lower(F.coalesce("url", F.lit(""))), "[^a-z]+")
    text = F.split(F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")), "[^a-z]+")
    own = pages.select(F.explode(addresses).alias("word")).unionByName(pages.select(F.explode(text).alias("word")))
    kept, rarer, total = _counted(own.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")))
    counts = {r.word: r.n for r in kept.collect()}
    floor = max(1, total // 10_000)
    for word in seeds:
        counts[word] = max(counts.get(word, 0), floor)
    rarer = rarer.where((F.length("word") > 1) & ~F.col("word").isin(*seeds)).select("word", F.log(F.col("n") / max(total, 1)).alias("log"))
    return Segmenter({w: float(np.log(n / max(total, 1))) for w, n in counts.items() if len(w) > 1 or n > total / 100}, float(total)), rarer


_RARER = "array<struct<word:string,log:double>>"


def with_rarer(texts: DataFrame, rarer: DataFrame) -> DataFrame:
    """``texts(text, n)``, all distinct, with ``rarer``: all words of the table ``rarer(word, log)`` inside their names."""
    of_text = texts.select("text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("name"))
    starts = of_text.select("name").distinct().select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    lengths = starts.select("name", "at", F.explode(F.expr(f"sequence(1, least({LONGEST}, length(name) - at + 1))")).alias("size"))
    inside = lengths.select("name", F.expr("substr(name, at, size)").alias("word")).join(rarer, "word").groupBy("name").agg(F.collect_set(F.struct("word", "log")).alias("own"))
    found = of_text.join(inside, "name").groupBy("text").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("rarer"))
    return texts.join(found, "text", "left")


def _rarer_of(batch: pa.RecordBatch) -> list[list[tuple[str, float]] | None]:
    return [r and [(x["word"], x["log"]) for x in r] for r in batch.column("rarer").to_pylist()]


def _class_rows(batches: Iterator[pa.RecordBatch], segmenter, seeds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[str]] = {}
    for batch in by_bytes(batches, "text"):
        counts: Counter[tuple[bool, str]] = Counter()
        for text, rarer, n in zip(batch.column("text").to_pylist(), _rarer_of(batch), batch.column("n").to_pylist(), strict=True):
            marked = not seeds.isdisjoint(_NAME.findall(text))
            counts[marked, "*"] += n  # the class itself; no word has this spelling
            for w in segmenter.value.words(text, known, rarer):
                counts[marked, w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for _, w in counts], pa.string()), pa.array([m for m, _ in counts], pa.bool_()), pa.array(counts.values(), pa.int64())], ["word", "marked", "n"])


def learn_classes(urls: DataFrame, segmenter, seeds=SEEDS) -> tuple[Bayes, DataFrame]:
    """Naive Bayes over the segmented words of all ``urls(text, rarer, n)``; a url with a seed word standing on its own is unwanted.

    The model holds the words that reach the share and the seed words; the others come as a table (word, odds).
    """
    rows = urls.mapInArrow(partial(_class_rows, segmenter=segmenter, seeds=frozenset(seeds)), "word string, marked boolean, n long")
    counts = stored(rows.groupBy("word").agg(F.sum(F.when(F.col("marked"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(~F.col("marked"), F.col("n")).otherwise(0)).alias("good")))
    totals = counts.where("word <> '*'").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
    bad, good, size = totals.bad or 0, totals.good or 0, totals.words
    frequent = (F.col("bad") + F.col("good") >= SHARE * (bad + good)) | F.col("word").isin("*", *seeds)
    kept = {r.word: (r.bad, r.good) for r in counts.where(frequent).collect()}
    rows_bad, rows_good = kept.pop("*", (0, 0))
    odds = {w: float(np.log((b + 1) / (bad + size + 1)) - np.log((g + 1) / (good + size + 1))) for w, (b, g) in kept.items()}
    rest = counts.where(~frequent).select("word", (F.log((F.col("bad") + 1) / (bad + size + 1)) - F.log((F.col("good") + 1) / (good + size + 1))).alias("odds"))
    return Bayes(float(np.log((rows_bad + 1) / (rows_good + 1))), odds), rest


def _score_rows(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Per text a row (no word) with what the model's words give, and a row for each distinct other word of it."""
    segmenter, bayes = models.value
    known: dict[str, list[str]] = {}
    for batch in by_bytes(batches, "text"):
        out = []
        for text, rarer in zip(batch.column("text").to_pylist(), _rarer_of(batch), strict=True):
            words = segmenter.words(text, known, rarer)
            out.append((text, None, bayes.score(words)))
            out += [(text, w, float(n)) for w, n in Counter(w for w in words if w not in bayes.odds).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], ["text", "word", "n"])


def _verdict_rows(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    segmenter, bayes = models.value
    known: dict[str, list[str]] = {}
    for batch in by_bytes(batches, "path"):
        texts = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
        blocked = [bayes.score(segmenter.words(f"{host} {path}".lower(), known)) > 0 for host, path in texts]
        yield batch.append_column("blocked", pa.array(blocked, pa.bool_()))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url, a row per row of ``pages(page_id, url, html)``.

    The longest rule that fits decides; else the words do: names in host and path are split by unigram Viterbi and
    scored by naive Bayes. Both models count all rows and use all counts; words above a share of the counts are broadcast,
    and urls meet the others in joins where there are any.
    Null urls and urls without ``://`` have an empty host and path, no rule, and the verdict of the classes' sizes.
    Null ids and repeated rows pass through; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = parts_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    segmenter, rarer = learn_words(pages.select("url", "html"), seeds)
    text = F.lower(F.concat_ws(" ", "host", "path"))
    names, split = rows.select(text.alias("text")), spark.sparkContext.broadcast(segmenter)
    cut = not rarer.isEmpty()
    if cut:
        each = stored(with_rarer(names.groupBy("text").agg(F.count("*").alias("n")), rarer))
    else:
        each = names.select("text", F.lit(None).cast(_RARER).alias("rarer"), F.lit(1).cast("long").alias("n"))
    bayes, rest = learn_classes(each, split, seeds)
    models = spark.sparkContext.broadcast((segmenter, bayes))
    if cut or not rest.isEmpty():
        each = each if cut else names.distinct().select("text", F.lit(None).cast(_RARER).alias("rarer"))
        found = each.select("text", "rarer").mapInArrow(partial(_score_rows, models=models), "text string, word string, n double")
        met = found.where("word IS NOT NULL").join(rest, "word").select("text", (F.col("n") * F.col("odds")).alias("n"))
        scores = found.where("word IS NULL").select("text", "n").unionByName(met).groupBy("text").agg((F.sum("n") > 0).alias("blocked"))
        judged = rows.withColumn("text", text).join(scores, "text").drop("text")
    else:
        judged = rows.mapInArrow(partial(_verdict_rows, models=models), "page_id long, host string, path string, blocked boolean")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
