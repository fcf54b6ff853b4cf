"""Language-model scoring with a probabilistic suffix tree over words (operator 9)."""

from __future__ import annotations

import gc
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.quality import held_out
from rollcall.llm.shared import stored
from rollcall.llm.words import _BASE, PIECE_BYTES, by_bytes, hand_back, hash_piece, hash_shingles, hash_words, mix64

#: Words, and runs of words of one length, that every task knows have at least this share of all training tokens, so there
#: are at most 500,000. A shortcut only: the others meet their values in joins, and scores do not depend on it.
COMMON = 2e-6
#: Cuts of the tree that ``learn`` holds in memory; ``score`` does not use them.
CONTEXT, FOLLOWING = 5e-5, 2e-6
#: Next symbols that a context keeps a probability of its own for follow it at least so often.
FOLLOWING_COUNT = 2
#: Longest context in words, up to ``DEPTH_TOKENS`` training tokens; one word more for each hundredfold of them.
DEPTH, DEPTH_TOKENS = 2, 10**9
#: A context stays if its next-symbol distribution diverges from its suffix's by this many nats per occurrence.
DIVERGENCE = 0.02
#: Taken off each kept count and left to the suffix.
DISCOUNT = 0.5

#: Bits of a sketch of runs: so many for each training token, and their logarithm at least and at most (32 MB); bits of a part of it.
SKETCH, LEAST_BITS, MOST_BITS, PART_BITS = 8, 10, 28, 22
#: Training tokens, as a power of two, for each bucket of run counts and of values, and buckets at least.
COUNT_BUCKET, VALUE_BUCKET, BUCKETS = 19, 24, 32

SLICE_BYTES = 8 << 20
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z), then the end token, which no word equals."""
    return [*(text or "").encode().lower().split(), END]


@dataclass
class Level:
    """Contexts of one length: a context is (index of its first words among the shorter ones, last word)."""

    codes: np.ndarray  # sorted prefix * width + last symbol
    suffix: np.ndarray  # index of the context without its first word, one level up; -1 at the first level
    kept: np.ndarray  # whether the divergence test retains it
    backoff: np.ndarray  # log10 of the factor that unkept next symbols have on the suffix's probability
    pair_codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted context * width + next symbol
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the kept probability over the root's
    probabilities: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """The root's counts of common words, and the levels below it."""

    ids: dict[bytes, int]  # by falling count; the first ``width`` - 1 are symbols, the end token among them
    logs: np.ndarray  # log10 of the root's probability of each common word
    width: int
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))

    def states(self, ids: np.ndarray) -> list[np.ndarray]:
        """For every position and context length the context that ends there, or -1."""
        symbols = np.where(ids < self.width - 1, ids, -1)
        out: list[np.ndarray] = []
        for depth, level in enumerate(self.levels):
            before = np.concatenate(([-1], out[-1][:-1])) if depth else np.zeros(ids.size, np.int64)
            codes = np.where((before >= 0) & (symbols >= 0), before * self.width + symbols, -1)
            out.append(_find(level.codes, codes))
        return out

    def gain(self, ids: np.ndarray) -> np.ndarray:
        """Per position the log10 of the tree's probability over the root's, from the longest kept context before it."""
        total, open_ = np.zeros(ids.size), np.ones(ids.size, bool)
        states = self.states(ids)
        for level, ends in zip(self.levels[::-1], states[::-1], strict=True):
            context = np.concatenate(([-1], ends[:-1]))
            at = np.flatnonzero(open_ & (context >= 0))
            at = at[level.kept[context[at]]]
            codes = np.where((ids[at] >= 0) & (ids[at] < self.width - 1), context[at] * self.width + ids[at], -1)
            found = _find(level.pair_codes, codes)
            hit = found >= 0
            total[at[hit]] += level.gains[found[hit]]
            total[at[~hit]] += level.backoff[context[at[~hit]]]
            open_[at[hit]] = False
        return total


def _find(haystack: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Index of every code in a sorted array, -1 where it is missing."""
    if not haystack.size:
        return np.full(codes.size, -1)
    at = np.minimum(np.searchsorted(haystack, codes), haystack.size - 1)
    return np.where((codes >= 0) & (haystack[at] == codes), at, -1)


# --- counting ---------------------------------------------------------------------------------------------------------


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        counts: Counter[bytes] = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each token occurs in all of ``docs``; the end token is the empty word."""
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_word_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def root(counts: DataFrame) -> Tree:
    """The root of the tree: the common words of ``counts(word, n)`` with their probabilities, and the totals of all words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.where((F.col("n") >= COMMON * total) | (F.col("word") == END)).toArrow()
    pairs = sorted(zip(common.column("word").to_pylist(), common.column("n").to_pylist(), strict=True), key=lambda p: (p[0] != END, -p[1], p[0]))
    logs = np.log10((np.array([n for _, n in pairs], float) + 1) / (total + distinct + 1)) if pairs else np.zeros(0)
    symbols = sum(n >= CONTEXT * total or w == END for w, n in pairs)
    return Tree({w: i for i, (w, _) in enumerate(pairs)}, logs, symbols + 1, total, distinct)


def _joined(tree: Tree, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of the tokens of several texts, each text after a -1, the number of tokens of each text, and the tokens."""
    words = [tokens(t) for t in texts]
    parts = [p for w in words for p in (np.array([-1]), tree.encode(w))]
    return np.concatenate(parts), np.array([len(w) for w in words]), words


def _next_rows(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    tree = tree.value
    for batch in by_bytes(batches, "text", SLICE_BYTES // 4):
        ids, sizes, _ = _joined(tree, batch.column("text").to_pylist())
        ends = tree.states(ids)[-1]
        context = np.concatenate(([-1], ends[:-1]))
        context[np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))] = -1  # the mark before a text follows nothing
        at = np.flatnonzero(context >= 0)
        following = np.where((ids[at] >= 0) & (ids[at] < tree.width - 1), ids[at], tree.width - 1)
        codes, counts = np.unique(context[at] * tree.width + following, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])


def learn(docs: DataFrame, counts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> Tree:
    """Grows a tree in memory from all of ``docs`` and their ``counts(word, n)``, one length of contexts after the other.

    What comes to the driver is bounded by the shares above, so on large corpora this is a part of the tree; ``grown``
    keeps all of it in tables. On corpora of under 40,000 tokens both are the same.
    """
    spark = docs.sparkSession
    tree = root(counts)
    total, symbols = tree.total, tree.width - 1
    codes, suffix = np.arange(1, symbols), np.full(max(symbols - 1, 0), -1)  # nothing follows the end token
    for length in range(1, depth + 1):
        if not codes.size:
            break
        level = Level(codes, suffix, np.zeros(codes.size, bool), np.zeros(codes.size))
        tree.levels.append(level)
        shared = spark.sparkContext.broadcast(tree)
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
        found = texts.mapInArrow(partial(_next_rows, tree=shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        found = stored(found)
        sums = found.groupBy(F.expr(f"code div {tree.width}").alias("context")).agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros(codes.size, np.int64)
        seen[sums.column("context").to_numpy()] = sums.column("n").to_numpy()
        least = max(FOLLOWING_COUNT, FOLLOWING * total)
        table = found.where((F.col("n") >= least) & (F.col("code") % tree.width < tree.width - 1)).orderBy("code").toArrow()
        _settle(tree, level, seen, table.column("code").to_numpy().copy(), table.column("n").to_numpy().copy(), divergence)
        shared.unpersist()
        frequent = table.column("n").to_numpy() >= max(FOLLOWING_COUNT, CONTEXT * total)
        codes = table.column("code").to_numpy()[frequent]
        codes = codes[codes % tree.width > 0]
        above = level.suffix[codes // tree.width]  # the context without its first word, then the same last word
        suffix = _find(level.codes, codes % tree.width) if length == 1 else _find(level.codes, np.where(above >= 0, above * tree.width + codes % tree.width, -1))
    return tree


def _settle(tree: Tree, level: Level, seen: np.ndarray, codes: np.ndarray, counts: np.ndarray, divergence: float) -> None:
    """Smoothed distributions of a level's contexts, and which of them stay."""
    context, following = codes // tree.width, codes % tree.width
    up = tree.levels[-2] if len(tree.levels) > 1 else None
    parent = _suffix_log10(tree, up, level.suffix[context], following)
    chance = np.maximum(counts - DISCOUNT, 0) / np.maximum(seen[context], 1)
    kept_mass = np.bincount(context, chance, seen.size)
    parent_mass = np.minimum(np.bincount(context, 10**parent, seen.size), 1 - 1e-9)
    rest = np.maximum(1 - kept_mass, 1e-9)
    level.backoff = np.log10(rest / (1 - parent_mass))
    gap = np.bincount(context, chance * (np.log(chance) - parent * np.log(10)), seen.size) + rest * level.backoff * np.log(10)
    level.kept = (seen > 0) & (gap >= divergence)
    if up is not None:
        level.kept &= (level.suffix >= 0) & up.kept[level.suffix]
    level.pair_codes, level.probabilities = codes, chance
    level.gains = np.log10(chance) - tree.logs[following]


def _suffix_log10(tree: Tree, level: Level | None, context: np.ndarray, following: np.ndarray) -> np.ndarray:
    """log10 of the probability that a context, or the root, gives to a next symbol."""
    out = tree.logs[following].copy()
    depth = tree.levels.index(level) if level is not None else -1
    here, open_ = context.copy(), np.ones(context.size, bool)
    while depth >= 0:
        at = np.flatnonzero(open_ & (here >= 0))
        at = at[tree.levels[depth].kept[here[at]]]
        found = _find(tree.levels[depth].pair_codes, here[at] * tree.width + following[at])
        hit = found >= 0
        out[at[hit]] += tree.levels[depth].gains[found[hit]]
        out[at[~hit]] += tree.levels[depth].backoff[here[at[~hit]]]
        open_[at[hit]] = False
        here = np.where(here >= 0, tree.levels[depth].suffix[here], -1)
        depth -= 1
    return out


# --- the whole tree in tables -----------------------------------------------------------------------------------------
#
# A run of k + 1 tokens is a context of k words and its next symbol; tables name it by a 64-bit hash. Of a run, ``context``
# lacks the last token and ``suffix`` the first.


END_HASH = np.uint64(0x5851F42D4C957F2D)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, the end tokens among them, and the number of tokens of each text."""
    out, sizes, held, size = [np.zeros(0, np.uint64)], [], [], 0

    def flush():
        whole = b" ".join(held)
        if whole:
            out.append(hash_piece(whole)[0] if len(whole) < 4 * PIECE_BYTES else hash_words(whole.split(b" ")))
        held.clear()

    for text in texts:
        line = b" ".join(text.encode().lower().split())
        sizes.append(line.count(b" ") + 1 if line else 0)
        if line:
            held.append(line)
            size += len(line)
        if size >= PIECE_BYTES:
            flush()
            size = 0
    flush()
    sizes = np.array(sizes, np.int64)
    return np.insert(np.concatenate(out), np.cumsum(sizes), END_HASH), sizes + 1


def _runs(texts: list[str], widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width the hashes of all runs of so many tokens that stay in their text, where they begin, and each token's text."""
    hashes, sizes = _hashes(texts)
    of = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    for width in widths:
        at = _inside(of, width)
        yield (hash_shingles(hashes, width)[at] if at.size else np.zeros(0, np.uint64)), at, of


def _inside(of: np.ndarray, width: int) -> np.ndarray:
    """Where a run of ``width`` tokens begins that ends in the same text."""
    return np.flatnonzero(of[: max(0, of.size - width + 1)] == of[width - 1 :])


# A sketch is a bitmap over the first bits of run hashes, one that fits into every task. It has all runs that it must have and, by
# chance, others: those only cost work. It keeps runs that no other text holds out of the shuffles.


def sketch_bits(total: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (SKETCH * max(total, 1)).bit_length() - 1))


def _places(runs: np.ndarray, bits: int) -> np.ndarray:
    return (runs.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint32)


def _in_sketch(runs: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    at = _places(runs, (sketch.size * 8).bit_length() - 1)
    return (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _place_rows(places: np.ndarray, twice: bool, bits: int) -> pa.RecordBatch:
    """Sorted places without repeats, the steps between them packed, one row per part of the sketch."""
    low = min(bits, PART_BITS)
    cuts = np.searchsorted(places, np.arange(0, (1 << bits) + 1, 1 << low))
    parts = np.flatnonzero(cuts[1:] > cuts[:-1])
    packed = [zlib.compress(np.diff(places[cuts[k] : cuts[k + 1]] & np.uint32((1 << low) - 1), prepend=np.uint32(0)).tobytes(), 1) for k in parts]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([twice] * parts.size, pa.bool_()), pa.array(packed, pa.binary())], ["part", "twice", "places"])


def _text_places(batches: Iterator[pa.RecordBatch], widths: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """The places of all runs, and of those that occur twice in a slice."""
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        places = np.sort(np.concatenate([_places(run, bits) for run, _, _ in _runs(batch.column("text").to_pylist(), widths)]))
        again = np.concatenate(([False], places[1:] == places[:-1])) if places.size else np.zeros(0, bool)
        yield _place_rows(places[~again], False, bits)
        yield _place_rows(np.unique(places[again]), True, bits)
        del places, again
        hand_back()


def _value_places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _place_rows(np.unique(_places(batch.column("run").to_numpy(), bits)), True, bits)


def _part_bits(low: int, rows: pa.Table) -> pa.Table:
    """The places of one part that occur twice, as bits."""
    seen, twice = np.zeros(1 << low, bool), np.zeros(1 << low, bool)
    for two, packed in zip(rows.column("twice"), rows.column("places")):
        at = np.cumsum(np.frombuffer(zlib.decompress(packed.as_py()), np.uint32), dtype=np.uint32)
        if two.as_py():
            twice[at] = True
        else:
            twice[at] |= seen[at]
            seen[at] = True
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})


def sketch(places: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the places that occur in two rows, or in one that says ``twice``."""
    low = min(bits, PART_BITS)
    parts = places.groupBy("part").applyInArrow(lambda rows: _part_bits(low, rows), "part int, bits binary").toArrow()
    out = np.zeros((1 << bits - low, 1 << low - 3), np.uint8)
    for part, packed in zip(parts.column("part").to_pylist(), parts.column("bits")):
        out[part] = np.frombuffer(packed.as_buffer(), np.uint8)
    return out.reshape(-1)


PLACES = "part int, twice boolean, places binary"


# What runs have to tell travels packed, sorted by run: a row per slice of texts and bucket of runs, a bucket being a range of hashes.


def _packed(sorted_: np.ndarray) -> bytes:
    """Steps between sorted numbers, in as many bytes as the largest takes, their number in front."""
    steps = np.diff(sorted_, prepend=np.uint64(0)).astype(np.uint64)
    wide = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + sorted_[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide, body = packed[0], np.frombuffer(packed, np.uint8)
    steps = np.zeros(((body.size - 9) // wide + 1, 8), np.uint8)
    steps[0], steps[1:, :wide] = body[1:9], body[9:].reshape(-1, wide)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers over zero in as few bytes as the largest takes, packed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(numbers.max(initial=0)) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(numbers.astype(kind).tobytes(), 1)


def _unsmall(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"u{packed[0]}").astype(np.int64)


def _cuts(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted runs, and the end."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(runs, edges), runs.size)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    differs = np.zeros(columns[0].size, bool)
    differs[:1] = True
    for column in columns:
        differs[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(differs)


COUNTS = "bucket int, runs binary, first binary, last binary, n binary"


def _run_rows(batches: Iterator[pa.RecordBatch], width: int, repeated, buckets: int) -> Iterator[pa.RecordBatch]:
    """The runs of a slice that may occur twice, how often they do, and their last words; their first words if they are over two."""
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        hashes, sizes = _hashes(batch.column("text").to_pylist())
        at = _inside(np.repeat(np.arange(sizes.size, dtype=np.int32), sizes), width)
        if not at.size:
            continue
        run = hash_shingles(hashes, width)[at]
        may = _in_sketch(run, repeated.value)
        run, at = run[may], at[may]
        order = np.argsort(run)
        run, at = run[order], at[order]
        first = _heads(run)
        n, run, at = np.diff(np.append(first, run.size)), run[first], at[first]
        cuts, rows = _cuts(run, buckets), []
        for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]):
            part = slice(cuts[bucket], cuts[bucket + 1])
            rows.append((int(bucket), _packed(run[part]), hashes[at[part]].tobytes() if width > 2 else b"", hashes[at[part] + width - 1].tobytes(), _small(n[part])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))] if rows else [
            pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 4], ["bucket", "runs", "first", "last", "n"])
        del hashes, run, at, may, order, first, n, rows
        hand_back()


def _unmix64(x: np.ndarray) -> np.ndarray:
    """Undoes ``mix64``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _counting(width: int):
    return lambda rows: _counted(rows, width)


def _counted(rows: pa.Table, width: int) -> pa.Table:
    """(run, context, suffix, n) of the runs of a bucket that occur ``FOLLOWING_COUNT`` times."""
    columns = {c: [x.as_py() for x in rows.column(c)] for c in ("runs", "first", "last", "n")}
    run, n = np.concatenate([_unpacked(x) for x in columns["runs"]]), np.concatenate([_unsmall(x) for x in columns["n"]])
    order = np.argsort(run)
    run = run[order]
    heads = _heads(run)
    n = np.add.reduceat(n[order], heads)
    stays = n >= FOLLOWING_COUNT
    run, n, at = run[heads][stays], n[stays], order[heads][stays]
    last = np.frombuffer(b"".join(columns["last"]), np.uint64)[at]
    total = _unmix64(run) - np.uint64(width)
    above = (total - last) * np.uint64(pow(_BASE, -1, 1 << 64))
    first = np.frombuffer(b"".join(columns["first"]), np.uint64)[at] if width > 2 else above
    below = total - first * np.uint64(pow(_BASE, width - 1, 1 << 64))
    context, suffix = (mix64(x + np.uint64(width - 1)).view(np.int64) for x in (above, below))
    return pa.table({"run": run.view(np.int64), "context": context, "suffix": suffix, "n": n})


def _free(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, and lets Spark remove the shuffles of plans that nobody holds any more."""
    spark = tables[0].sparkSession
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("rollcall-"):
                place = spark._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _sweep(spark)


def _sweep(spark) -> None:
    """Spark keeps the plan that ran last, so another one runs first."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark._jvm.System.gc()


def _root_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        ends = np.array([w == END for w in words], bool)
        hashes = np.full(len(words), END_HASH)
        hashes[~ends] = hash_words([w for w in words if w != END])
        yield pa.RecordBatch.from_arrays([pa.array(hash_shingles(hashes, 1).view(np.int64)), batch.column("n")], ["run", "n"])


def grown(docs: DataFrame, counts: DataFrame, size: int, depth: int, divergence: float = DIVERGENCE) -> DataFrame:
    """(run, value, n): what each occurrence of a run adds to the log10 probability of its text.

    Grows the tree on all of ``docs`` from their ``counts(word, n)``, whose add-one denominator is ``size``. Every run that
    occurs ``FOLLOWING_COUNT`` times is counted and every context that passes the divergence test stays, in tables that
    grow with the corpus. The value of a kept context is the factor it has on what its suffix gives to any next
    symbol; that of a run whose context is kept turns this factor and the suffix's probability into its own.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    spark, widths, bits = docs.sparkSession, list(range(2, depth + 2)), sketch_bits(size)
    repeated = spark.sparkContext.broadcast(sketch(texts.mapInArrow(partial(_text_places, widths=widths, bits=bits), PLACES), bits))
    _sweep(spark)
    buckets = max(BUCKETS, size >> COUNT_BUCKET)
    above = stored(counts.mapInArrow(_root_rows, "run long, n long").selectExpr("run", "n", f"log10((n + 1) / {float(size)}D) AS p", "CAST(NULL AS BIGINT) AS suffix"))
    kept_above, values = None, []
    for width in widths:
        packed = texts.mapInArrow(partial(_run_rows, width=width, repeated=repeated, buckets=buckets), COUNTS)
        found = stored(packed.groupBy("bucket").applyInArrow(_counting(width), "run long, context long, suffix long, n long"))
        _sweep(spark)
        before = above
        rows = stored(found.join(above.select(F.col("run").alias("suffix"), F.col("p").alias("parent")), "suffix"))
        _free(found)
        part = F.col("n") - F.lit(DISCOUNT)
        sums = rows.groupBy("context").agg(
            F.sum(part).alias("mass"), F.sum(part * (F.log(part) - F.col("parent") * np.log(10).item())).alias("gap"), F.sum(F.pow(F.lit(10.0), "parent")).alias("taken"))
        own = above.select(F.col("run").alias("context"), F.col("n").alias("seen"), F.col("suffix").alias("shorter"))
        tests = sums.join(own, "context").withColumn("rest", F.greatest(1 - F.col("mass") / F.col("seen"), F.lit(1e-9)))
        tests = tests.withColumn("backoff", F.log10(F.col("rest") / (1 - F.least("taken", F.lit(1 - 1e-9)))))
        tests = tests.where((F.col("gap") - F.col("mass") * F.log("seen")) / F.col("seen") + F.col("rest") * F.col("backoff") * np.log(10).item() >= divergence)
        if kept_above is not None:
            tests = tests.join(kept_above.select(F.col("context").alias("shorter")), "shorter", "left_semi")
        kept = stored(tests.select("context", "seen", "backoff"))
        chance = F.log10(part / F.col("seen"))
        judged = rows.join(kept, "context", "left")
        judged = judged.select("run", "n", F.coalesce(chance, "parent").alias("p"), "suffix", F.coalesce(chance - F.col("parent") - F.col("backoff"), F.lit(0.0)).alias("value"))
        own = stored(judged.where("value <> 0").select("run", "value", "n") if width == widths[-1] else judged)
        values += [kept.select(F.col("context").alias("run"), F.col("backoff").alias("value"), F.col("seen").alias("n")), own.where("value <> 0").select("run", "value", "n")]
        kept_above, above = kept, own.drop("value")
        _free(rows, *([before] if width == widths[0] else []))
    repeated.destroy()
    every = values[0]
    for more in values[1:]:
        every = every.unionByName(more)
    out = stored(every.groupBy("run").agg(F.sum("value").alias("value"), F.max("n").alias("n")))
    _free(*values)
    return out


GAINS = "bucket int, kind int, runs binary, at binary, n binary, rows binary, amounts binary"


def _gain_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "kind", "runs", "at", "n", "rows", "amounts"])


def _value_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs with their values (kind 0)."""
    for batch in batches:
        run, value = batch.column("run").to_numpy().view(np.uint64), batch.column("value").to_numpy()
        order = np.argsort(run)
        run, value = run[order], value[order]
        cuts = _cuts(run, buckets)
        yield _gain_batch([
            (int(b), 0, _packed(run[cuts[b] : cuts[b + 1]]), b"", b"", b"", value[cuts[b] : cuts[b + 1]].tobytes()) for b in np.flatnonzero(cuts[1:] > cuts[:-1])])


def _text_rows(batches: Iterator[pa.RecordBatch], widths: list[int], frequent, buckets: int) -> Iterator[pa.RecordBatch]:
    """What frequent runs add to each document (kind 2), and how often it holds each other run that may have a value (kind 1)."""
    known, values, valued = frequent.value
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        rows = batch.column("row").to_numpy()
        gain = np.zeros(rows.size)
        runs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for run, at, of in _runs(batch.column("text").to_pylist(), widths):
            may = _in_sketch(run, valued)
            run, doc = run[may], of[at[may]]
            found = _find_signed(known, run.view(np.int64))
            hit = found >= 0
            if hit.any():
                gain += np.bincount(doc[hit], values[found[hit]], rows.size)
            runs.append(run[~hit])
            docs.append(doc[~hit])
        run, doc = np.concatenate(runs), np.concatenate(docs)
        order = np.lexsort((doc, run))
        run, doc = run[order], doc[order]
        first = _heads(run, doc)
        n, run, doc = np.diff(np.append(first, run.size)), run[first], doc[first]
        cuts, out = _cuts(run, buckets), []
        for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]):
            part = slice(cuts[bucket], cuts[bucket + 1])
            held, place = np.unique(doc[part], return_inverse=True)
            out.append((int(bucket), 1, _packed(run[part]), _small(place), _small(n[part]), rows[held].tobytes(), b""))
        yield _gain_batch(out)
        if rows.size:
            yield _gain_batch([(int(rows[0] % buckets), 2, b"", b"", b"", rows.tobytes(), gain.tobytes())])
        del runs, docs, run, doc, order, first, n, out
        hand_back()


def _gained(rows: pa.Table) -> pa.Table:
    """(row, gain) of a bucket: values meet the runs of the documents."""
    kinds = np.array(rows.column("kind"))
    cell = lambda name, i: rows.column(name)[int(i)].as_py()
    known, values = np.zeros(0, np.uint64), np.zeros(0)
    if (kinds == 0).any():
        known = np.concatenate([_unpacked(cell("runs", i)) for i in np.flatnonzero(kinds == 0)])
        order = np.argsort(known)
        known, values = known[order], np.concatenate([np.frombuffer(cell("amounts", i)) for i in np.flatnonzero(kinds == 0)])[order]
    ids, gains_ = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in np.flatnonzero(kinds == 2):
        ids.append(np.frombuffer(cell("rows", i), np.int64))
        gains_.append(np.frombuffer(cell("amounts", i)))
    for i in np.flatnonzero(kinds == 1) if known.size else []:
        held, run = np.frombuffer(cell("rows", i), np.int64), _unpacked(cell("runs", i))
        found = _find_signed(known, run)
        hit = found >= 0
        gain = np.bincount(_unsmall(cell("at", i))[hit], _unsmall(cell("n", i))[hit] * values[found[hit]], held.size)
        ids.append(held[gain != 0])
        gains_.append(gain[gain != 0])
    return pa.table({"row": np.concatenate(ids), "gain": np.concatenate(gains_)})


def _find_signed(haystack: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of every key, of any sign, in a sorted array, -1 where it is missing."""
    if not haystack.size:
        return np.full(keys.size, -1)
    at = np.minimum(np.searchsorted(haystack, keys), haystack.size - 1)
    return np.where(haystack[at] == keys, at, -1)


def gains(texts: DataFrame, values: DataFrame, total: int, depth: int) -> DataFrame:
    """(row, gain), several rows each: what the tree changes in the log10 probability of ``texts(row, text)``."""
    bits = sketch_bits(total)
    valued = sketch(values.select("run").mapInArrow(partial(_value_places, bits=bits), PLACES), bits)
    _sweep(texts.sparkSession)
    table = values.where(F.col("n") >= COMMON * total).orderBy("run").select("run", "value").toArrow()
    shared = texts.sparkSession.sparkContext.broadcast((table.column("run").to_numpy().copy(), table.column("value").to_numpy().copy(), valued))
    buckets = max(BUCKETS, total >> VALUE_BUCKET)
    found = texts.mapInArrow(partial(_text_rows, widths=list(range(1, depth + 2)), frequent=shared, buckets=buckets), GAINS)
    rare = values.where(F.col("n") < COMMON * total).select("run", "value").mapInArrow(partial(_value_rows, buckets=buckets), GAINS)
    return found.unionByName(rare).groupBy("bucket").applyInArrow(_gained, "row long, gain double")


# --- scoring ----------------------------------------------------------------------------------------------------------

_PARTS = "word binary, row long, doc_id long, n long, copies int, tokens long, known long, base double"
_PARTS_ARROW = pa.schema([
    ("word", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("copies", pa.int32()),
    ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
])


def _part_rows(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    """Per document what the common words give, and a row for each distinct other word of it."""
    tree = tree.value
    for batch in by_bytes(batches, "text"):
        rows, docs = batch.column("row"), batch.column("doc_id")
        ids, sizes, words = _joined(tree, batch.column("text").to_pylist())
        of = np.repeat(np.arange(sizes.size), sizes + 1)
        known = ids >= 0
        base = np.bincount(of, np.where(known, tree.logs[ids] if tree.logs.size else 0.0, 0.0), sizes.size)
        marks = [b"\0" + r.to_bytes(8, "big", signed=True) for r in rows.to_pylist()]  # no word begins like this
        n = sizes.size
        yield pa.RecordBatch.from_arrays([
            pa.array(marks, pa.binary()), rows, docs, pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int32)), pa.array(sizes.astype(np.int64)),
            pa.array(np.bincount(of, known, n).astype(np.int64)), pa.array(base),
        ], schema=_PARTS_ARROW)
        rare_words, rare_rows, rare_counts = [], [], []
        get = tree.ids
        for row, own in zip(rows.to_pylist(), words, strict=True):
            rare = Counter([w for w in own if w not in get])
            rare_words += rare.keys()
            rare_counts += rare.values()
            rare_rows += [row] * len(rare)
        n = len(rare_words)
        zero, zeros = pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n))
        yield pa.RecordBatch.from_arrays([
            pa.array(rare_words, pa.binary()), pa.array(rare_rows, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rare_counts, pa.int64()),
            pa.array(np.zeros(n, np.int32)), zero, zero, zeros,
        ], schema=_PARTS_ARROW)


def depth_for(total: int) -> int:
    """Longest context for so many training tokens."""
    depth, reach = DEPTH, DEPTH_TOKENS
    while total >= reach:
        depth, reach = depth + 1, reach * 100
    return depth


def score(docs: DataFrame, parts: int = 7, part: int = 2, depth: int | None = None, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, a row per row.

    The tree learns from the documents that are not held out. ``base_score`` is the add-one unigram log10 probability;
    ``score`` adds what the longest kept contexts change. Words that are not common meet their counts in a join on the
    word, once per document, and so do runs of words that are not frequent with what they add. Null text counts as empty: only the end token. Null ids are not held out. Rows that repeat
    in id and text are scored once and repeated. Without training documents every token has probability one. An empty
    table gives no rows; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    training = own.where(~held_out(F.col("doc_id"), parts, part))
    counts = stored(word_counts(training))
    _sweep(docs.sparkSession)
    tree = root(counts)
    depth = depth_for(tree.total) if depth is None else depth
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    named = own.withColumn("row", F.xxhash64("doc_id", "text")).select("row", "doc_id", "text")
    pieces = named.mapInArrow(partial(_part_rows, tree=shared), _PARTS)
    rare = counts.where((F.col("n") < COMMON * tree.total) & (F.col("word") != END)).select("word", F.col("n").alias("c"))
    met = pieces.join(rare, "word", "left")
    size = tree.total + tree.distinct + 1
    chance = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(size)))
    based = met.select(
        "row", "doc_id", "copies", "tokens", (F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + chance).alias("base"), F.lit(0.0).alias("gain"))
    if depth > 0 and tree.total > 0:
        values = grown(training, counts, size, depth, **options)
        added = stored(gains(named.select("row", "text"), values, tree.total, depth).groupBy("row").agg(F.sum("gain").alias("gain")))
        _free(values)
        based = based.unionByName(added, allowMissingColumns=True)
    summed = based.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("copies", "tokens", "known", "base", "gain")])
    times = F.col("copies")
    each = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return each.select(
        "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"),
        (F.col("tokens") / times).cast("long").alias("n_tokens"), (F.col("known") / times).cast("long").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"), (F.col("base") / times).alias("base_score"),
        ((F.col("base") + F.col("gain")) / times).alias("score"),
    )
