"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import components, partitions, stored

LEAST = 0.93
#: Numbers in one tile; a tile of longer vectors has fewer rows.
TILE_NUMBERS = 1 << 18
#: Rows of one tile that meet the other tile at once.
STRIP = 256
#: Leading dimensions after which pairs that cannot reach the threshold are dropped.
STEPS = (8, 16, 32, 64, 128, 256, 512)
#: Room for rounding in bounds; pairs this near the threshold are decided on the vectors as given.
SLACK = 1e-7


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all: labelled, not null, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim in np.unique(batch.column("dim").to_numpy()).tolist():
            unit = _unit(_matrix(batch.filter(pa.array(batch.column("dim").to_numpy() == dim))))
            sums[dim] = sums.get(dim, 0) + unit.T @ unit
    for dim, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["dim", "i", "sums"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the axes of all unit vectors, the one with the most weight first; a square matrix each.

    Every task adds up its outer products; what comes to the driver is one matrix per length, whatever the row count.
    """
    parts = classes.select(F.col("dim").cast("long").alias("dim"), "vector").mapInArrow(_moment_rows, "dim long, i long, sums array<double>")
    totals = parts.select("dim", "i", F.posexplode("sums").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    dims, i, j, x = (totals.column(c).to_numpy() for c in ("dim", "i", "j", "x"))
    axes = {}
    for dim in np.unique(dims).tolist():
        moment = np.zeros((dim, dim))
        own = dims == dim
        moment[i[own], j[own]] = x[own]
        axes[dim] = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()
    return axes


def _leading_rows(batches: Iterator[pa.RecordBatch], axes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        first = np.zeros(batch.num_rows)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            first[own] = _unit(_matrix(batch.take(pa.array(own)))) @ axes.value[dim][:, 0]
        yield batch.append_column("lead", pa.array(first))


class Tile:
    """Unit vectors along the principal axes, with the norms of what follows each step."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.nodes, self.weights, self.given = nodes, weights, vectors
        self.rows = _unit(vectors) @ axes
        squares = np.cumsum((self.rows * self.rows)[:, ::-1], axis=1)[:, ::-1]
        self.stops = [*(s for s in STEPS if s < axes.shape[0]), axes.shape[0]]
        self.rest = [np.sqrt(squares[:, s]) if s < axes.shape[0] else np.zeros(len(nodes)) for s in self.stops]


def pairs_of(a: Tile, b: Tile, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs, strip by strip: products of the leading axes are added up while the rest, bounded by its norms, can still lift the cosine to ``least``."""
    for first in range(0, len(a.nodes), STRIP):
        strip = slice(first, first + STRIP)
        open_, done = None, 0
        sums = np.zeros((len(a.nodes[strip]), len(b.nodes)))
        for stop, rest_a, rest_b in zip(a.stops, a.rest, b.rest, strict=True):
            if open_ is None:
                sums += a.rows[strip, done:stop] @ b.rows[:, done:stop].T
                hopeful = sums + rest_a[strip, None] * rest_b >= least - SLACK
                if np.count_nonzero(hopeful) * 8 < hopeful.size or stop == a.stops[-1]:
                    i, j = np.nonzero(hopeful)
                    keep = first + i < j if same else np.ones(i.size, bool)
                    i, j = i[keep], j[keep]
                    open_ = first + i, j, sums[i, j]
            else:
                i, j, part = open_
                part = part + np.einsum("ij,ij->i", a.rows[i, done:stop], b.rows[j, done:stop])
                keep = part + rest_a[i] * rest_b[j] >= least - SLACK
                open_ = i[keep], j[keep], part[keep]
            done = stop
        i, j, part = open_
        near = np.flatnonzero(np.abs(part - least) <= 1e-6)
        if near.size:
            u, v = a.given[i[near]], b.given[j[near]]
            u, v = u / np.abs(u).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
            part[near] = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        keep = part >= least
        yield i[keep], j[keep]


def _merge(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the groups of all pairs in place; each group points to its smallest position."""
    while p.size:
        low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
        apart = low < high
        p, q, low, high = p[apart], q[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def _tile_rows(batches: Iterator[pa.RecordBatch], axes, least: float) -> Iterator[pa.RecordBatch]:
    """Reads pairs of tiles, sorted by pair; writes how many vectors each one links with, and links that join their groups."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(table: pa.Table):
        side, dim = table.column("side").to_numpy(), table.column("dim")[0].as_py()
        tiles = []
        for s in (0, 1):
            own = table.filter(pa.array(side == s)).combine_chunks()
            if own.num_rows:
                batch = own.to_batches()[0]
                tiles.append(Tile(batch.column("node").to_numpy(), batch.column("n").to_numpy(), _matrix(batch), axes.value[dim]))
        if len(tiles) < 2 and table.column("mixed")[0].as_py():
            return
        a, b = tiles[0], tiles[-1]
        nodes = a.nodes if a is b else np.concatenate((a.nodes, b.nodes))
        shift = 0 if a is b else len(a.nodes)
        weights = np.concatenate((a.weights, b.weights)) if shift else a.weights
        links, root = np.zeros(nodes.size, np.int64), np.arange(nodes.size)
        for i, j in pairs_of(a, b, least, a is b):
            j = j + shift
            links += np.bincount(i, weights[j], nodes.size).astype(np.int64) + np.bincount(j, weights[i], nodes.size).astype(np.int64)
            _merge(root, i, j)
        found = np.flatnonzero(links)
        if found.size:
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(links[found]), pa.array(nodes[root[found]])], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("pair").to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column("pair")[0].as_py() != keys[a]:
                yield from compare(pa.Table.from_batches(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from compare(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, least: float = LEAST, tile_numbers: int = TILE_NUMBERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors(vec_id, embedding, label)``.

    Two vectors link when their labels are equal and their cosine in double precision is ``least`` or more; vectors of
    different length do not. Equal vectors of a label are compared once and counted by number. The others are dealt to
    cells along the first principal axis, on which linked unit vectors lie at most sqrt(2 - 2 * least) apart, and to
    tiles of bounded size within a cell; only tiles of near cells meet. A tile pair gives one count and one link per
    vector at most, so dense groups are not written out as pairs.
    Vectors that are null, empty, zero, not finite, hold nulls or have no label link with nothing and stay. Null ids
    count as links of others but name no component. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label")
    rows = own.withColumn("node", F.when(usable(F.col("vector"), F.col("label")), F.xxhash64("label", "vector")))
    classes = stored(rows.where("node IS NOT NULL").groupBy("node", "label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("dim", F.size("vector")))
    axes = spark.sparkContext.broadcast(principal_axes(classes))
    width = (2 - 2 * least) ** 0.5 + SLACK
    led = classes.select("node", "label", F.col("dim").cast("long").alias("dim"), "n", "vector")
    schema = f"node long, label {dict(own.dtypes)['label']}, dim long, n long, vector {dict(own.dtypes)['vector']}, lead double"
    placed = stored(led.mapInArrow(partial(_leading_rows, axes=axes), schema).withColumn("cell", F.floor(F.col("lead") / F.lit(width))).drop("lead"))
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") * F.first("dim") / F.lit(tile_numbers)).alias("tiles"))
    beside = cells.select("label", "dim", F.col("cell").alias("cell2"), F.col("tiles").alias("tiles2"))
    partners = cells.join(beside, ["label", "dim"]).where(F.abs(F.col("cell") - F.col("cell2")) <= 1).groupBy("label", "dim", "cell").agg(
        F.first("tiles").alias("tiles"), F.collect_list(F.struct("cell2", "tiles2")).alias("near"))
    met = placed.join(partners, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.col("node"), F.col("tiles")))
    others = F.flatten(F.transform("near", lambda p: F.transform(F.sequence(F.lit(0).cast("long"), p.tiles2 - 1), lambda t: F.struct(p.cell2.alias("cell"), t.alias("tile")))))
    here = F.struct(F.col("cell").cast("long").alias("cell"), F.col("tile").cast("long").alias("tile"))
    dealt = met.select("node", "label", "dim", "n", "vector", here.alias("here"), F.explode(others).alias("there"))
    dealt = dealt.withColumn("there", F.struct(F.col("there.cell").cast("long").alias("cell"), F.col("there.tile").cast("long").alias("tile")))
    ahead = (F.col("here.cell") < F.col("there.cell")) | ((F.col("here.cell") == F.col("there.cell")) & (F.col("here.tile") <= F.col("there.tile")))
    left, right = F.when(ahead, F.col("here")).otherwise(F.col("there")), F.when(ahead, F.col("there")).otherwise(F.col("here"))
    pair = F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string"), left.cell.cast("string"), left.tile.cast("string"), right.cell.cast("string"), right.tile.cast("string"))
    keyed = dealt.select(pair.alias("pair"), "node", "n", "dim", "vector", F.when(ahead, 0).otherwise(1).alias("side"), (F.col("here") != F.col("there")).alias("mixed"))
    sorted_pairs = keyed.repartition(partitions(spark), "pair").sortWithinPartitions("pair", "side", "node")
    found = stored(sorted_pairs.mapInArrow(partial(_tile_rows, axes=axes, least=least), "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.selectExpr("node AS a", "other AS b"))
    named = classes.select("node", "n", "first").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.join(ids, "component").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("node IS NOT NULL").select("vec_id", "node").join(of_node, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
