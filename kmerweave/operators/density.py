"""Density clusters of vectors: the minimum spanning tree of mutual reachability, and its cuts.

The mutual reachability of two vectors is the largest of their distance and of both core
distances (to the ``samples``-th nearest vector, itself counted).  Vectors are dealt into
blocks around pivots; the distance of two blocks' pivots less their radii bounds that of
all their vectors from below, so only pairs of blocks that may hold a nearer vector than
the best one known are compared, and a block meets all those of a cell of a grid in one
product of matrices.  What that product may have chosen is measured again, exactly.

The tree grows by Boruvka's rounds: every component but the largest takes its lightest
edge to another one, so the rounds are about the logarithm of the vectors' number.  Ties
go to the smaller ids.
Cut at a distance, the tree falls into clusters; those of fewer than a least size are noise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from ._stage import Parts, counted, drop, staged
from .vectors import _usable

#: Vectors of a block, about; pivots at most (they and their distances are broadcast).
BLOCK, MOST_PIVOTS = 256, 1024
#: Components of the vectors on one side of a cell, about; distances of a product of matrices at most.
VALUES, TILE = 2**21, 2**21
#: Vectors whose distances bound those of a vector's neighbours before all are looked at.
FEW = 2048
#: Neighbours that the tree's rounds have listed, at least.
LISTED = 16
#: Edges of a round that the driver merges at most; more are merged by table joins.
DRIVER_EDGES = 100_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # differences rather than products, so equal vectors have distance 0 and both directions agree
    out = np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        out[i] = np.sqrt(((b - x) ** 2).sum(1))
    return out


def blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """id, v, block, pivot, away (distance to the pivot) of every usable vector, and the distances between pivots."""
    single = F.every(F.forall("v", lambda x: x == x.cast("float").cast("double")))
    rows, seen = counted(_usable(df, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "vectors", single=single)
    if not seen.n:
        return rows.select("id", "v", F.lit(0).alias("block"), F.lit(0).alias("pivot"), F.lit(0.0).alias("away")), np.zeros((0, 0))
    wanted = min(MOST_PIVOTS, -(-2 * seen.n // size))
    chosen = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])  # MOST_PIVOTS vectors at most
    shared = df.sparkSession.sparkContext.broadcast(chosen)
    # vectors that came in single precision travel in it; distances are of doubles
    kind = "array<float>" if seen.single else "array<double>"
    rows = rows.withColumn("v", F.col("v").cast(kind))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64), shared.value)
            at = d.argmin(1)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], ["id", "v", "pivot", "away"])

    near = staged(rows.mapInArrow(nearest, f"id long, v {kind}, pivot int, away double"), "near-pivots")
    # a cell of many vectors is several blocks
    parts = F.broadcast(near.groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")))  # MOST_PIVOTS rows at most
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("long")
    return staged(near.join(parts, "pivot").select("id", "v", "pivot", "away", (F.col("pivot") + part * F.lit(MOST_PIVOTS)).alias("block")), "blocks"), _distances(chosen, chosen)


def _packed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per block: its pivot, radius and the arrays of its vectors' columns, in order of id."""
    all_ = F.array_sort(F.collect_list(F.struct("id", "v", *columns)))
    whole = rows.groupBy("block").agg(F.first("pivot").alias("pivot"), F.max("away").alias("radius"), all_.alias("x"))
    return whole.select("block", "pivot", "radius", *(F.col(f"x.{c}").alias(c) for c in ("id", "v", *columns)))


class _Side:
    """Blocks of a table with one row per block: the matrix of their vectors and the columns beside it."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.pivot, self.radius = (rows.column(c).to_numpy() for c in ("pivot", "radius"))
        self.most = rows.column("most").to_numpy() if "most" in rows.column_names else None
        self.columns = {c: flat(c) for c in rows.column_names if c not in ("cell", "block", "pivot", "radius", "v", "most")}
        n = len(self.columns["id"])
        self.x = rows.column("v").combine_chunks().flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
        self.norm = (self.x**2).sum(1)
        # with a vector times -2, its norm and 1 that gives the square of a distance
        self.two = np.column_stack([self.x, np.ones(n), self.norm])
        self.sizes = np.diff(rows.column("id").combine_chunks().offsets.to_numpy())
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i] + self.sizes[i])


def _exact(one: np.ndarray, two: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows, from differences."""
    out, step = np.empty(len(row)), max(1, TILE // max(1, one.shape[1]))
    for lo in range(0, len(row), step):
        part = slice(lo, lo + step)
        out[part] = np.sqrt(((one[row[part]] - two[to[part]]) ** 2).sum(1))
    return out


def _crossed(one: DataFrame, two: DataFrame, apart: np.ndarray, find: Callable, none: pa.Table, schema: str) -> DataFrame:
    """What ``find`` tells of every block of ``one`` (with ``most``) and the vectors of ``two`` that may be as near as ``most``.

    Both sides are dealt out over the cells of a grid, in which every block of the one
    meets every block of the other.  So a block travels as often as the grid is wide, not
    once per pair of blocks, and a cell holds about ``VALUES`` components of each side.
    ``find`` takes both sides, the rows of a block, the rows it may be near to, and the
    squares of their distances, which are not exact, with their error; ``none`` is its table without rows.
    """
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("id")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size(F.col("v")[0])), F.lit(1)).alias("length")).first()
    a, b = size(one), size(two)
    side = max(BLOCK, VALUES // max(a.length, b.length))
    wide = max(-(-a.n // side), min(8, -(-a.n // 2048)), 1)
    high = max(-(-b.n // side), min(64 // wide, -(-b.n // 2048)), 1)
    flat = one.sparkSession.sparkContext.broadcast(apart)
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = one.withColumn("_other", each(high)).withColumn("cell", group(wide) * high + F.col("_other")).drop("_other")
    own = two.select(*(F.col(c).alias(c) for c in two.columns))  # both sides may come from one table
    right = own.withColumn("_other", each(wide)).withColumn("cell", F.col("_other") * high + group(high)).drop("_other")
    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and theirs.num_rows:
            x, y = _Side(mine), _Side(theirs)
            for i in range(mine.num_rows):
                ok = flat.value[x.pivot[i], y.pivot] - x.radius[i] - y.radius <= x.most[i] + 1e-9
                rows = x.of(i)
                to = np.flatnonzero(np.repeat(ok, y.sizes))
                if not len(to):
                    continue
                for lo in range(rows.start, rows.stop, max(1, TILE // len(to))):
                    part = slice(lo, min(rows.stop, lo + max(1, TILE // len(to))))
                    near, norm = (y.two, y.norm) if len(to) == len(y.x) else (y.two[to], y.norm[to])
                    square = np.column_stack([-2 * x.x[part], x.norm[part], np.ones(part.stop - part.start)]) @ near.T
                    out.append(find(x, y, part, to, square, 1e-10 * (x.norm[part].max() + norm.max()), x.most[i]))
        return pa.concat_tables(out) if out else none

    parts = 2 * wide * high
    dealt = lambda df: df.repartition(parts, "cell").groupBy("cell")
    return dealt(left).cogroup(dealt(right)).applyInArrow(met, schema)


def core_distances(rows: DataFrame, apart: np.ndarray, samples: int) -> DataFrame:
    """id, core: the distance to the ``samples``-th nearest vector, itself counted; that to the furthest where there are fewer."""
    return staged(neighbours(rows, apart, max(samples - 1, 1)).select("id", _core(samples).alias("core")), "core")


def _core(samples: int) -> Column:
    return F.when(F.size("near") == 0, 0.0).when(F.lit(samples < 2), 0.0).otherwise(F.element_at("near", F.least(F.size("near"), F.lit(max(samples - 1, 1))))["d"])


def neighbours(rows: DataFrame, apart: np.ndarray, k: int) -> DataFrame:
    """id, near: the ``k`` nearest other vectors as (d, id), in rising order; all others where there are fewer."""
    packed = staged(_packed(rows), "packed")
    schema = "id long, near array<struct<d: double, id: long>>"
    none = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))]).empty_table()

    def chosen(x: _Side, y: _Side, part: slice, to: np.ndarray, square: np.ndarray, error: float, most: float) -> pa.Table:
        ids, other = x.columns["id"][part], y.columns["id"][to]
        mine = np.minimum(np.searchsorted(ids, other), len(ids) - 1)  # a block's ids rise
        same = ids[mine] == other
        square[mine[same], np.flatnonzero(same)] = np.inf
        limit = np.full(len(ids), most**2 * (1 + 1e-9))
        if k <= square.shape[1]:  # the k-th of some bounds that of all
            some = square[:, : max(k, FEW)]
            limit = np.minimum(limit, np.partition(some, k - 1, axis=1)[:, k - 1])
        near = np.flatnonzero(square <= np.minimum(limit + 2 * error, np.finfo(float).max)[:, None])
        row, value = near // square.shape[1], square.ravel()[near]
        many = np.bincount(row, minlength=len(ids))
        if k < many.max():
            each = np.full((len(ids), many.max()), np.inf)
            each[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = value
            keep = value <= np.partition(each, k - 1, axis=1)[row, k - 1] + 2 * error
            row, near = row[keep], near[keep]
        at = near % square.shape[1]
        d = _exact(x.x[part], y.x, row, to[at])
        order = np.lexsort((other[at], d, row))
        row, at, d = row[order], at[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at, d = row[keep], at[keep], d[keep]
        ends = np.searchsorted(row, np.arange(len(ids) + 1))
        near = pa.StructArray.from_arrays([pa.array(d), pa.array(other[at])], names=["d", "id"])
        return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), near)], none.schema)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Side(pa.Table.from_batches([b]))
            for i in range(b.num_rows):
                part = x.of(i)
                d = np.sort(_distances(x.x[part], x.x[part]), axis=1)
                yield pa.record_batch([b.column("block").slice(i, 1), pa.array([d[:, k].max() if d.shape[1] > k else np.inf])], ["block", "most"])

    # the vectors of a block bound how far its neighbours may be
    most = staged(packed.mapInArrow(within, "block long, most double"), "bounds")
    found = _crossed(packed.join(most, "block"), packed, apart, chosen, none, schema)
    # at most k per vector and cell
    out = staged(found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "near")
    drop(packed, most)
    return out


def _lightest(open_: DataFrame, all_: DataFrame, apart: np.ndarray) -> DataFrame:
    """comp, weight, a, b: lightest edges to other components from the blocks ``open_`` to those of ``all_``, one per component and tile at most."""
    none = pa.schema([("comp", pa.int64()), ("weight", pa.float64()), ("a", pa.int64()), ("b", pa.int64())]).empty_table()

    def chosen(x: _Side, y: _Side, part: slice, to: np.ndarray, square: np.ndarray, error: float, most: float) -> pa.Table:
        ids, mine, own, upper = (x.columns[c][part] for c in ("id", "comp", "core", "upper"))
        other, theirs, core = (y.columns[c][to] for c in ("id", "comp", "core"))
        np.maximum(square, core**2, out=square)
        square[mine[:, None] == theirs] = np.inf
        least = np.minimum(np.maximum(square.min(1), own**2), upper**2 * (1 + 1e-9))
        row, at = np.nonzero(square <= np.minimum(least + 2 * error, np.finfo(float).max)[:, None])
        w = np.maximum(np.maximum(_exact(x.x[part], y.x, row, to[at]), own[row]), core[at])
        low, high = np.minimum(ids[row], other[at]), np.maximum(ids[row], other[at])
        order = np.lexsort((high, low, w, mine[row]))
        comp = mine[row][order]
        order = order[np.concatenate([[True], comp[1:] != comp[:-1]])] if len(comp) else order
        return pa.table([pa.array(mine[row][order]), pa.array(w[order]), pa.array(low[order]), pa.array(high[order])], none.schema)

    return _crossed(open_, all_, apart, chosen, none, "comp long, weight double, a long, b long")


def spanning_tree(df: DataFrame, key: str, vector: str, samples: int = 5, size: int = BLOCK) -> DataFrame:
    """a, b, weight: the minimum spanning tree of the vectors' mutual reachability (a < b; equal weights go to the smaller ids).

    A vector's listed neighbours tell its lightest edge to another component, unless one
    that isn't listed may be as near.  Only such vectors look among all others, and those
    of the largest component don't, as the tree grows from the others too.
    """
    spark = df.sparkSession
    rows, apart = blocks(df, key, vector, size)
    out = Parts(spark, "a long, b long, weight double", "tree")
    if not len(apart):
        return out.read()
    k = max(samples - 1, LISTED)
    near = neighbours(rows, apart, k)
    # what isn't listed is no nearer than the last that is
    reach = F.when(F.size("near") == k, F.element_at("near", k)["d"])
    cored = staged(rows.join(near.select("id", _core(samples).alias("core"), reach.alias("reach")), "id"), "cored")
    core = lambda c: cored.select(F.col("id").alias(c), F.col("core").alias(f"{c}_core"))
    arcs = near.select("id", F.explode("near").alias("n")).select(F.least("id", "n.id").alias("a"), F.greatest("id", "n.id").alias("b"), "n.d").distinct()
    live = staged(arcs.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("d", "a_core", "b_core").alias("weight")), "listed")
    part = staged(cored.select("id", F.col("id").alias("comp")), "parts")
    drop(near)
    while True:
        end = lambda c: part.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))  # noqa: B023, E731
        crossing = live.join(end("a"), "a").join(end("b"), "b").where("a_comp <> b_comp")
        left = staged(crossing, "listed")
        e = F.struct("weight", "a", "b")
        told = staged(left.select(F.explode(F.array("a_comp", "b_comp")).alias("comp"), e.alias("e")).groupBy("comp").agg(F.min("e").alias("e")), "told")
        largest = part.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").first().comp
        upper = F.coalesce("e.weight", F.lit(float("inf")))
        asked = cored.join(part, "id").join(told, "comp", "left").withColumn("upper", upper).where("reach <= upper").drop("e")
        open_, some = counted(asked.where(F.col("comp") != largest), "open")
        best = told.select("comp", "e")
        spent = [live, told, open_]
        if some.n:
            most = open_.groupBy("block").agg(F.max("upper").alias("most"))
            few = staged(_packed(open_, "core", "comp", "upper").join(most, "block"), "asking")
            packed = staged(_packed(cored.join(part, "id"), "core", "comp"), "packed")
            found = staged(_lightest(few, packed, apart).select("comp", e.alias("e")), "found")
            best = best.union(found).groupBy("comp").agg(F.min("e").alias("e"))
            spent += [few, packed, found]
        # the largest component has its lightest edge only if none of its vectors would have to look
        unsure = asked.where(F.col("comp") == largest).select("comp").limit(1)
        new, seen = counted(best.join(unsure, "comp", "left_anti").select("e.*").select("a", "b", "weight").distinct(), "new-edges")
        if not seen.n:
            return out.read()
        out.add(new)
        last, live = part, left.select("a", "b", "weight")
        if seen.n <= DRIVER_EDGES:
            part = staged(_merged_here(new, part), "parts")
        else:
            ends = new.join(part.select(F.col("id").alias("a"), F.col("comp").alias("src")), "a").join(part.select(F.col("id").alias("b"), F.col("comp").alias("dst")), "b").select("src", "dst")
            joined = graph.components(staged(ends, "joined"), part.select(F.col("comp").alias("id")).distinct())
            part = staged(part.join(joined.select(F.col("id").alias("comp"), "component"), "comp").select("id", F.col("component").alias("comp")), "parts")
        drop(last, new, *spent)


def _merged_here(edges: DataFrame, part: DataFrame) -> DataFrame:
    """id, comp: the components after a round of few edges, merged in the driver."""
    both = edges.join(part.select(F.col("id").alias("a"), F.col("comp").alias("src")), "a").join(part.select(F.col("id").alias("b"), F.col("comp").alias("dst")), "b").select("src", "dst").collect()  # DRIVER_EDGES at most
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for r in both:
        a, b = sorted((root(r.src), root(r.dst)))
        up[b] = a
    roots = edges.sparkSession.createDataFrame([(x, root(x)) for x in up], "comp long, root long")
    return part.join(F.broadcast(roots), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))


def clusters(tree: DataFrame, ids: DataFrame, distance: float, least: int) -> DataFrame:
    """id, cluster: the vectors (id) that edges of at most ``distance`` connect, by the smallest id; null for noise, which is what lies in fewer than ``least``."""
    near = tree.where(F.col("weight") <= distance).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = staged(graph.components(near, ids.select("id")), "clusters")
    big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component", F.col("component").alias("cluster"))
    return found.join(big, "component", "left").select("id", "cluster")


def profile(tree: DataFrame, ids: DataFrame, distances: list[float], least: int) -> DataFrame:
    """distance, n_clusters, n_noise, largest: how the vectors fall apart at each distance."""
    out = None
    for d in distances:
        sizes = clusters(tree, ids, d, least).groupBy("cluster").agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit(float(d)).alias("distance"), F.count("cluster").alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("n_noise"), F.coalesce(F.max(F.when(F.col("cluster").isNotNull(), F.col("n"))), F.lit(0)).alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out
