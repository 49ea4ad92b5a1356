"""Pairs of vertices that two arcs connect, found in cells: no pair is shuffled.

Arcs are dealt out by their middle vertex once, as lists.  The ids of the pairs' first
vertices are cut into ranges of about as many paths, and a middle vertex sends its lists to
the ranges that hold one of its ends; where one range alone has too many paths, its second
vertices are dealt out over several cells.  A cell drops repeated pairs and adjacent ones,
so what travels is the lists, at most an id for every path and far less where ids of
neighbours are near to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import counted

#: Ranges of ids whose paths are counted, at most (the counts come to the driver).
RANGES = 2**16
#: Paths that are spread out at once, and pairs that a cell marks in a matrix instead of sorting them.
SPREAD, MARKS = 2**21, 2**26


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every element, and the elements."""
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values, pa.int64()))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def around(arcs: DataFrame, outs: bool, parts: int) -> DataFrame:
    """v, ids, kinds: what is next to every vertex, in order of kind and id; a kind is twice the arc's weight for an arc that comes in, one more for one that leads out (only with ``outs``)."""
    weight = (2 * (F.col("weight") if "weight" in arcs.columns else F.lit(1))).cast("int")
    ends = lambda v, i, kind: arcs.select(F.col(v).cast("long").alias("v"), F.col(i).cast("long").alias("id"), kind.alias("kind"))
    rows = ends("dst", "src", weight)
    if outs:
        rows = rows.union(ends("src", "dst", weight + 1))

    def told(held: list[pa.RecordBatch], until: int | None = None) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).slice(0, until).combine_chunks()
        if t.num_rows:
            v = t.column("v").to_numpy()
            ends = np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, len(v))
            at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, t.column(c).combine_chunks()) for c in ("id", "kind")]
            yield pa.record_batch([pa.array(v[ends - 1]), *lists], ["v", "ids", "kinds"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").to_numpy()
            cut = int(np.searchsorted(v, v[-1]))  # the last vertex may go on in the next batch
            if held and cut == 0 and held[-1].column("v")[-1].as_py() == v[-1]:
                held.append(b)
                continue
            yield from told([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        if held:
            yield from told(held)

    dealt = rows.repartition(parts, "v").sortWithinPartitions("v", "kind", "id")
    return dealt.mapInArrow(listed, "v long, ids array<long>, kinds array<int>")


def _sides(b: pa.RecordBatch, weight: int, outs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row and id of the arcs that come in and of those that paths of the weight go on by, for each weight of the first; without the first for arcs of the whole weight."""
    row, ids = _rows(b.column("ids"))
    kind = b.column("kinds").flatten().to_numpy()
    for w in range(weight):
        left, right = kind == 2 * w, kind == 2 * (weight - w) + outs
        yield row[left], ids[left], row[right], ids[right]


class _Cells:
    """The cell of a pair: the range of its first vertex, and a share of its second where the range has too many paths."""

    def __init__(self, low: int, width: int, paths: np.ndarray, most: int):
        self.low, self.width = low, width
        self.first, self.parts, self.n, held = np.full(len(paths), -1), np.ones(len(paths), np.int64), 0, most
        for i in np.flatnonzero(paths):
            p = int(paths[i])
            self.parts[i] = max(1, -(-p // most))
            if held + p > most:
                self.n, held = self.n + int(self.parts[i]), 0
            self.first[i], held = self.n - self.parts[i], held + p

    def ranges(self, ids: np.ndarray) -> np.ndarray:
        """The range of every id, -1 where no path leads to it."""
        at = (ids - self.low) // self.width
        ok = (ids >= self.low) & (at < len(self.first))
        at = np.where(ok, at, 0)
        return np.where(ok & (self.first[at] >= 0), at, -1)

    @staticmethod
    def share(ids: np.ndarray, parts: int) -> np.ndarray:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _sent(cells: _Cells, v: np.ndarray, lefts: tuple, rights: tuple, g_row: np.ndarray, g_range: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cell, v, lefts, rights of groups: vertex and range, with the first and the number of their ids on both sides."""
    (left, l_first, l_size), (right, r_first, r_size) = lefts, rights
    one = cells.parts[g_range] == 1
    if one.any():
        part = lambda x, f, n: _lists(x[_spans(f[one], n[one])], n[one])
        yield pa.record_batch([pa.array(cells.first[g_range[one]].astype(np.int32)), pa.array(v[g_row[one]]), part(left, l_first, l_size), part(right, r_first, r_size)], ["cell", "v", "lefts", "rights"])
    for g in np.flatnonzero(~one):
        parts, me = int(cells.parts[g_range[g]]), v[g_row[g] : g_row[g] + 1]
        mine, other = left[l_first[g] : l_first[g] + l_size[g]], right[r_first[g] : r_first[g] + r_size[g]]
        share = cells.share(mine, parts)
        # the vertex itself is adjacent to its ends
        for s in np.union1d(share, cells.share(me, parts)):
            some = mine[share == s]
            yield pa.record_batch([pa.array([cells.first[g_range[g]] + s], pa.int32()), pa.array(me), _lists(some, np.array([len(some)])), _lists(other, np.array([len(other)]))], ["cell", "v", "lefts", "rights"])


def _unlinked(t: pa.Table, rising: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, u) of a cell's rights and lefts, each once, that are neither equal nor adjacent; with ``rising`` those of x < u."""
    t = t.combine_chunks()
    column = lambda c: t.column(c).combine_chunks()
    v, (l_row, left), (r_row, right) = column("v").to_numpy(), _rows(column("lefts")), _rows(column("rights"))
    sizes = np.bincount(l_row, minlength=len(v))
    first = np.cumsum(sizes) - sizes
    path = np.bincount(r_row, minlength=len(v)) > 0
    xs, us = np.unique(right), np.unique(left[path[l_row]])
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(us):
        return empty
    place = np.searchsorted(us, left)  # only of those that paths come from
    at, many = np.searchsorted(xs, right), sizes[r_row]
    ends = np.cumsum(many)

    def keys() -> Iterator[np.ndarray]:
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPREAD, "right")))
            n = many[lo:hi]
            yield np.repeat(at[lo:hi] * len(us), n) + place[_spans(first[r_row[lo:hi]], n)]
            lo = hi

    def known(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        i, j = np.minimum(np.searchsorted(xs, x), len(xs) - 1), np.minimum(np.searchsorted(us, u), len(us) - 1)
        ok = (xs[i] == x) & (us[j] == u)
        return i[ok] * len(us) + j[ok]

    near = ~path[l_row]  # rows without rights tell what their vertex is adjacent to
    gone = np.concatenate([known(right, v[r_row]), known(v[l_row[near]], left[near]), known(xs, xs)])
    if len(xs) * len(us) <= MARKS:
        hit = np.zeros(len(xs) * len(us), bool)
        for k in keys():
            hit[k] = True
        hit[gone] = False
        found = np.flatnonzero(hit)
    else:
        found = np.zeros(0, np.int64)
        for k in keys():
            found = np.union1d(found, k)
        found = found[~np.isin(found, gone)]
    x, u = xs[found // len(us)], us[found % len(us)]
    return (x[x < u], u[x < u]) if rising else (x, u)


def unlinked(arcs: DataFrame, weight: int, names: tuple[str, str], parts: int, most: int, outs: bool) -> DataFrame:
    """Pairs that two arcs connect whose weights add up to ``weight``, each once, without equal and adjacent ones.

    With ``outs`` (x, u) where u -> v -> x, else (x, y) with x < y where x -> v <- y.
    ``parts``: tasks that hold all arcs; ``most``: paths of a cell.
    """
    spark, rising = arcs.sparkSession, not outs
    schema = ", ".join(f"{c} long" for c in names)
    lists, seen = counted(around(arcs, outs, parts), "around", low=F.min(F.array_min("ids")), high=F.max(F.array_max("ids")))
    if not seen.n:
        return spark.createDataFrame([], schema)
    low, width = seen.low, (seen.high - seen.low) // RANGES + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(RANGES)
        for b in batches:
            for l_row, _, r_row, right in _sides(b, weight, outs):
                n = np.bincount(l_row, minlength=b.num_rows)[r_row]
                sums += np.bincount((right - low) // width, n, RANGES)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at].astype(np.int64))], ["at", "n"])

    paths = np.zeros(RANGES, np.int64)
    for r in lists.mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # RANGES at most
        paths[r.at] = r.n
    cells = _Cells(low, width, paths, most)
    shared = spark.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for b in batches:
            v, n = b.column("v").to_numpy(), b.num_rows
            for l_row, left, r_row, right in _sides(b, weight, outs):
                at = cells.ranges(right)
                order = np.flatnonzero(at >= 0)
                order = order[np.lexsort((right[order], cells.first[at[order]], r_row[order]))]
                if not len(order):
                    continue
                row, cell, ids = r_row[order], cells.first[at[order]], right[order]
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))
                many = np.diff(np.append(begin, len(order)))
                size = np.bincount(l_row, minlength=n)
                first, size = (np.cumsum(size) - size)[row[begin]], size[row[begin]]
                if rising and (b.num_rows + 1) * (wide := int(right.max() - low) + 1) < 2**62:
                    # the smallest right is less than all lefts that it meets
                    cut = np.searchsorted(l_row * wide + np.minimum(left - low, wide - 1), row[begin] * wide + (ids[begin] - low), "right")
                    size, first = first + size - cut, cut
                yield from _sent(cells, v, (left, first, size), (ids, begin, many), row[begin], at[order][begin])
            # a vertex that paths lead to: what else it is adjacent to
            row, ids = _rows(b.column("ids"))
            some = b.column("kinds").flatten().to_numpy() % 2 == outs
            own = np.flatnonzero((cells.ranges(v) >= 0) & (np.bincount(row[some], minlength=n) > 0))
            size = np.bincount(row[some], minlength=n)
            none = np.zeros(len(own), np.int64)
            yield from _sent(cells, v, (ids[some], (np.cumsum(size) - size)[own], size[own]), (ids[:0], none, none), own, cells.ranges(v)[own])

    def found(t: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, pa.int64()) for c in _unlinked(t, rising)], list(names))

    sent = lists.mapInArrow(deal, "cell int, v long, lefts array<long>, rights array<long>")
    return sent.repartition(max(spark.sparkContext.defaultParallelism, cells.n), "cell").groupBy("cell").applyInArrow(found, schema)
