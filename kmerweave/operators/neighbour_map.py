"""Vectors on a plane by their neighbours (t-SNE): gradient rounds over tables.

Each vector spreads one unit of weight over its nearest others, by a Gaussian whose width
gives the wanted perplexity.  A round moves every point along the gradient of the
Kullback-Leibler divergence between these weights and those of the plane: attraction comes
over the neighbours' edges, repulsion from all points.  Up to ``PAIRS`` points repel one by
one; more are spread over the nodes of a grid, whose charges meet in a convolution, and read
their repulsion from its nodes.  That changes a point's repulsion by some millionths of the
largest (tests: less than 3e-5), leaves no point out, and costs a round the vectors times
their neighbours plus the nodes of the plane's occupied part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import density, graph
from ._stage import BROADCAST_ROWS, counted, drop, staged
from .vectors import principal_components

#: Points that repel one by one at most (collected and broadcast).
PAIRS = 4096
#: Distance of the grid's nodes at most and at least, nodes in each direction that a point is spread over, nodes of a tile's side at most.
SPACING, FINEST, NODES, TILE = 1 / 8, 2**-10, 8, 512
#: Nodes across the plane that are enough; where there would be fewer, they are closer.
ACROSS = 128
#: Shares of points on nodes that are summed up at once.
HELD = 2**22
#: Factor of the attraction in the first quarter of the rounds.
EXAGGERATION = 12.0
STEPS = 60


class Placed(NamedTuple):
    #: id, x, y
    points: DataFrame
    #: The divergence before each round.
    losses: list[float]


def weights(near: DataFrame, perplexity: float) -> DataFrame:
    """id, to, p: the weights of each vector's neighbours (id, near), which sum to 1 and whose entropy is the log of the perplexity; of a third of the neighbours where those are too few."""

    def told(d: np.ndarray) -> np.ndarray:
        """The weights of rows of as many distances, searched for at once."""
        d, target = d**2, math.log(max(1.0, min(perplexity, d.shape[1] / 3)))
        d -= d.min(1, keepdims=True)
        out, open_ = np.empty_like(d), np.arange(len(d))
        low, high, beta = np.zeros(len(d)), np.full(len(d), math.inf), np.ones(len(d))
        for _ in range(STEPS):
            p = np.exp(-d[open_] * beta[open_, None])
            p /= p.sum(1, keepdims=True)
            out[open_] = p
            entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
            more, off = entropy > target, np.abs(entropy - target) >= 1e-6
            low[open_] = np.where(more, beta[open_], low[open_])
            high[open_] = np.where(more, high[open_], beta[open_])
            beta[open_] = np.where(np.isinf(high[open_]), beta[open_] * 2, (low[open_] + high[open_]) / 2)
            open_ = open_[off]
            if not len(open_):
                break
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                near = part.column("near")
                size, (d, to) = np.diff(near.offsets.to_numpy()), near.flatten().flatten()
                d, p, first = d.to_numpy(), np.empty(len(d)), np.cumsum(size) - size
                for n in np.unique(size):
                    at = first[size == n][:, None] + np.arange(n)
                    p[at] = told(d[at])
                yield pa.record_batch([part.column("id").take(pa.array(np.repeat(np.arange(len(size)), size))), to, pa.array(p)], ["id", "to", "p"])

    return near.where(F.size("near") > 0).mapInArrow(spread, "id long, to long, p double")


def _repelled(points: DataFrame, chosen: list, n: int) -> DataFrame:
    """The points with rx, ry, z: repulsion by the chosen ones, which are all, and sum of their closeness; of fewer than ``n`` they are scaled to it."""
    shared = points.sparkSession.sparkContext.broadcast((np.array([r.id for r in chosen]), np.array([(r.x, r.y) for r in chosen]).reshape(-1, 2)))
    names = points.columns

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                me, xy = part.column("id").to_numpy(), np.stack([part.column("x").to_numpy(), part.column("y").to_numpy()], 1)
                away = xy[:, None] - at[None]
                q = 1 / (1 + (away**2).sum(-1))
                other = me[:, None] != ids[None]
                q *= other
                scale = (n - 1) / np.maximum(other.sum(1), 1)
                r = ((q**2)[:, :, None] * away).sum(1) * scale[:, None]
                yield pa.record_batch([*part.columns, pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(q.sum(1) * scale)], [*names, "rx", "ry", "z"])

    return points.mapInArrow(push, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", rx double, ry double, z double")


def _nodes(at: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """The first node of every coordinate and its shares (Lagrange's) on the ``NODES`` from there."""
    cell = np.floor(at / spacing)
    own, steps = at / spacing - cell, np.arange(NODES) - NODES // 2 + 1
    shares = np.ones((*at.shape, NODES))
    for j in range(NODES):
        for i in range(NODES):
            if i != j:
                shares[..., j] *= (own - steps[i]) / (steps[j] - steps[i])
    return cell.astype(np.int64) + steps[0], shares


def _charges(points: DataFrame, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """The occupied nodes (column and row) and their charges: the sums of all points' shares."""

    def summed(rows: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = rows.min(0)
        high, wide = (rows.max(0) - low + 1).tolist()
        flat = (rows[:, 0] - low[0]) * wide + rows[:, 1] - low[1]
        if high * wide <= HELD:
            sums = np.bincount(flat, shares, high * wide)
            flat = np.flatnonzero(sums)
            sums = sums[flat]
        else:
            flat, at = np.unique(flat, return_inverse=True)
            sums = np.bincount(at, shares)
        return np.stack([flat // wide, flat % wide], 1) + low, sums

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shares = np.zeros((0, 2), np.int64), np.zeros(0)
        for b in batches:
            for lo in range(0, b.num_rows, HELD // 16 // NODES**2):
                part = b.slice(lo, HELD // 16 // NODES**2)
                first, w = _nodes(np.stack([part.column("x").to_numpy(), part.column("y").to_numpy()], 1), spacing)
                at = first[:, None, None, :] + np.stack(np.meshgrid(range(NODES), range(NODES), indexing="ij"), -1)
                one = summed(at.reshape(-1, 2), (w[:, 0, :, None] * w[:, 1, None, :]).ravel())
                rows, shares = np.concatenate([rows, one[0]]), np.concatenate([shares, one[1]])
                if len(rows) > HELD // 4:
                    rows, shares = summed(rows, shares)
        if len(rows):
            rows, shares = summed(rows, shares)
            for lo in range(0, len(rows), HELD // 16):
                part = slice(lo, lo + HELD // 16)
                yield pa.record_batch([pa.array(rows[part, 0]), pa.array(rows[part, 1]), pa.array(shares[part])], ["gx", "gy", "q"])

    found = points.select("x", "y").mapInArrow(spread, "gx long, gy long, q double").groupBy("gx", "gy").agg(F.sum("q").alias("q")).toArrow()  # occupied nodes
    return np.stack([found.column("gx").to_numpy(), found.column("gy").to_numpy()], 1), found.column("q").to_numpy()


def _kernels(dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closeness of points so far apart, and both directions of their repulsion."""
    q = 1 / (1 + dx**2 + dy**2)
    return q, q**2 * dx, q**2 * dy


def _fields(nodes: np.ndarray, charges: np.ndarray, spacing: float) -> tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]:
    """The lowest node, a tile's side, and for every occupied tile what all charges bring about at its nodes: closeness and repulsion.

    Tiles meet in pairs, so the memory is that of the occupied ones, however far apart they are.
    """
    low = nodes.min(0)
    size = min(TILE, 2 ** math.ceil(math.log2((nodes.max(0) - low).max() + 1)))
    tile, at = np.divmod(nodes - low, size)
    held = {}
    order = np.lexsort((tile[:, 1], tile[:, 0]))
    for some in np.split(order, np.flatnonzero((np.diff(tile[order], axis=0) != 0).any(1)) + 1):
        held[tuple(tile[some[0]].tolist())] = some
    spectra = {}
    for t, some in held.items():
        own = np.zeros((size, size))
        own[at[some, 0], at[some, 1]] = charges[some]
        spectra[t] = np.fft.rfft2(own, (2 * size, 2 * size))
    out = {t: np.empty((3, size, size)) for t in held}
    steps = (np.arange(2 * size) + size) % (2 * size) - size  # a shift's place in a circle
    for k in range(3):
        sums = {t: np.zeros_like(x) for t, x in spectra.items()}
        for ox, oy in {(a[0] - b[0], a[1] - b[1]) for a in held for b in held}:
            by = np.fft.rfft2(_kernels(*np.meshgrid((steps + ox * size) * spacing, (steps + oy * size) * spacing, indexing="ij"))[k])
            for t, own in spectra.items():
                if (to := (t[0] + ox, t[1] + oy)) in sums:
                    sums[to] += own * by
        for t, x in sums.items():
            out[t][k] = np.fft.irfft2(x, (2 * size, 2 * size))[:size, :size]
    return low, size, out


def _repelled_by_all(points: DataFrame, spacing: float) -> tuple[DataFrame, Callable[[], None], float]:
    """The points with rx, ry, z as ``_repelled`` gives, over the grid's nodes; what to call once they are written, and the plane's width."""
    nodes, charges = _charges(points, spacing)
    shared = points.sparkSession.sparkContext.broadcast(_fields(nodes, charges, spacing))
    names = points.columns
    # a point is near to its own nodes too, which push it nowhere
    steps = np.arange(NODES) * spacing
    apart = steps[:, None] - steps[None]
    own = _kernels(np.broadcast_to(apart[:, None, :, None], (NODES,) * 4), np.broadcast_to(apart[None, :, None, :], (NODES,) * 4))[0].reshape(NODES**2, NODES**2)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, size, fields = shared.value
        flat = {t: f.reshape(3, -1) for t, f in fields.items()}
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                first, w = _nodes(np.stack([part.column("x").to_numpy(), part.column("y").to_numpy()], 1), spacing)
                share = (w[:, 0, :, None] * w[:, 1, None, :]).reshape(part.num_rows, -1)
                (tx, ax), (ty, ay) = (np.divmod(first[:, c, None] - low[c] + np.arange(NODES), size) for c in (0, 1))
                found = np.empty((3, part.num_rows, NODES, NODES))
                for one in set(map(tuple, np.stack([tx[:, [0, 0, -1, -1]], ty[:, [0, -1, 0, -1]]], -1).reshape(-1, 2).tolist())):
                    mine = (tx == one[0])[:, :, None] & (ty == one[1])[:, None, :]
                    at = ax[:, :, None] * size + ay[:, None, :]
                    if mine.all():
                        found[:] = [f[at] for f in flat[one]]
                    elif mine.any():
                        found[:, mine] = [f[at[mine]] for f in flat[one]]
                closeness, rx, ry = found.reshape(3, part.num_rows, -1)
                yield pa.record_batch([*part.columns, pa.array((rx * share).sum(1)), pa.array((ry * share).sum(1)), pa.array(((closeness - share @ own) * share).sum(1))], [*names, "rx", "ry", "z"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(read, f"{kinds}, rx double, ry double, z double"), shared.destroy, float((nodes.max(0) - nodes.min(0)).max() * spacing)


def placed(df: DataFrame, key: str, vector: str, perplexity: float = 30.0, rounds: int = 250, size: int = density.BLOCK) -> Placed:
    """The usable vectors (of two components or more) on a plane.

    Starts from the first two principal components, so reruns agree but for the order of
    sums.  One vector lies at the origin.
    """
    spark = df.sparkSession
    rows, apart = density.blocks(df, key, vector, size)
    n = rows.count()
    if n < 2:
        return Placed(rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), [])
    one_way = staged(weights(density.neighbours(rows, apart, min(n - 1, int(3 * perplexity))), perplexity), "weights")
    both = one_way.union(one_way.select("to", "id", "p")).repartition(graph._tasks(one_way, 2 * n * min(n - 1, int(3 * perplexity))), "id").groupBy("id", "to").agg((F.sum("p") / (2 * n)).alias("p"))
    edges, own = counted(both, "affinities", h=F.sum(F.col("p") * F.log("p")))
    drop(one_way)
    scores, _ = principal_components(rows.select("id", "v"), "id", "v", 2)
    start = staged(scores.select("id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y")), "start")
    wide = start.agg(F.stddev_pop("x")).first()[0] or 1.0
    zero, unit = F.lit(0.0), F.lit(1.0)
    # a little of the id keeps equal vectors apart
    jitter = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2001)) - 1000) / 1e9
    now = start.select("id", *((F.col(c) / wide * 1e-2 + jitter(s)).alias(c) for s, c in enumerate("xy")), *(zero.alias(c) for c in ("vx", "vy")), *(unit.alias(c) for c in ("gx", "gy")))
    losses: list[float] = []
    small = F.broadcast if n <= BROADCAST_ROWS else (lambda t: t)
    old, width = start, 0.0
    parts = graph._tasks(edges, n * NODES**2)
    for k in range(rounds):
        early = 4 * k < rounds
        if n <= PAIRS:
            repelled, done = _repelled(now, now.select("id", "x", "y").collect(), n), None  # PAIRS rows at most
        else:  # the last round's width tells how close nodes may be
            repelled, done, width = _repelled_by_all(now, min(SPACING, max(FINEST, 2.0 ** math.floor(math.log2(max(width, FINEST) / ACROSS)))))
        end = lambda a, x, y: now.select(F.col("id").alias(a), F.col("x").alias(x), F.col("y").alias(y))  # noqa: B023, E731
        met = edges.join(small(end("id", "x1", "y1")), "id").join(small(end("to", "x2", "y2")), "to")
        dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
        q = unit / (unit + dx * dx + dy * dy)
        pull = met.groupBy("id").agg(F.sum(F.col("p") * q * dx).alias("ax"), F.sum(F.col("p") * q * dy).alias("ay"), F.sum(F.col("p") * F.log(q)).alias("fit"))
        step, seen = counted(repelled.join(pull, "id").repartition(parts), "step", z=F.sum("z"), fit=F.sum("fit"))
        if done:
            done()
        losses.append(own.h - seen.fit + math.log(seen.z))
        force = EXAGGERATION if early else 1.0
        rate = n / (4 * force)  # a vector's weights sum to about 1 / n, so a step of attraction ends near its neighbours
        keep = 0.5 if early else 0.8
        moved = {}
        for c in "xy":
            g = 4 * (force * F.col(f"a{c}") - F.col(f"r{c}") / F.lit(seen.z))
            gain = F.greatest(F.when((g > 0) != (F.col(f"v{c}") > 0), F.col(f"g{c}") + 0.2).otherwise(F.col(f"g{c}") * 0.8), F.lit(0.01))
            v = keep * F.col(f"v{c}") - rate * gain * g
            moved |= {c: F.col(c) + v, f"v{c}": v, f"g{c}": gain}
        drop(old)
        now, old = step.select("id", *(e.alias(c) for c, e in moved.items())).select("id", "x", "y", "vx", "vy", "gx", "gy"), step
    return Placed(staged(now.select("id", "x", "y"), "placed"), losses)
