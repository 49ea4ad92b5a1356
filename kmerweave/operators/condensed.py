"""Density clusters at all distances: the dendrogram of a spanning tree, condensed, and its most stable clusters.

A spanning tree's edges, from the heaviest down, split the vectors; the dendrogram tells
which vectors hang together below each edge.  It may be as deep as it has edges, so it
isn't walked: the tree is contracted in rounds.  In every round each vertex joins over its
lightest edge, which at least halves the vertices; edges that a vertex took lie on chains
of the dendrogram, and a chain hangs below the first later edge that is heavier.  The
rounds are the logarithm of the vectors' number, and sizes are running sums along chains.

Edges are known by their places in the order of (weight, a, b), so ties are decided.  A
vector that leaves a cluster at distance d does so at density 1 / d (distances below
``floor`` count as ``floor``).  A cluster's stability is the sum, over its vectors, of
the density at which they leave it less that at which it arose.  Where an edge parts two
sides of at least ``least`` vectors, two clusters arise; smaller sides just leave.  A
cluster is chosen if its stability is at least that of the best choice below it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import density, graph
from ._stage import Parts, counted, drop, staged
from .hierarchy import running

#: Distances below count as this, so equal vectors don't have an infinite density.
FLOOR = 1e-6


class Condensed(NamedTuple):
    #: cluster, parent, birth (distance of the split it arose from; null for a root), size, stability, chosen.
    clusters: DataFrame
    #: id, cluster (the chosen one, null for noise), own (the smallest that ever held it), left (the distance at which it left that one).
    points: DataFrame


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The dendrogram of a forest's edges (e, a, b): its chains (e, level, x, p), the edges that join single vertices (id, e), and the number of levels.

    (level, x) names a chain, whose edges follow one another in rising order; p is the
    edge above the last one, null at a root.  p's own chain has a larger level.
    """
    spark = edges.sparkSession
    out, level = Parts(spark, "e long, level int, x long, p long", "chains"), 0
    live = staged(edges.select("e", F.col("a").alias("x"), F.col("b").alias("y")), "live")
    first, waiting = None, None
    while True:
        ends = live.select("x", "e").union(live.select(F.col("y").alias("x"), "e"))
        least, seen = counted(ends.groupBy("x").agg(F.min("e").alias("p")), "lightest")
        old = [live, waiting]
        if waiting is None:
            first = least
        else:
            old.append(least)
            placed = waiting.join(least, "x", "left")
            out.add(placed.where(F.col("p").isNull() | (F.col("e") < F.col("p"))).select("e", F.lit(level).cast("int").alias("level"), "x", "p"))
            waiting = placed.where(F.col("e") > F.col("p")).select("e", "x")
        if not seen.n:
            drop(*old)
            return out.read(), first.select(F.col("x").alias("id"), F.col("p").alias("e")), level
        taken = staged(live.join(least.select(F.col("p").alias("e")).distinct(), "e", "left_semi"), "taken")
        if seen.n <= density.DRIVER_EDGES:  # every vertex takes one edge
            comp = density._merged_here(taken.select(F.col("x").alias("a"), F.col("y").alias("b")), least.select(F.col("x").alias("id"), F.col("x").alias("comp"))).select("id", F.col("comp").alias("component"))
        else:
            comp = graph.components(taken.select(F.col("x").alias("src"), F.col("y").alias("dst")), least.select(F.col("x").alias("id")))
        comp = staged(comp, "contracted")
        to = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}2"))  # noqa: B023, E731
        mine = taken.select("e", "x")
        moved = (mine if waiting is None else mine.union(waiting)).join(to("x"), "x").select("e", F.col("x2").alias("x"))
        rest = live.join(taken, "e", "left_anti").join(to("x"), "x").join(to("y"), "y").select("e", F.col("x2").alias("x"), F.col("y2").alias("y"))
        waiting, live, level = staged(moved, "waiting"), staged(rest, "live"), level + 1
        drop(*old, taken, comp)


def _sized(chain: DataFrame, first: DataFrame, levels: int, least: int) -> DataFrame:
    """e, level, x, p, size (vectors below the edge), split: both of its sides hold at least ``least``."""
    # what hangs below an edge beside its own chain: single vectors and whole chains
    mass = Parts(chain.sparkSession, "e long, size long", "mass")
    mass.add(first.select("e", F.lit(1).cast("long").alias("size")))
    for k in range(1, levels + 1):
        own = mass.read().groupBy("e").agg(F.sum("size").alias("size"))
        total = chain.where((F.col("level") == k) & F.col("p").isNotNull()).join(own, "e").groupBy("x", "p").agg(F.sum("size").alias("size"))
        mass.add(total.select(F.col("p").alias("e"), "size"))
    own = mass.read().groupBy("e").agg(F.sum("size").alias("c"), F.count(F.when(F.col("size") >= least, 1)).alias("n_big"))
    run = staged(running(chain.join(own, "e"), [F.col("level"), F.col("x"), F.col("e")], upto=F.col("c")), "run")
    start = run.groupBy("level", "x").agg(F.min(F.col("upto") - F.col("c")).alias("start"))
    size = F.col("upto") - F.col("start")
    below = (size - F.col("c") >= least).cast("long")
    return run.join(start, ["level", "x"]).select("e", "level", "x", "p", size.alias("size"), (F.col("n_big") + below == 2).alias("split"))


def _followed(links: DataFrame) -> DataFrame:
    """c, to: the ends of links that lead from c to to (itself at an end), by pointer doubling."""
    links = staged(links, "links")
    while True:
        ahead = links.select(F.col("c").alias("to"), F.col("to").alias("then"))
        new, seen = counted(links.join(ahead, "to").select("c", F.col("then").alias("to"), (F.col("to") != F.col("then")).alias("moved")), "links", moved=F.count(F.when(F.col("moved"), 1)))
        drop(links)
        links = new.select("c", "to")
        if not seen.moved:
            return links


def _leaving(flat: DataFrame, first: DataFrame) -> DataFrame:
    """id, e: the first edge above a vector with enough vectors below (flat: e, fall, p); vectors without one are left out."""
    out = Parts(flat.sparkSession, "id long, e long", "leaving")
    at = first
    while True:
        here, seen = counted(at.join(flat, "e").select("id", "fall", "p"), "climbing", up=F.count(F.when(F.col("fall").isNull() & F.col("p").isNotNull(), 1)))
        out.add(here.where(F.col("fall").isNotNull()).select("id", F.col("fall").alias("e")))
        if not seen.up:
            return out.read()
        at = here.where(F.col("fall").isNull() & F.col("p").isNotNull()).select("id", F.col("p").alias("e"))


def _best(clusters: DataFrame) -> DataFrame:
    """c, wins: whether a cluster (c, parent, stability) is at least as stable as the best choice below it.

    S(c) = max(stability, S of both children).  Clusters with all children known are
    solved; one with a single open child d is max(a, b + S(d)), and such forms are put
    into each other, so a long chain of splits takes a logarithm of rounds.
    """
    none = F.lit(None)
    state = staged(clusters.select("c", "parent", "stability", none.cast("double").alias("value"), none.cast("double").alias("a"), none.cast("double").alias("b"), none.cast("long").alias("ptr")), "best")
    while True:
        kids = state.groupBy(F.col("parent").alias("c")).agg(
            F.count(F.when(F.col("value").isNull(), 1)).alias("open"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("add"), F.max(F.when(F.col("value").isNull(), F.col("c"))).alias("only")
        )
        there = state.select(F.col("c").alias("ptr"), F.col("value").alias("v2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("ptr").alias("ptr2"))
        known, fresh = F.col("value").isNotNull(), F.col("ptr").isNull()
        opened, one = F.coalesce("open", F.lit(0)), F.coalesce("open", F.lit(0)) == 1
        add = F.coalesce("add", F.lit(0.0))
        solved = (
            F.when(known, F.col("value"))
            .when(fresh & (opened == 0), F.greatest("stability", add))
            .when(~fresh & F.col("v2").isNotNull(), F.greatest(F.col("a"), F.col("b") + F.col("v2")))
        )
        deeper = ~fresh & F.col("ptr2").isNotNull()
        new = state.join(kids, "c", "left").join(there, "ptr", "left").select(
            "c", "parent", "stability", solved.alias("value"),
            F.when(fresh & one, F.col("stability")).when(deeper, F.greatest(F.col("a"), F.col("b") + F.col("a2"))).otherwise(F.col("a")).alias("a"),
            F.when(fresh & one, add).when(deeper, F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"),
            F.when(fresh & one, F.col("only")).when(deeper, F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"),
        )
        last = state
        state, seen = counted(new, "best", open=F.count(F.when(F.col("value").isNull(), 1)))
        drop(last)
        if not seen.open:
            below = state.groupBy(F.col("parent").alias("c")).agg(F.sum("value").alias("below"))
            return state.join(below, "c", "left").select("c", (F.col("stability") >= F.coalesce("below", F.lit(0.0))).alias("wins"))


def _topmost(clusters: DataFrame) -> DataFrame:
    """c, top: the highest winner (c, parent, wins) on the way from c to its root; null if there is none."""
    state = staged(clusters.select("c", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("c")).alias("top")), "topmost")
    while True:
        there = state.select(F.col("c").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        new, seen = counted(state.join(there, "up", "left").select("c", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")), "topmost", open=F.count("up"))
        drop(state)
        state = new
        if not seen.open:
            return state.select("c", "top")


def condense(tree: DataFrame, ids: DataFrame, least: int = 15, root: bool = False, floor: float = FLOOR) -> Condensed:
    """The condensed tree of a spanning tree (a, b, weight) of vectors (id), and the most stable clusters.

    ``least`` (2 or more): vectors of a cluster at least.  ``root``: whether all vectors
    together may be chosen as one cluster.  Vectors in no edge, and parts of a forest
    with fewer than ``least`` vectors, are noise; without vectors both tables are empty.
    """
    if least < 2:
        raise ValueError("a cluster holds at least two vectors")
    dense = lambda c: F.lit(1.0) / F.greatest(c, F.lit(floor))
    edges = staged(graph.renumber(tree.select("a", "b", "weight", F.struct("weight", "a", "b").alias("at")), "at", "e").select("e", "a", "b", "weight"), "ranked")
    weight = edges.select("e", "weight")
    chain, first, levels = chains(edges)
    sized = staged(_sized(chain, first, levels, least), "sized")

    # edges of enough vectors, cut into segments at the splits; a split begins a segment
    big = sized.where(F.col("size") >= least)
    cut = staged(running(big, [F.col("level"), F.col("x"), F.col("e")], seg=F.col("split").cast("long")), "segments")
    segs = staged(cut.groupBy("level", "x", "seg").agg(F.min("e").alias("c"), F.max("size").alias("size"), F.first("p").alias("p")), "segment")
    above = segs.select("level", "x", (F.col("seg") - 1).alias("seg"), F.col("c").alias("next"))
    of = staged(cut.join(segs.select("level", "x", "seg", "c"), ["level", "x", "seg"]).join(weight, "e").select("e", "c", "split", "weight"), "of-segment")
    over = of.select(F.col("e").alias("pe"), F.col("c").alias("pc"), F.col("split").alias("psplit"), F.col("weight").alias("birth"))
    linked = staged(segs.join(above, ["level", "x", "seg"], "left").select("c", "size", F.coalesce("next", "p").alias("pe")).join(over, "pe", "left"), "linked")
    # a segment that ends at an edge without a split goes on in that edge's segment
    goes_on: Column = F.col("pc").isNotNull() & ~F.col("psplit")
    whole = staged(_followed(linked.select("c", F.when(goes_on, F.col("pc")).otherwise(F.col("c")).alias("to"))), "whole")
    up = whole.select(F.col("c").alias("pc"), F.col("to").alias("parent"))
    born = staged(linked.where(~goes_on).join(up, "pc", "left").select("c", "parent", "birth", "size"), "born")

    lowest = big.groupBy("level", "x").agg(F.min("e").alias("low"))
    flat = sized.join(lowest, ["level", "x"], "left").select("e", F.when(F.col("size") >= least, F.col("e")).otherwise(F.col("low")).alias("fall"), "p")
    at = of.select("e", "c", "weight").join(whole, "c").select("e", F.col("to").alias("own"), F.col("weight").alias("left"))
    left = staged(_leaving(staged(flat, "flat"), first).join(at, "e").select("id", "own", "left"), "left")

    # differences before sums: a vector leaves no further than its cluster arose, so no term and no sum is negative
    since = born.select(F.col("c").alias("own"), F.when(F.col("birth").isNull(), F.lit(0.0)).otherwise(dense(F.col("birth"))).alias("since"))
    leave = left.join(since, "own").groupBy(F.col("own").alias("c")).agg(F.sum(dense(F.col("left")) - F.col("since")).alias("d"))
    parted = born.where(F.col("parent").isNotNull()).select(F.col("parent").alias("own"), "birth", "size").join(since, "own").groupBy(F.col("own").alias("c")).agg(F.sum((dense(F.col("birth")) - F.col("since")) * F.col("size")).alias("d"))
    gone = leave.union(parted).groupBy("c").agg(F.sum("d").alias("d"))
    stable = staged(born.join(gone, "c").select("c", "parent", "birth", "size", F.col("d").alias("stability")), "stable")
    best = _best(stable).join(stable.select("c", "parent"), "c").select("c", "parent", (F.col("wins") & (F.col("parent").isNotNull() | F.lit(root))).alias("wins"))
    top = staged(_topmost(staged(best, "winners")), "top")
    clusters = stable.join(top, "c").select(F.col("c").alias("cluster"), "parent", "birth", "size", "stability", F.coalesce(F.col("top") == F.col("c"), F.lit(False)).alias("chosen"))
    named = left.join(top.select(F.col("c").alias("own"), F.col("top").alias("cluster")), "own")
    return Condensed(clusters, ids.select("id").join(named, "id", "left").select("id", "cluster", "own", "left"))
