"""Undirected graphs as edge tables with both directions: (src, dst)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import two_steps
from ._stage import BROADCAST_ROWS, Parts, counted, drop, staged


#: Rows of a task that drops repeated ones; paths of two arcs that a cell holds, as a multiple of it.
SHARE, PATHS = 500_000, 8


def once(rows: DataFrame, n: int) -> DataFrame:
    """The distinct rows of a table of at most ``n``: dealt out first, so a task holds about ``SHARE`` rows whatever the table's size."""
    return rows.repartition(_tasks(rows, n), *rows.columns).distinct()


def undirected(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Both directions, without self-loops and repeated edges; with ``n``, the most edges there are, in tasks of bounded memory."""
    e = edges.select("src", "dst").where("src <> dst")
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct() if n is None else once(both, 2 * n)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, degree; with a vertex table also those of degree 0."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return d if vertices is None else vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolates(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def asymmetric(arcs: DataFrame) -> DataFrame:
    """Arcs without their counterpart; a valid graph has none."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return arcs.select("src", "dst").join(back, ["src", "dst"], "left_anti")


def disconnect_pendants(edges: DataFrame, nodes: DataFrame, cutoff: float = 1.1) -> DataFrame:
    """Edges without those of pendants: vertices of degree 1 or less whose abundance is at most the cutoff.

    Pendants stay as isolated vertices.
    """
    weak = degrees(edges, nodes).where("degree <= 1").join(nodes.where(F.col("abund") <= cutoff).select("id"), "id").select("id")
    return edges.join(weak.withColumnRenamed("id", "src"), "src", "left_anti").join(weak.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


def transitive_pairs(arcs: DataFrame) -> DataFrame:
    """(x, u): u -> v -> x by some v, u and x distinct and not adjacent."""
    return _unlinked(arcs, 2, ("x", "u"), outs=True)


def fraternal_pairs(arcs: DataFrame) -> DataFrame:
    """(x, y) with x < y: tails of arcs to one head that are not adjacent."""
    return _unlinked(arcs, 2, ("x", "y"), outs=False)


def _unlinked(arcs: DataFrame, weight: int, names: tuple[str, str], outs: bool, n: int | None = None) -> DataFrame:
    """``two_steps.unlinked`` in tasks and cells of bounded rows; ``n`` is the arcs' number where it is known."""
    n = arcs.count() if n is None else n
    return two_steps.unlinked(arcs.select("src", "dst", *(c for c in arcs.columns if c == "weight")), weight, names, _tasks(arcs, n * (1 + outs)), PATHS * SHARE, outs)


def augment(edges: DataFrame, radius: int, orient: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """src, dst, weight: arcs that tell the distance of every two vertices up to ``radius`` apart.

    Two such vertices have an arc of that weight, or arcs from one common vertex whose
    weights add up to it.  Edges are oriented first, by degree or as ``orient`` does.  For
    each weight w from 2 on come arcs from u to x over u -> v -> x, then those between
    two tails of one head, oriented alike among themselves, where the weights add up to w
    and no arc is there yet.
    """
    if orient is None:
        return augment_half(*_half(edges, "edges"), radius)
    return _augmented(orient(edges), radius, lambda half, n: orient(both_ways(half)))


def augment_half(half: DataFrame, n: int, radius: int) -> DataFrame:
    """``augment`` by degree over ``n`` edges told once."""
    return _augmented(orient_half(half, n), radius, orient_half)


def _augmented(first: DataFrame, radius: int, orient: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    arcs, seen = counted(first.select("src", "dst", F.lit(1).alias("weight")), "arcs")
    n = seen.n
    for w in range(2, radius + 1):
        over = _unlinked(arcs, w, ("x", "u"), True, n)
        # of two arcs between the same vertices that from the smaller one stays
        one = over.groupBy(F.least("u", "x").alias("a"), F.greatest("u", "x").alias("b")).agg(F.min("u").alias("src"))
        new, seen = counted(one.select("src", (F.col("a") + F.col("b") - F.col("src")).alias("dst"), F.lit(w).alias("weight")), "arcs")
        arcs, n = arcs.union(new), n + seen.n
        # each pair is there once, from the smaller vertex
        pairs, seen = counted(_unlinked(arcs, w, ("src", "dst"), False, n), "tails")
        new, seen = counted(orient(pairs, seen.n).select("src", "dst", F.lit(w).alias("weight")), "arcs")
        arcs, n = arcs.union(new), n + seen.n
    return arcs


def within_hops(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """id, hops of all vertices within ``radius`` edges of the seeds."""
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for r in range(1, radius + 1):
        front = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(r))
        # one hop needs no table, as nothing reads it twice
        front = staged(front, "front") if radius > 1 else front
        seen = seen.union(front)
    return seen


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component (its smallest vertex) by alternating large and small stars.

    Edges lead to the smaller vertex.  Repeated ones go in tasks of bounded rows, and those
    to a vertex of more than ``SHARE`` edges are joined by a broadcast, so no task has all
    of them.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    e, seen = counted(e, "star")
    last, before = e, None
    while True:
        lows = staged(e.groupBy("a").agg(F.min("b").alias("m")), "lows")
        low = lows.select(F.col("a").alias("b"), "m")
        hubs = F.broadcast(staged(e.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select("b"), "hubs"))  # the edges' number over SHARE at most
        some = e.join(hubs, "b", "left_semi").join(F.broadcast(low.join(hubs, "b", "left_semi")), "b", "left")
        met = e.join(hubs, "b", "left_anti").repartition(_tasks(e, seen.n), "b").join(low.repartition(_tasks(e, seen.n), "b"), "b", "left").union(some.select("b", "a", "m"))
        large, many = counted(once(met.select("a", F.coalesce("m", "b").alias("b")), seen.n), "large")
        low, parts = large.groupBy("a").agg(F.min("b").alias("m")), _tasks(e, many.n)
        small = large.repartition(parts, "a").join(low.repartition(parts, "a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e, seen = counted(once(small, 2 * many.n), "star", x=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        drop(last, lows, large)
        last, now = e, tuple(seen)
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _tasks(rows: DataFrame, n: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))


def both_ways(half: DataFrame) -> DataFrame:
    """Both directions of edges that are told once."""
    return half.select("src", "dst").union(half.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def at_end(edges: DataFrame, n: int, side: DataFrame, m: int, key: str, how: str = "inner") -> DataFrame:
    """Edges (``n`` rows) joined with a table of one row a vertex (``m`` rows), which is broadcast if it is small.

    Otherwise both are dealt out in tasks of bounded rows and the vertices are hashed: the
    edges stream by, a hub's too, and aren't sorted.
    """
    if m <= BROADCAST_ROWS:
        return edges.join(F.broadcast(side), key, how)
    parts = _tasks(edges, n)
    return edges.repartition(parts, key).join(side.repartition(parts, key).hint("shuffle_hash"), key, how)


def half_degrees(half: DataFrame) -> DataFrame:
    """id, degree of the vertices of edges that are told once."""
    return half.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def _half(edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """An undirected graph's edges told once, written, and their number."""
    half, seen = counted(edges.where("src < dst").select("src", "dst"), name)
    return half, seen.n


def peel_order(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, round, degree: in every round all vertices of at most twice the average degree left go, until none is left.

    At least half the vertices go in a round, so there are no more rounds than the
    logarithm of their number, whatever the graph, and all rounds together read a small
    multiple of its edges.  A vertex that goes has at most twice the average degree of
    what is left, which is at most four times the graph's degeneracy.
    """
    half, n = _half(edges, "peel-edges")
    known, seen = counted(_with_zeros(vertices.select("id"), half), "degrees", m=F.sum("degree"))
    out = _peel(half, n, known, seen)
    drop(half, known)
    return out


def _with_zeros(vertices: DataFrame, half: DataFrame) -> DataFrame:
    return vertices.join(half_degrees(half), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def _peel(half: DataFrame, n: int, known: DataFrame, seen: Row) -> DataFrame:
    """The rounds of ``peel_order`` over ``n`` edges told once, from the written degrees of all vertices (seen: their number n and sum m)."""
    out = Parts(half.sparkSession, "id long, round int, degree long", "peeled")
    live, d, round_, old = half, known, 0, ()
    while seen.n:
        most, round_ = 2 * seen.m // seen.n, round_ + 1
        out.add(d.where(F.col("degree") <= most).select("id", F.lit(round_).alias("round"), "degree"))
        left = d.where(F.col("degree") > most).select("id")
        m = left.count()
        if not m:
            break
        end = lambda c: left.select(F.col("id").alias(c))
        live, some = counted(at_end(at_end(live, n, end("src"), m, "src", "left_semi"), n, end("dst"), m, "dst", "left_semi").select("src", "dst"), "peel-edges")
        n = some.n
        if not n:
            # what is left has no edges, so it goes at once
            out.add(left.select("id", F.lit(round_ + 1).alias("round"), F.lit(0).cast("long").alias("degree")))
            drop(live)
            break
        d, seen = counted(_with_zeros(left, live), "degrees", m=F.sum("degree"))
        drop(*old)
        old = (live, d)
    drop(*old)
    return out.read()


def orient(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Arcs of an undirected graph from the later to the earlier vertex of a peeling order (round, then degree, then id): acyclic, and few come in anywhere."""
    at = lambda c: order.select(F.col("id").alias(c), F.struct("round", "degree", "id").alias(f"{c}_at"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").where("src_at > dst_at").select("src", "dst")


def low_degree_arcs(edges: DataFrame) -> DataFrame:
    """The acyclic orientation of an undirected graph by its peeling order: no vertex has more arcs coming in than four times the degeneracy."""
    half, n = _half(edges, "edges")
    known, seen = counted(half_degrees(half), "degrees", m=F.sum("degree"))
    out = _low_degree_arcs(half, n, known, seen)
    drop(half, known)
    return out


def _low_degree_arcs(half: DataFrame, n: int, known: DataFrame, seen: Row) -> DataFrame:
    """``orient`` by the peeling order, over edges told once."""
    order = _peel(half, n, known, seen)
    at = lambda c: order.select(F.col("id").alias(c), F.col("round").alias(f"{c}_round"), F.col("degree").alias(f"{c}_degree"))
    met = at_end(at_end(half, n, at("src"), seen.n, "src"), n, at("dst"), seen.n, "dst")
    later = F.struct("src_round", "src_degree", "src") > F.struct("dst_round", "dst_degree", "dst")
    out = staged(met.select(F.when(later, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(later, F.col("dst")).otherwise(F.col("src")).alias("dst")), "arcs")
    drop(order)
    return out


def orient_by_degree(edges: DataFrame) -> DataFrame:
    """Arcs of an undirected graph from the vertex of larger degree (then id) to that of smaller: no vertex has more than the root of twice the edges coming in."""
    return orient_half(*_half(edges, "edges"))


def orient_half(half: DataFrame, n: int) -> DataFrame:
    """``orient_by_degree`` over ``n`` edges told once."""
    known, seen = counted(half_degrees(half), "degrees")
    at = lambda c: known.select(F.col("id").alias(c), F.col("degree").alias(f"{c}_degree"))
    met = at_end(at_end(half.select("src", "dst"), n, at("src"), seen.n, "src"), n, at("dst"), seen.n, "dst")
    later = F.struct("src_degree", "src") > F.struct("dst_degree", "dst")
    return met.select(F.when(later, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(later, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def dominating_set(edges: DataFrame, vertices: DataFrame, radius: int = 1) -> DataFrame:
    """id, promoted, round: a set that dominates all vertices within ``radius`` edges.

    Vertices come in falling order of the arcs that lead into them in the low-degree
    orientation (for larger radii, with the augmented arcs), so those at the rim first;
    ties are broken by a hash of the id, which keeps rounds few on paths and grids too.
    In each round every undecided vertex that comes before all undecided vertices within
    the radius is a candidate.  A vertex with arcs to more than ``(2 * radius) ** 2``
    candidates and members is promoted: it becomes a member itself and takes the place
    of the candidates within its radius.  Candidates that are left become members, and
    what members reach is decided.  Paths lead through decided vertices too.

    Members that aren't promoted are further apart than the radius.
    """
    half, n = _half(edges, "domset-edges")
    known, seen = counted(half_degrees(half), "degrees", m=F.sum("degree"))
    members, _, near = dominators(half, n, vertices, known, seen, radius)
    drop(half, known, near)
    return members


def dominators(half: DataFrame, n: int, vertices: DataFrame, known: DataFrame, seen: Row, radius: int = 1) -> tuple[DataFrame, int, DataFrame | None]:
    """``dominating_set`` and its size, over ``n`` edges told once and the written degrees of their vertices (seen: their number n and sum m).

    At radius 1 also written rows id, dominator: every vertex next to a member with the
    smallest such member of a round, which the rounds find anyway.
    """
    spark = vertices.sparkSession
    e = both_ways(half)
    if radius == 1:
        arcs = _low_degree_arcs(half, n, known, seen)
    else:
        arcs, some = counted(augment(e, radius, low_degree_arcs).where(F.col("weight") <= radius).select("src", "dst"), "domset-arcs")
        n, known = some.n, half_degrees(arcs)
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("into"))
    most = (2 * radius) ** 2
    ends = vertices.select("id").join(known, "id", "left").join(into, "id", "left").select("id", (-F.coalesce("into", F.lit(0))).alias("d"), (F.coalesce("degree", F.lit(0)) - F.coalesce("into", F.lit(0))).alias("out"))
    left, seen = counted(ends, "undecided", busy=F.count_if(F.col("out") > most), hub_arcs=F.sum(F.when(F.col("out") > most, F.col("out"))))
    hubs, n_hubs = arcs, seen.hub_arcs or 0
    if 0 < 2 * n_hubs < n:
        hubs = staged(at_end(arcs, n, left.where(F.col("out") > most).select(F.col("id").alias("src")), seen.busy, "src", "left_semi").select("src", "dst"), "hub-arcs")
    elif n_hubs:
        n_hubs = n  # those of vertices with few arcs never count up to one too many
    members, size, round_ = Parts(spark, "id long, promoted boolean, round int", "members"), 0, 0
    tally, m = spark.createDataFrame([], "src long, n long"), seen.n
    at = lambda d, c: F.struct(F.col(d), F.xxhash64(c), F.col(c))
    ids = lambda df, c: df.select(F.col("id").alias(c))

    near = []

    def reached(seeds: DataFrame, k: int) -> DataFrame:
        if radius > 1:
            return within_hops(e, seeds, radius)
        near.append(staged(at_end(e, 2 * n, ids(seeds, "src"), k, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("dominator")), "near"))
        return near[-1].select("id").union(seeds.select("id"))

    while m:
        if radius == 1:
            # an edge between undecided vertices tells which of the two doesn't come first
            own = lambda c: left.select(F.col("id").alias(c), F.col("d").alias(f"{c}_d"))
            met = at_end(at_end(arcs, n, own("src"), m, "src"), n, own("dst"), m, "dst")
            lost = met.select(F.when(at("src_d", "src") > at("dst_d", "dst"), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()
            chosen = left.join(lost, "id", "left_anti").select("id")
        else:
            all_ = first = left.select("id", at("d", "id").alias("at"))
            for _ in range(radius):
                by = e.join(first.select(F.col("id").alias("src"), "at"), "src").select(F.col("dst").alias("id"), "at")
                first = first.union(by).groupBy("id").agg(F.min("at").alias("at"))
            chosen = all_.join(first, ["id", "at"], "left_semi").select("id")
        plain, some = counted(chosen, "candidates")
        k, up, spent = some.n, 0, [left, plain]
        if n_hubs:
            hits = at_end(hubs, n_hubs, ids(plain, "dst"), k, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("n"))
            over = tally.union(hits).groupBy("src").agg(F.sum("n").alias("n")).where(F.col("n") > most).select(F.col("src").alias("id"))
            risen, some = counted(over.join(members.read(), "id", "left_anti"), "promoted")
            up = some.n
            spent.append(risen)
        round_ += 1
        add = lambda df, promoted: members.add(df.select("id", F.lit(promoted).alias("promoted"), F.lit(round_).alias("round")))
        if up:
            add(risen, True)
            left, some = counted(left.join(reached(risen, up), "id", "left_anti"), "undecided")
            plain, m, k = plain.join(left.select("id"), "id", "left_semi"), some.n, 0
            if m:
                spent.append(left)
                plain, some = counted(plain, "new")
                k = some.n
                spent.append(plain)
        if k:
            add(plain, False)
            left, some = counted(left.join(reached(plain, k), "id", "left_anti"), "undecided")
            m = some.n
            if n_hubs and m:
                kept = at_end(hubs, n_hubs, ids(plain, "dst"), k, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("n"))
                spent.append(tally)
                tally = staged(tally.union(kept).groupBy("src").agg(F.sum("n").alias("n")), "tally")
        size += up + k
        drop(*(t for t in spent if t is not left))
    drop(left, arcs, *([] if hubs is arcs else [hubs]))
    return members.read(), size, reduce(DataFrame.union, near) if near else None


def assign_pieces(edges: DataFrame, vertices: DataFrame, dominators: DataFrame, radius: int = 1) -> DataFrame:
    """id, dominator: round by round a vertex joins the smallest dominator of its neighbours assigned before, so pieces are connected."""
    return vertices.select("id").join(pieces_of(edges, dominators, radius), "id")


def pieces_near(near: DataFrame | None, dominators: DataFrame) -> DataFrame:
    """The written table of ``assign_pieces`` at radius 1, from the rows that the rounds of ``dominators`` left."""
    own = dominators.select("id", F.col("id").alias("dominator"))
    if near is not None:
        own = own.union(near.groupBy("id").agg(F.min("dominator").alias("dominator")).join(own, "id", "left_anti"))
    return staged(own, "pieces")


def pieces_of(edges: DataFrame, dominators: DataFrame, radius: int = 1) -> DataFrame:
    """The written table of ``assign_pieces``."""
    done = dominators.select("id", F.col("id").alias("dominator"))
    for _ in range(radius):
        near = edges.join(done.select(F.col("id").alias("src"), "dominator"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("dominator").alias("dominator"))
        done = staged(done.union(near.join(done, "id", "left_anti")), "pieces")
    return done


def contract(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Edges between different dominators of adjacent vertices."""
    at = lambda c: pieces.select(F.col("id").alias(c), F.col("dominator").alias(f"{c}_dom"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").where("src_dom <> dst_dom").select(F.col("src_dom").alias("src"), F.col("dst_dom").alias("dst")).distinct()


def contract_half(half: DataFrame, n: int, pieces: DataFrame, m: int) -> DataFrame:
    """``contract`` over ``n`` edges told once and ``m`` vertices: new edges told once, in tasks of bounded rows."""
    at = lambda c: pieces.select(F.col("id").alias(c), F.col("dominator").alias(f"{c}_dom"))
    met = at_end(at_end(half, n, at("src"), m, "src"), n, at("dst"), m, "dst").where("src_dom <> dst_dom")
    new = met.select(F.least("src_dom", "dst_dom").alias("src"), F.greatest("src_dom", "dst_dom").alias("dst"))
    return once(new, n) if n > SHARE else new.distinct()


def renumber(df: DataFrame, key: str, out: str = "number") -> DataFrame:
    """Dense numbers from 0 in the order of ``key`` without one task for all rows: range partitions, their counts, and a number within each."""
    ranged = staged(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy("_part").orderBy(key)
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("before") + F.row_number().over(own) - 1).drop("_part", "before")
