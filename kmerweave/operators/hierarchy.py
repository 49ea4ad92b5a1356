"""Trees of nodes over leaves: closures, rollups, cuts and response curves.

A hierarchy is ``child`` (parent, child) and ``level`` (id, level; level 1 holds
the leaves' owners).  ``piece`` (id, leaf) gives the leaves under level 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._stage import counted, drop, staged
from .graph import once
from .index import ratio

#: Rounds of doubling: a tree of 2**40 levels is a cycle.
MOST_ROUNDS = 40


def ancestors(child: DataFrame) -> DataFrame:
    """anc, desc: all pairs with one or more steps between them, for any depth.

    Ancestor doubling: each round joins the pairs of exactly d steps with those of 1 to
    d, and with themselves, so the rounds are the logarithm of the depth.  A node may
    have several parents; where none has, no pair comes twice and none is looked for.
    A cycle raises.
    """
    several = not child.groupBy("child").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()

    def set_of(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The distinct pairs and their number, in tasks of bounded memory."""
        raw, some = counted(rows, name, loops=F.count_if(F.col("anc") == F.col("desc")))
        if some.loops:
            raise ValueError("the parents of some node lead back to it")
        if not several:
            return raw, some.n
        out, seen = counted(once(raw, some.n), name)
        drop(raw)
        return out, seen.n

    exact, _ = set_of(child.select(F.col("parent").alias("anc"), F.col("child").alias("desc")), "steps")
    all_ = exact
    for _ in range(MOST_ROUNDS):
        upper = exact.select("anc", F.col("desc").alias("mid"))
        far, n = set_of(upper.join(exact.withColumnRenamed("anc", "mid"), "mid").select("anc", "desc"), "steps")
        longer = upper.join(all_.withColumnRenamed("anc", "mid"), "mid").select("anc", "desc")
        wider, _ = set_of(all_.union(longer), "ancestors")
        drop(*{id(t): t for t in (exact, all_)}.values())
        if not n:
            drop(far)
            return wider
        exact, all_ = far, wider
    raise ValueError("the parents of some node lead back to it")


def closure(child: DataFrame, level: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """anc, desc: every node with itself and all level-1 nodes below, whatever the depth; ``pairs``: ``ancestors`` where they are there already."""
    ones = level.where("level = 1").select("id")
    pairs = ancestors(child) if pairs is None else pairs
    below = pairs.join(ones.withColumnRenamed("id", "desc"), "desc", "left_semi").select("anc", "desc")
    # pairs below are distinct and of two nodes
    return below.union(ones.distinct().select(F.col("id").alias("anc"), F.col("id").alias("desc")))


def rollup(anc: DataFrame, leaves: DataFrame, *values: str) -> DataFrame:
    """id, sums of the values of the level-1 nodes below (column id of leaves)."""
    # sums per level-1 node first, so the closure multiplies one row per node
    own = leaves.groupBy("id").agg(*(F.sum(v).alias(v) for v in values))
    return anc.join(own, anc.desc == own.id).groupBy(F.col("anc").alias("id")).agg(*(F.sum(v).alias(v) for v in values))


def level_totals(values: DataFrame, level: DataFrame, value: str) -> DataFrame:
    """level, n, total: every level of a complete tree has one total."""
    return values.join(level, "id").groupBy("level").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def antichain(child: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """id, size: the first node on every path from the root with a size of ``most`` or less; a leaf of the tree counts whatever its size.

    Sizes grow towards the root, so a node qualifies if it fits and its parent doesn't.
    """
    parent = child.select(F.col("child").alias("id"), "parent")
    inner = child.select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    p = sizes.select(F.col("id").alias("parent"), F.col("size").alias("parent_size"))
    all_ = sizes.join(parent, "id", "left").join(p, "parent", "left").join(inner, "id", "left")
    fits = (F.col("size") <= most) | F.col("inner").isNull()
    return all_.where(fits & (F.col("parent").isNull() | (F.col("parent_size") > most))).select("id", "size")


def terminal_nodes(child: DataFrame, sizes: DataFrame, most: int, root: int) -> DataFrame:
    """id, size: first nodes under the root's children on with a size below ``most``; larger leaves vanish."""
    parent = child.select(F.col("child").alias("id"), "parent")
    p = sizes.select(F.col("id").alias("parent"), F.col("size").alias("parent_size"))
    return sizes.join(parent, "id").join(p, "parent").where((F.col("size") < most) & ((F.col("parent") == root) | (F.col("parent_size") >= most))).select("id", "size")


def first_below(child: DataFrame, values: DataFrame, root: int, holds, pairs: DataFrame | None = None) -> DataFrame:
    """id: nodes that hold, no ancestor of which (but the root) does; for conditions that don't grow towards the root."""
    good = staged(values.where(holds).where(F.col("id") != root).select("id"), "good")
    pairs = ancestors(child) if pairs is None else pairs
    under = pairs.join(good.withColumnRenamed("id", "anc"), "anc", "left_semi").select(F.col("desc").alias("id")).distinct()
    return good.join(under, "id", "left_anti")


def running(df: DataFrame, order: list, **sums) -> DataFrame:
    """All columns and running sums in an order without ties: sums of range partitions first, then within each, so no task sees all rows."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumns({f"_{name}": value for name, value in sums.items()}), "ranged")
    parts = ranged.groupBy("_part").agg(*(F.sum(f"_{name}").alias(name) for name in sums))  # one row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").select(*df.columns, *((F.col(f"{name}_before") + F.sum(f"_{name}").over(own)).alias(name) for name in sums))


def response_curve(parts: DataFrame) -> DataFrame:
    """Running sums over nodes with contained k-mers, in falling order of (cont, oh, id): place, id, cont, oh, sum_cont, sum_oh, and both as shares of all contained k-mers."""
    some = parts.where("cont > 0").select("id", "cont", "oh")
    total = some.agg(F.sum("cont").alias("_total"))
    curve = running(some, [F.desc("cont"), F.desc("oh"), F.desc("id")], place=F.lit(1), sum_cont=F.col("cont"), sum_oh=F.col("oh")).crossJoin(F.broadcast(total))
    return curve.select("place", "id", "cont", "oh", "sum_cont", "sum_oh", ratio(F.col("sum_cont"), F.col("_total")).alias("relative_cont"), ratio(F.col("sum_oh"), F.col("_total")).alias("relative_oh"))


def sampled(curve: DataFrame, points: int = 200) -> DataFrame:
    """About ``points`` rows of a curve, the first and the last among them."""
    n = curve.agg(F.max("place").alias("last"))
    rate = F.greatest(F.floor(F.col("last") / points), F.lit(1))
    return curve.crossJoin(F.broadcast(n)).where(((F.col("place") - 1) % rate == 0) | (F.col("place") == F.col("last"))).drop("last")


def keep_prefix(nodes: DataFrame, fraction: float, whole: DataFrame | None = None) -> DataFrame:
    """id, size, ratio of nodes in rising order of (ratio, id) while the running size stays within the fraction of the total: that of the nodes, or the one row (size) of ``whole``."""
    total = (nodes if whole is None else whole).agg((F.sum("size") * fraction).alias("_most"))
    some = running(nodes.select("id", "size", "ratio"), [F.col("ratio"), F.col("id")], upto=F.col("size"))
    return some.crossJoin(F.broadcast(total)).where(F.col("upto") <= F.col("_most")).select("id", "size", "ratio")


def log_ratio(part, whole):
    """log2(part) - log2(whole)."""
    return F.log2(part.cast("double")) - F.log2(whole.cast("double"))
