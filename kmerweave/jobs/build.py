"""Building the hierarchy of dominating sets over a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators._stage import BROADCAST_ROWS, counted, drop, staged


@dataclass
class Hierarchy:
    """nodes (id, level, vertex), child (parent, child) and piece (id, leaf: level-1 node and graph vertex)."""

    nodes: DataFrame
    child: DataFrame
    piece: DataFrame


class _Levels:
    """The tables of finished levels in a folder, one folder a level; without a folder they are only staged."""

    PARTS = ("nodes", "child", "waiting", "below", "edges")

    def __init__(self, spark, folder: str | None):
        self.spark, self.folder = spark, folder

    def _at(self, level: int, part: str) -> str:
        return f"{self.folder}/level={level}/{part}"

    def _has(self, level: int) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(level, "done"))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def last(self, most: int | None) -> int:
        """The last level up to ``most`` that is finished, like all below it."""
        level = 0
        while self.folder and (most is None or level < most) and self._has(level + 1):
            level += 1
        return level

    def write(self, level: int, **parts: DataFrame) -> dict[str, DataFrame]:
        """The parts in the folder; without one as they are, of written tables."""
        if not self.folder:
            return parts
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(self._at(level, name))
        # the mark comes last, so a level that was cut short is built again
        self.spark.range(1).write.mode("overwrite").parquet(self._at(level, "done"))
        return self.read(level)

    def read(self, level: int) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(self._at(level, name)) for name in self.PARTS}


def build_hierarchy(edges: DataFrame, vertices: DataFrame, radius: int = 1, top: int = 10, folder: str | None = None, resume: int | None = None) -> Hierarchy:
    """Dominators of dominators until at most ``top`` vertices are left or nothing shrinks; a root above all.

    Level 1 has the given radius, higher ones radius 1.  Ids follow the order of
    dominators within a level.  Dominators without neighbours become children of
    the root at once.  Every level is a written table, so a lost executor costs one
    level at most; the number of levels grows with the logarithm of the graph.  Within
    the build an edge is told once, from the smaller vertex, and written once a level;
    the degrees that tell which dominators have neighbours begin the next level.

    With a ``folder`` the levels stay there, and a build over the same graph goes on
    after the last finished one, or after level ``resume`` (0 starts anew).
    """
    spark = vertices.sparkSession
    saved = _Levels(spark, folder)
    done = saved.last(resume)
    first_id, level, size, ended = 0, 0, None, False
    nodes = child = piece = waiting = below = known = None
    e, v = edges, vertices.select("id")
    if not done:
        v, seen = counted(v, "level-vertices")
        size = seen.n
    add = lambda all_, more: more if all_ is None else all_.unionByName(more)
    while not ended:
        level += 1
        reach = radius if level == 1 else 1
        if level <= done:
            parts = saved.read(level)
            if level == 1:
                size = vertices.count()
            n, left = parts["nodes"].count(), parts["below"].count()
        else:
            if known is None:  # the first level that is built
                e, seen = counted(e.where("src < dst").select("src", "dst"), "level-edges")
                n_edges = seen.n
                known, ends = counted(graph.half_degrees(e), "degrees", m=F.sum("degree"))
            members, n, near = graph.dominators(e, n_edges, v, known, ends, reach)
            chosen = F.broadcast(members) if n <= BROADCAST_ROWS else members
            pieces = graph.pieces_near(near, chosen) if reach == 1 else graph.pieces_of(graph.both_ways(e), chosen, reach)
            dom_edges, seen = counted(graph.contract_half(e, n_edges, pieces, size), "level-edges")
            n_edges, old = seen.n, [known, e]
            known, ends = counted(graph.half_degrees(dom_edges), "degrees", m=F.sum("degree"))
            left = ends.n
            number = graph.renumber(members.select("id"), "id").select((F.col("number") + first_id).alias("node"), F.col("id").alias("vertex"))
            new = staged(number.join(known.select(F.col("id").alias("vertex"), F.lit(True).alias("linked")), "vertex", "left").select("node", "vertex", "linked"), "nodes")
            at = new.select("node", F.col("vertex").alias("dominator"))
            up = pieces.join(F.broadcast(at) if n <= BROADCAST_ROWS else at, "dominator")
            under = up.select(F.col("node").alias("parent"), F.col("id").alias("child")) if level == 1 else up.join(below.select(F.col("vertex").alias("id"), F.col("node").alias("child")), "id").select(F.col("node").alias("parent"), "child")
            under = under if folder else staged(under, "level-child")
            parts = saved.write(
                level,
                nodes=new.select(F.col("node").alias("id"), F.lit(level).alias("level"), "vertex"),
                child=under,
                waiting=new.where("linked is null").select("node"),
                below=new.where("linked").select("vertex", "node"),
                edges=dom_edges,
            )
            drop(pieces, members, near, *old, *([new] if folder else []))
        first_id += n
        nodes, waiting = add(nodes, parts["nodes"]), add(waiting, parts["waiting"])
        if level == 1:
            piece = parts["child"].toDF("id", "leaf")
        else:
            child = add(child, parts["child"])
        # a level built before has its edges in the folder, perhaps in both directions
        below, e = parts["below"], dom_edges if level > done else parts["edges"]
        v = below.select(F.col("vertex").alias("id"))
        ended = left <= top or n >= size
        size = left
    if level > done:
        drop(known, dom_edges)
    waiting = add(waiting, below.select("node"))
    root = spark.range(1).select(F.lit(first_id).cast("long").alias("id"), F.lit(level + 1).alias("level"), F.lit(None).cast("long").alias("vertex"))
    to_root = waiting.select(F.lit(first_id).cast("long").alias("parent"), F.col("node").alias("child"))
    return Hierarchy(nodes.unionByName(root), add(child, to_root), piece)
