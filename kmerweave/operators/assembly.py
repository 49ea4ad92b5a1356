"""Unitigs: the maximal unbranched paths of a k-mer graph over both strands.

Every k-mer stands with its reverse complement as two oriented vertices; u leads to
v where the last k - 1 characters of u are the first of v.  Paths are compacted by
pointer doubling over dense ids, so the rounds grow with the logarithm of the
longest path and shuffle two numbers a vertex, not sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmers, reverse_complement
from . import graph
from ._stage import staged


@dataclass
class Unitigs:
    """nodes (id, seq, n_kmers, abund) and arcs (src, dst: both directions, self-loops left out)."""

    nodes: DataFrame
    arcs: DataFrame


def kmer_counts(reads: DataFrame, k: int, min_abund: int = 1) -> DataFrame:
    """kmer (smaller strand), n: how often it occurs on either strand; rarer ones than ``min_abund`` are left out."""
    return kmers(reads, "seq", k, both_strands=True).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= min_abund)


def _oriented(counts: DataFrame) -> DataFrame:
    """number, kmer, n, mirror (number of the reverse complement; its own if it is its own): both strands of every k-mer."""
    turned = F.col("turned")
    both = counts.withColumn("turned", reverse_complement(F.col("kmer"))).select("n", F.inline(F.array(F.struct(F.col("kmer"), turned.alias("back")), F.struct(turned.alias("kmer"), F.col("kmer").alias("back"))))).distinct()
    at = graph.renumber(both, "kmer")
    at = staged(at, "oriented")
    return staged(at.join(at.select(F.col("kmer").alias("back"), F.col("number").alias("mirror")), "back").drop("back"), "vertices")


def _follow(pointer: DataFrame) -> DataFrame:
    """number, head, steps, low: where the way back from each vertex ends, how far that is, and the smallest key on it.

    A vertex at a start points to itself.  On a cycle the way goes round it at least once.
    """
    now = staged(pointer, "pointers")
    left = None
    while True:
        far = now.select(F.col("number").alias("head"), F.col("head").alias("head2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        now = staged(now.join(far, "head").select("number", F.col("head2").alias("head"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low"), (F.col("steps2") > 0).alias("moved")), "pointers")
        moved = now.where("moved").agg(F.count("*"), F.min("steps")).first()
        now = now.drop("moved")
        # on open paths fewer move each round, so where as many moved as before they are on cycles, and have gone round once there are fewer of them than steps
        if moved[0] == 0 or (left == moved[0] and moved[1] > moved[0]):
            return now
        left = moved[0]


def compact(counts: DataFrame, k: int) -> Unitigs:
    """Unitigs of counted k-mers (kmer, n); abund is the mean of n over a unitig's k-mers.

    A k-mer that is its own reverse complement is a unitig of its own, and no path
    goes on from a k-mer to its own reverse complement.  A cycle is cut before its
    smallest k-mer.  Of a path and its mirror the one that starts with the smaller
    k-mer is given.  Ids are dense, in the order of first k-mers.
    """
    v = _oriented(counts)
    ends = v.select("number", "mirror", F.left("kmer", F.lit(k - 1)).alias("first"), F.right("kmer", F.lit(k - 1)).alias("last"))
    # at most one vertex a character of the alphabet leads on, so joins by overlap don't pile up
    steps = staged(ends.select(F.col("number").alias("u"), F.col("mirror").alias("u_back"), F.col("last").alias("o")).join(ends.select(F.col("number").alias("v"), F.col("mirror").alias("v_back"), F.col("first").alias("o")), "o").drop("o"), "steps")
    out = steps.groupBy("u").agg(F.count("*").alias("n_out"))
    into = steps.groupBy("v").agg(F.count("*").alias("n_in"))
    plain = steps.join(out.where("n_out = 1"), "u").join(into.where("n_in = 1"), "v").where("u_back <> v and u_back <> u and v_back <> v and u <> v")
    link = staged(plain.select(F.col("v").alias("number"), F.col("u").alias("head")), "links")
    key = F.least("number", "mirror")
    pointer = v.join(link, "number", "left").select("number", F.coalesce("head", "number").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("steps"), key.alias("low"))
    way = _follow(pointer)
    starts = way.where("head = number and steps = 0").select(F.col("number").alias("head"))
    round_ = staged(way.join(starts, "head", "left_anti").select("number", "low"), "cycles")
    if not round_.isEmpty():
        # both strands of a cycle are cycles; each is cut before its smallest k-mer
        cut = v.join(round_, "number").where(key == F.col("low")).select("number")
        pointer = pointer.join(cut.withColumn("cut", F.lit(True)), "number", "left").select("number", F.when(F.col("cut"), F.col("number")).otherwise(F.col("head")).alias("head"), F.when(F.col("cut"), 0).otherwise(F.col("steps")).cast("long").alias("steps"), "low")
        way = _follow(pointer)
    way = staged(way.select("number", "head", "steps").join(v, "number"), "ways")
    # a path and its mirror hold the same k-mers; the smallest of both, told by the path with the smaller head, names them
    path = way.groupBy("head").agg(F.min(F.least("number", "mirror")).alias("name"), F.max(F.struct("steps", "number")).alias("tail"), F.sum("n").alias("total"), F.count("*").alias("n_kmers"))
    path = staged(path.select("head", "name", F.col("tail.number").alias("tail"), "total", "n_kmers"), "paths")
    chosen = path.groupBy("name").agg(F.min("head").alias("head"))
    kept = staged(graph.renumber(path.join(chosen, ["name", "head"]), "head", "id"), "kept")
    # one row per unitig: the first k-mer and one character of each that follows
    letters = way.join(kept.select("head", "id"), "head").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("steps", F.when(F.col("steps") == 0, F.col("kmer")).otherwise(F.right("kmer", F.lit(1))).alias("c")))).alias("c"))
    nodes = staged(letters.join(kept, "id").select("id", F.array_join("c.c", "").alias("seq"), "n_kmers", (F.col("total") / F.col("n_kmers")).alias("abund")), "unitigs")
    # a step that no path holds leads from the tail of one oriented path to the head of another
    named = path.join(kept.select("name", "id"), "name")
    tails, heads = named.select(F.col("tail").alias("u"), F.col("id").alias("src")), named.select(F.col("head").alias("v"), F.col("id").alias("dst"))
    return Unitigs(nodes, graph.undirected(steps.join(tails, "u").join(heads, "v").select("src", "dst")))


def unitigs(reads: DataFrame, k: int, min_abund: int = 1) -> Unitigs:
    """The unitigs of reads (seq): of all their k-mers that occur ``min_abund`` times or more on either strand."""
    return compact(kmer_counts(reads, k, min_abund), k)


def contract_chains(found: Unitigs, k: int, cutoff: float = 1.1) -> Unitigs:
    """Unitigs joined over the places where pendants were: weak ends of degree 1 at most and abundance up to the cutoff.

    The pendants stay, without links, after the others.  Chains of vertices of degree
    2 that no longer branch become one unitig each: their k-mers add up and their
    abundance is the mean weighted by k-mers.
    """
    d = graph.degrees(found.arcs, found.nodes).where("degree <= 1").select("id")
    weak = staged(found.nodes.where(F.col("abund") <= cutoff).join(d, "id", "left_semi").select("id"), "pendants")
    strong = found.nodes.join(weak, "id", "left_anti")
    # the sum over k-mers of a unitig's mean is its total again
    again = compact(kmers(strong, "seq", k, "abund", both_strands=True).groupBy("kmer").agg(F.sum("abund").alias("n")), k)
    nodes = staged(again.nodes, "contracted")
    own = graph.renumber(found.nodes.join(weak, "id", "left_semi"), "id", "place")
    pendants = own.select((F.col("place") + nodes.count()).alias("id"), "seq", "n_kmers", "abund")
    return Unitigs(nodes.unionByName(pendants), again.arcs)


def directed_path(first: str, last: str, seq: str, k: int):
    """Whether two neighbours attach at opposite ends of a sequence: one before it, one behind it (on either strand)."""
    from ..functions.sequence import end_match

    at = lambda other, end: end_match(F.col(seq), F.col(other), k, f"{end}p")["match"] | end_match(F.col(seq), F.col(other), k, f"{end}s")["match"]
    return (at(first, "p") & at(last, "s")) | (at(first, "s") & at(last, "p"))
