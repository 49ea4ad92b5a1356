"""Regions of a hierarchy, profiles along queries, and reads by the names of their mates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import is_pair, kmer_keys
from ..operators import hierarchy, sketch
from ..operators._stage import staged
from ..operators.graph import renumber
from ..operators.index import ratio


def leaves_under(child: DataFrame, chosen: DataFrame, piece: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """region, leaf: graph nodes under each chosen node (id) of a hierarchy; ``pairs``: its ancestors where they are there already."""
    own = chosen.select(F.col("id").alias("region"), "id")
    pairs = hierarchy.ancestors(child) if pairs is None else pairs
    below = pairs.withColumnsRenamed({"anc": "region", "desc": "id"}).join(own.select("region"), "region", "left_semi")
    return own.unionByName(below).join(piece, "id").select("region", "leaf").distinct()


@dataclass
class Regions:
    """The regions (id, size), their leaves (region, leaf) and one row of totals."""

    nodes: DataFrame
    leaves: DataFrame
    summary: DataFrame


def decompose(child: DataFrame, sizes: DataFrame, piece: DataFrame, kmers_of: DataFrame, most: int, least: int) -> Regions:
    """The hierarchy cut into its highest nodes of at most ``most`` leaves, of which those with more than ``least`` k-mers stay.

    sizes (id, size in leaves), kmers_of (id, kmers).
    """
    cut = hierarchy.antichain(child, sizes, most).join(kmers_of, "id")
    nodes = staged(cut.where(F.col("kmers") > least), "regions")
    under = staged(leaves_under(child, nodes, piece), "leaves")
    total = kmers_of.agg(F.max("kmers").alias("total"))  # that of the root
    own = nodes.agg(F.count("*").alias("n_regions"), F.coalesce(F.sum("kmers"), F.lit(0)).alias("kmers"))
    n = under.agg(F.count("*").alias("n_leaves"))
    summary = own.crossJoin(n).crossJoin(total).select("n_regions", "n_leaves", "kmers", ratio(F.col("kmers"), F.col("total")).alias("share"))  # one row each
    return Regions(nodes, under, summary)


def characterise(regions: Regions, nodes: DataFrame, alphabet: str, k: int) -> DataFrame:
    """region, kmer, n: what the sequences (id, seq) of each region are made of, over all k-mers of an alphabet."""
    grouped = regions.leaves.join(nodes, regions.leaves.leaf == nodes.id).select("region", "seq")
    return sketch.composition(grouped, alphabet, k, "region")


def shadow_ratio(child: DataFrame, stats: DataFrame, piece: DataFrame, root: int, most: int, least: int, fraction: float) -> Regions:
    """Nodes of the lowest k-mers per graph node: where a graph is most tangled.

    stats (id, kmers, shadow).  Of the first nodes under the root's children with fewer
    than ``most`` k-mers, those of more than ``least`` are taken in rising order of
    (log2 of k-mers per shadow, id) while their k-mers stay within ``fraction`` of the root's.
    """
    some = hierarchy.terminal_nodes(child, stats.select("id", F.col("kmers").alias("size")), most, root).where(F.col("size") > least)
    rated = some.join(stats.select("id", "shadow"), "id").select("id", "size", hierarchy.log_ratio(F.col("size"), F.col("shadow")).alias("ratio"))
    whole = stats.where(F.col("id") == root).select(F.col("kmers").alias("size"))
    nodes = staged(hierarchy.keep_prefix(rated, fraction, whole), "kept")
    under = staged(leaves_under(child, nodes, piece), "leaves")
    return Regions(nodes, under, nodes.agg(F.count("*").alias("n_regions"), F.coalesce(F.sum("size"), F.lit(0)).alias("kmers")))


def unassembled(child: DataFrame, stats: DataFrame, piece: DataFrame, root: int, threshold: float, least: int = 0, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The highest nodes of which a query contains at most ``threshold``: their table, and their leaves (region, leaf).

    stats (id, kmers, weighted, shadow, matched).  The table holds all such nodes;
    leaves are those of nodes with at least ``least`` k-mers.
    """
    pairs = hierarchy.ancestors(child) if pairs is None else pairs
    top = hierarchy.first_below(child, stats, root, ratio(F.col("matched"), F.col("kmers")) <= threshold, pairs)
    table = staged(
        top.select("id").join(stats, "id").select(F.col("id").alias("node_id"), ratio(F.col("matched"), F.col("kmers")).alias("contained"), F.col("kmers").alias("n_kmers"), F.col("weighted").alias("n_weighted_kmers"), ratio(F.col("weighted"), F.col("kmers")).alias("average_weight"), F.col("shadow").alias("shadow_size")),
        "unassembled",
    )
    return table, leaves_under(child, table.where(F.col("n_kmers") >= least).select(F.col("node_id").alias("id")), piece, pairs)


def position_profile(queries: DataFrame, kmer_index: DataFrame, piece: DataFrame, info: DataFrame, k: int) -> DataFrame:
    """query, pos, var, neighbors, abund for every k-mer of every query (query, seq).

    neighbors: graph nodes of the dominator that holds the k-mer; var: the dominator's
    k-mers over those of this query in it; abund: the node's k-mers times its abundance
    (info: id, n_kmers, abund).  A k-mer that the index (kmer, id) lacks has zeros.
    """
    at = staged(kmer_keys(queries, "seq", k, "query").join(kmer_index, "kmer", "left"), "positions")
    inside = piece.join(info, "id")
    dom = inside.groupBy("dominator").agg(F.count("*").alias("neighbors"), F.sum("n_kmers").alias("dom_kmers"))
    asked = at.where("id is not null").select("query", "kmer", "id").distinct().join(piece, "id").groupBy("query", "dominator").agg(F.count("*").alias("own_kmers"))
    known = at.join(inside, "id", "left").join(dom, "dominator", "left").join(asked, ["query", "dominator"], "left")
    return known.select("query", "pos", ratio(F.col("dom_kmers"), F.col("own_kmers")).alias("var"), F.coalesce("neighbors", F.lit(0)).alias("neighbors"), F.coalesce(F.col("n_kmers") * F.col("abund"), F.lit(0.0)).alias("abund"))


def label_named_reads(reads: DataFrame, labels: DataFrame, k: int, expect_paired: bool = False, ignore_paired: bool = False) -> DataFrame:
    """number, id: labels of reads (number, name, seq), mates sharing theirs.

    Two reads next to each other whose names are those of mates are paired; in a chain
    of such reads (equal names) each has the labels of all before it and of the next.
    Reads shorter than k take no part.  ``expect_paired`` raises where no pair is
    found, ``ignore_paired`` looks for none.
    """
    if expect_paired and ignore_paired:
        raise ValueError("pairs are either expected or ignored")
    long_ = reads.where(F.length("seq") >= k).select("number", F.coalesce("name", F.lit("")).alias("name"))
    own = labels.join(long_.select("number"), "number", "left_semi").select("number", "id").distinct()
    if ignore_paired:
        return own
    placed = renumber(long_, "number", "place")
    # mates have one stem, so a window over each stem sees them
    named = placed.withColumns({"stem": F.regexp_replace("name", "/[12]$", ""), "alone": F.when(F.col("name") == "", F.col("place"))})  # nameless reads have no mates
    by_stem = Window.partitionBy("stem", "alone").orderBy("place")
    before = F.lag(F.struct("place", "name")).over(by_stem)
    paired = F.coalesce((before["place"] == F.col("place") - 1) & is_pair(before["name"], F.col("name")), F.lit(False))
    chain = named.withColumn("paired", paired).withColumn("chain", F.sum(F.when(F.col("paired"), 0).otherwise(1)).over(by_stem.rowsBetween(Window.unboundedPreceding, 0)))
    chain = staged(chain.withColumn("start", F.min("place").over(Window.partitionBy("stem", "alone", "chain"))).select("number", "place", "paired", "start"), "chains")
    if expect_paired and not chain.isEmpty() and chain.where("paired").isEmpty():
        raise ValueError("pairs are expected, and no two reads are a pair")
    # of a label in a chain only the first read counts
    first = own.join(chain, "number").groupBy("start", "id").agg(F.min("place").alias("first"))
    return chain.join(first, "start").where(F.col("first") <= F.col("place") + 1).select("number", "id").distinct()


def sort_nodes(nodes: DataFrame, arcs: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs with dense ids in the text order of each node's smallest hash (hashes: id, hash; ties by id); arcs without counterpart or node raise."""
    least = hashes.groupBy("id").agg(F.min("hash").cast("string").alias("least"))
    keyed = nodes.join(least, "id", "left").withColumn("_key", F.struct(F.coalesce("least", F.lit("")).alias("h"), "id"))
    at = staged(renumber(keyed, "_key").select(F.col("id").alias("old"), F.col("number").alias("new")), "order")
    end = lambda c: at.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
    moved = staged(arcs.select("src", "dst").join(end("src"), "src", "left").join(end("dst"), "dst", "left").select(F.col("src_new").alias("src"), F.col("dst_new").alias("dst")).distinct(), "arcs")
    if not moved.where("src is null or dst is null").isEmpty():
        raise ValueError("a link names a node that isn't there")
    back = moved.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if not moved.join(back, ["src", "dst"], "left_anti").isEmpty():
        raise ValueError("a link has no counterpart")
    return nodes.join(at, nodes["id"] == at["old"]).drop("id", "old").withColumnRenamed("new", "id"), moved


def audit(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, side: nodes that no leaf of a hierarchy names, and leaves that are no nodes."""
    missing = nodes.select("id").distinct().join(leaves.select(F.col("leaf").alias("id")), "id", "left_anti").withColumn("side", F.lit("no leaf"))
    extra = leaves.select(F.col("leaf").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("side", F.lit("no node"))
    return missing.union(extra)


def densely_numbered(ids: DataFrame) -> DataFrame:
    """n, last, dense: whether the ids are 0 to n - 1, each once."""
    return ids.agg(F.count("id").alias("n"), F.max("id").alias("last"), F.countDistinct("id").alias("d"), F.min("id").alias("first")).select("n", "last", F.coalesce((F.col("first") == 0) & (F.col("d") == F.col("n")) & (F.col("last") + 1 == F.col("n")), F.col("n") == 0).alias("dense"))


def ranked_counts(values: DataFrame, key: str) -> DataFrame:
    """rank (from 1), key, n: how often each value comes, the most frequent first, ties by value."""
    n = values.groupBy(key).agg(F.count("*").alias("n")).withColumn("_at", F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))
    return renumber(n, "_at").select((F.col("number") + 1).alias("rank"), key, "n")
