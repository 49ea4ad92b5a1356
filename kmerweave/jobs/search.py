"""End-to-end searches over a node table, its k-mer index and a hierarchy's pieces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmer_keys, kmers, translate_frames
from ..operators import annotate, hierarchy, index
from ..operators._stage import checked, staged


@dataclass
class Search:
    """Matches (id, matches), neighbourhood (id), its records, the summary row and the response curve."""

    matches: DataFrame
    ids: DataFrame
    records: DataFrame
    summary: DataFrame
    curve: DataFrame


def neighborhood_search(nodes: DataFrame, kmer_index: DataFrame, piece: DataFrame, queries: DataFrame, k: int) -> Search:
    """Sequence query: k-mers to nodes, nodes to dominators, dominators to all their nodes.

    nodes (id, seq), kmer_index (kmer, id), piece (id, dominator), queries (query,
    seq).  A query without k-mers or matches gives an empty neighbourhood and zeros.
    """
    wanted = staged(index.query_kmers(queries, k), "wanted")
    found = staged(index.matches(kmer_index, wanted), "matches")
    near = staged(annotate.neighborhood(found, piece), "near")
    records = annotate.extract(near, nodes)
    sizes = index.node_sizes(nodes, k)
    parts = near.join(sizes, "id").join(found, "id", "left").withColumns({"cont": F.coalesce("matches", F.lit(0)), "oh": F.col("n_kmers") - F.coalesce("matches", F.lit(0))})
    by_dom = parts.join(piece, "id").groupBy(F.col("dominator").alias("id")).agg(F.sum("cont").alias("cont"), F.sum("oh").alias("oh"))
    total = parts.agg(F.coalesce(F.sum("cont"), F.lit(0)).alias("n_matched"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("n_kmers"), F.count("*").alias("n_nodes"))
    asked = wanted.select("kmer").distinct().agg(F.count("*").alias("num_query_kmers"))
    length = records.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bp"))
    summary = total.crossJoin(asked).crossJoin(length)  # one row each
    summary = summary.withColumns({"best_containment": index.ratio(F.col("n_matched"), F.col("num_query_kmers")), "overhead": index.ratio(F.col("n_kmers") - F.col("n_matched"), F.col("n_kmers"))})
    return Search(found, near, records, summary, hierarchy.response_curve(by_dom))


def exact_search(nodes: DataFrame, kmer_index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Records of matched nodes, without expansion."""
    return annotate.extract(index.matches(kmer_index, index.query_kmers(queries, k)), nodes)


def protein_search(nodes: DataFrame, queries: DataFrame, k: int, translate_query: bool = False) -> DataFrame:
    """id: nodes one of whose six reading frames shares a k-mer of amino acids with a query.

    queries (query, seq) are proteins, or nucleotides to be translated.
    """
    frames = lambda df, *keep: df.select(*keep, F.explode(translate_frames(F.col("seq"))).alias("seq"))
    asked = frames(queries, "query") if translate_query else queries
    wanted = checked(kmers(asked, "seq", k).select("kmer").distinct())
    return kmers(frames(nodes, "id"), "seq", k, "id").join(wanted, "kmer", "left_semi").select("id").distinct()


def hash_search(sketches: DataFrame, piece: DataFrame, hashes: DataFrame) -> DataFrame:
    """hash, id: nodes in the neighbourhood of the nodes that hold each hash; hashes that nothing holds have no row."""
    hits = hashes.select("hash").distinct().join(sketches, "hash").select(F.col("hash").alias("record"), "id")
    return annotate.annotate(hits, piece).withColumnRenamed("record", "hash")


def sample_abundance(kmer_index: DataFrame, sizes: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """id, abund, size: occurrences of each node's k-mers in a sample's records, repeats counted; nodes without any have 0."""
    return _with_sizes(sizes, kmer_keys(sample, "seq", k).groupBy("kmer").agg(F.count("*").alias("n")).join(kmer_index, "kmer").groupBy("id").agg(F.sum("n").alias("abund")))


def own_abundance(nodes: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """The same for nodes (id, seq) whose index isn't at hand."""
    return _with_sizes(index.node_sizes(nodes, k), index.own_hits(nodes, sample, k))


def _with_sizes(sizes: DataFrame, hit: DataFrame) -> DataFrame:
    return sizes.join(hit, "id", "left").select("id", F.coalesce("abund", F.lit(0)).alias("abund"), F.col("n_kmers").alias("size"))


def level_abundance(abund: DataFrame, piece: DataFrame, child: DataFrame, level: DataFrame) -> DataFrame:
    """dom_id, level, abund, size: a sample's abundance under every node of a hierarchy.

    abund (id, abund, size), piece (id: level-1 node, leaf), child (parent, child),
    level (id, level).  Sums go up one level at a time, so each step reads what the
    last one left.  A child of the root that ends below the others stands at the
    levels between too, so every level but the root's holds all leaves once.
    """
    top = level.agg(F.max(F.struct("level", "id")).alias("t")).select("t.level", "t.id").first()
    if top is None or top.level is None:
        return level.select(F.col("id").alias("dom_id"), "level", F.lit(0).cast("long").alias("abund"), F.lit(0).cast("long").alias("size"))
    now = piece.join(abund.select(F.col("id").alias("leaf"), "abund", "size"), "leaf").groupBy("id").agg(F.sum("abund").alias("abund"), F.sum("size").alias("size"))
    up = child.select(F.col("child").alias("id"), "parent")
    out = None
    for k in range(1, top.level):
        now = staged(now.withColumn("level", F.lit(k)), "level")
        out = now if out is None else out.unionByName(now)
        now = now.join(up, "id").where(F.col("parent") != top.id).groupBy(F.col("parent").alias("id")).agg(F.sum("abund").alias("abund"), F.sum("size").alias("size"))
    under_root = child.where(F.col("parent") == top.id).select(F.col("child").alias("id"), F.lit(top.level - 1).alias("last"))
    each = out.join(under_root, "id", "left").select(F.col("id").alias("dom_id"), F.explode(F.sequence("level", F.coalesce("last", "level"))).alias("level"), "abund", "size")
    whole = out.join(under_root, "id").agg(F.sum("abund").alias("abund"), F.sum("size").alias("size")).select(F.lit(top.id).alias("dom_id"), F.lit(top.level).alias("level"), F.coalesce("abund", F.lit(0)).alias("abund"), F.coalesce("size", F.lit(0)).alias("size"))
    return each.unionByName(whole)
