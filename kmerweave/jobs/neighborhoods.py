"""Searches of many queries at once: every table has a row per query and what it found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy, index
from ..operators._stage import staged


@dataclass
class Searches:
    """matches (query, id, matches), doms (query, dominator), near (query, id), sketch (query, hash of its neighbourhood) and results, one row per query."""

    matches: DataFrame
    doms: DataFrame
    near: DataFrame
    sketch: DataFrame
    results: DataFrame


def search_each(nodes: DataFrame, kmer_index: DataFrame, piece: DataFrame, queries: DataFrame, k: int, sketcher: Callable[[DataFrame, str], DataFrame], name: str = "") -> Searches:
    """Every query on its own: k-mers to nodes, nodes to dominators, dominators to all their nodes.

    nodes (id, seq), kmer_index (kmer, id), piece (id, dominator), queries (query, seq),
    of which several records may share a query.  ``sketcher`` gives (key, hash) of the
    records of a table by the named key.  Containment and similarity are those of the
    query's sketch and that of its neighbourhood; ``best_containment`` is exact, and the
    overheads are the k-mers that matched nodes, or matched dominators, have beside the
    query's.  A query without k-mers, matches or hashes has zeros.
    """
    wanted = staged(index.query_kmers(queries, k), "wanted")
    found = staged(wanted.join(kmer_index, "kmer").groupBy("query", "id").agg(F.count("*").alias("matches")), "matches")
    doms = staged(found.join(piece, "id").select("query", "dominator").distinct(), "query-dominators")
    near = staged(doms.join(piece, "dominator").select("query", "id").distinct(), "near")
    sizes = staged(index.node_sizes(nodes, k), "sizes")
    # hashes per dominator first, so a node's are read once for all queries
    of_doms = sketcher(nodes, "id").select("id", "hash").join(piece, "id").select("dominator", "hash").distinct()
    sketch = staged(doms.join(of_doms, "dominator").select("query", "hash").distinct(), "near-sketch")
    own = staged(sketcher(queries, "query").select("query", "hash").distinct(), "query-sketch")
    of_dom = piece.join(sizes, "id").groupBy("dominator").agg(F.sum("n_kmers").alias("n"))
    parts = [
        wanted.groupBy("query").agg(F.count("*").alias("num_query_kmers")),
        found.join(sizes, "id").groupBy("query").agg(F.sum("matches").alias("matched"), F.sum("n_kmers").alias("node_kmers")),
        doms.join(of_dom, "dominator").groupBy("query").agg(F.sum("n").alias("dom_kmers")),
        near.join(nodes.select("id", F.length("seq").alias("bp")), "id").groupBy("query").agg(F.count("*").alias("contigs"), F.sum("bp").alias("bp")),
        own.groupBy("query").agg(F.count("*").alias("own")),
        sketch.groupBy("query").agg(F.count("*").alias("others")),
        own.join(sketch, ["query", "hash"]).groupBy("query").agg(F.count("*").alias("both")),
    ]
    all_ = queries.select("query").distinct()
    for part in parts:
        all_ = all_.join(part, "query", "left")
    c = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    over = lambda whole: index.ratio(c(whole) - c("matched"), c(whole))
    results = all_.select(
        "query",
        index.ratio(c("both"), c("own")).alias("containment"),
        index.ratio(c("both"), c("own") + c("others") - c("both")).alias("similarity"),
        c("bp").alias("bp"),
        c("contigs").alias("contigs"),
        F.lit(k).alias("ksize"),
        c("num_query_kmers").alias("num_query_kmers"),
        index.ratio(c("matched"), c("num_query_kmers")).alias("best_containment"),
        over("node_kmers").alias("cdbg_min_overhead"),
        over("dom_kmers").alias("catlas_min_overhead"),
        F.lit(name).alias("catlas_name"),
    )
    return Searches(found, doms, near, sketch, results)


def reads_of(doms: DataFrame, piece: DataFrame, labels: DataFrame, *read: str) -> DataFrame:
    """query and read columns: the reads labelled (read columns, id) with a node under a query's dominators, once each.

    Labels are summed up per dominator first, so a read of many nodes is few rows.
    """
    of_doms = labels.join(piece, "id").select("dominator", *read).distinct()
    return doms.join(of_doms, "dominator").select("query", *read).distinct()


def records_of(found: DataFrame, records: DataFrame, *read: str) -> DataFrame:
    """The records of the reads found, with the query and all their columns (quality too, where there is one)."""
    return found.join(records, list(read))


def query_abundances(matches: DataFrame, info: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """query, n_found, containment, mean_abund weighted by matches; queries of less than the least containment have no row."""
    asked = wanted.groupBy("query").agg(F.count("*").alias("asked"))
    sums = matches.join(info, "id").groupBy("query").agg(F.sum("matches").alias("n_found"), F.sum(F.col("matches") * F.col("abund")).alias("w"))
    rows = asked.join(sums, "query").select("query", "n_found", index.ratio(F.col("n_found"), F.col("asked")).alias("containment"), index.ratio(F.col("w"), F.col("n_found")).alias("mean_abund"))
    return rows.where(F.col("containment") >= least)


def node_info(matches: DataFrame, piece: DataFrame, child: DataFrame, level: DataFrame, sizes: DataFrame, root: int, most: int, least: int) -> DataFrame:
    """query, node_id, contained, n_kmers, n_weighted_kmers, shadow_size: where in a hierarchy every query is.

    Of the first nodes under the root's children with fewer than ``most`` k-mers those of
    more than ``least`` are told, for every query (matches: query, id, matches).  piece
    (id: level-1 node, leaf), sizes (leaf, n_kmers, weighted), child (parent, child), level
    (id, level).  Nodes that a query doesn't touch have 0 contained.
    """
    anc = staged(hierarchy.closure(child, level), "closure")
    own = piece.join(sizes, "leaf").groupBy("id").agg(F.sum("n_kmers").alias("n_kmers"), F.sum("weighted").alias("n_weighted_kmers"), F.count("*").alias("shadow_size"))
    stats = staged(hierarchy.rollup(anc, own, "n_kmers", "n_weighted_kmers", "shadow_size"), "stats")
    some = hierarchy.terminal_nodes(child, stats.select("id", F.col("n_kmers").alias("size")), most, root).where(F.col("size") > least)
    told = staged(some.select("id").join(stats, "id"), "told")
    # matches per level-1 node and query before they meet the closure
    low = matches.withColumnRenamed("id", "leaf").join(piece, "leaf").groupBy("query", F.col("id").alias("desc")).agg(F.sum("matches").alias("n"))
    hit = low.join(anc.join(told.select(F.col("id").alias("anc")), "anc", "left_semi"), "desc").groupBy("query", F.col("anc").alias("id")).agg(F.sum("n").alias("n"))
    # a row for every query and told node: the report is their product
    every = matches.select("query").distinct().crossJoin(told)
    return every.join(hit, ["query", "id"], "left").select("query", F.col("id").alias("node_id"), index.ratio(F.coalesce("n", F.lit(0)), F.col("n_kmers")).alias("contained"), "n_kmers", "n_weighted_kmers", "shadow_size")


def hash_results(hits: DataFrame, nodes: DataFrame, sketch: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """hashval, bp, contigs of the nodes (hits: hash, id) in every hash's neighbourhood, and with a ``sketch`` their hashes (hashval, hash)."""
    results = hits.join(nodes.select("id", F.length("seq").alias("bp")), "id").groupBy(F.col("hash").alias("hashval")).agg(F.sum("bp").cast("long").alias("bp"), F.count("*").alias("contigs"))
    if sketch is None:
        return results, None
    own = sketch(nodes, "id").select("id", F.col("hash").alias("found"))
    return results, hits.join(own, "id").select(F.col("hash").alias("hashval"), F.col("found").alias("hash")).distinct()
