"""Neighbourhoods, annotation, abundance, reads and taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._stage import checked
from .index import ratio


def promote(ids: DataFrame, piece: DataFrame) -> DataFrame:
    """dominator of each node: distinct dominators."""
    return piece.join(ids.select("id").distinct(), "id", "left_semi").select("dominator").distinct()


def neighborhood(ids: DataFrame, piece: DataFrame) -> DataFrame:
    """id: all nodes under the dominators of the given ones."""
    return piece.join(promote(ids, piece), "dominator", "left_semi").select("id").distinct()


def new_nodes(ids: DataFrame, piece: DataFrame) -> DataFrame:
    """id: nodes of the neighbourhood that weren't given."""
    return neighborhood(ids, piece).join(ids.select("id"), "id", "left_anti")


def extract(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The records of the given nodes; where these are few, no record is shuffled."""
    return nodes.join(checked(ids.select("id").distinct()), "id", "left_semi")


def pair_reads(labels: DataFrame, reads: DataFrame, group: str, order: str) -> DataFrame:
    """group, pair (order of its first read), id: mates are neighbours in order of different role, and both get the union of their labels.

    A read takes part in one pair at most: every second neighbour pair of a run starts one.
    """
    own = Window.partitionBy(group).orderBy(order)
    p = reads.withColumn("prev", F.lag("role").over(own)).withColumn("brk", F.when(F.col("prev").isNull() | (F.col("prev") == F.col("role")), 1).otherwise(0))
    p = p.withColumn("run", F.sum("brk").over(own)).withColumn("k", F.row_number().over(Window.partitionBy(group, "run").orderBy(order)) - 1)
    p = p.withColumn("pair", F.min(order).over(Window.partitionBy(group, "run", F.floor(F.col("k") / 2))))
    return p.select(group, order, "pair").join(labels, [group, order]).select(group, "pair", "id").distinct()


def annotate(hits: DataFrame, piece: DataFrame) -> DataFrame:
    """record, id: nodes in the neighbourhood of each record's matches (record, id)."""
    doms = hits.join(piece, "id").select("record", "dominator").distinct()
    return doms.join(piece, "dominator").select("record", "id").distinct()


def record_abundance(annotation: DataFrame, info: DataFrame) -> DataFrame:
    """record, total_kmers, mean_abund: k-mers of a record's nodes and their abundance, weighted by k-mers."""
    return annotation.join(info, "id").groupBy("record").agg(F.sum("n_kmers").alias("total_kmers"), ratio(F.sum(F.col("n_kmers") * F.col("abund")), F.sum("n_kmers")).alias("mean_abund"))


def number_records(records: DataFrame, key: str) -> DataFrame:
    """key, number: dense numbers from 0 over records that have a row, in order of the key."""
    from .graph import renumber

    return renumber(records.select(key).distinct(), key)


def query_abundance(matched: DataFrame, info: DataFrame, least: float = 0.5, wanted: int | None = None) -> DataFrame:
    """n_found, containment, mean_abund weighted by matches; no row below the least containment."""
    found = matched.join(info, "id").agg(F.sum("matches").alias("n_found"), F.sum(F.col("matches") * F.col("abund")).alias("w"))
    return found.select("n_found", ratio(F.col("n_found"), F.lit(wanted)).alias("containment"), ratio(F.col("w"), F.col("n_found")).alias("mean_abund")).where(F.col("containment") >= least)


def purity(hits: DataFrame, group: str, ranks: list[str], hit: str | None = None) -> DataFrame:
    """group, rank, taxon, share: of each rank the most frequent lineage prefix and its share; ties to the smaller prefix.

    ``hits`` has one row per hit with a column per rank.  With a key ``hit`` it has one
    row per hit and lineage: the most frequent prefix is still that of most rows, but
    its share is that of hits with it among all hits, so several lineages of one hit
    count once.
    """
    prefixes = F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.concat_ws(";", *ranks[: i + 1]).alias("taxon")) for i in range(len(ranks))))
    each = hits.select(group, *([hit] if hit else []), F.inline(prefixes))
    if hit:
        # per hit first, so a group is no larger than its hits
        each = each.groupBy(group, "rank", hit, "taxon").agg(F.count("*").alias("rows"))
        n = each.groupBy(group, "rank", "taxon").agg(F.sum("rows").alias("n"), F.count("*").alias("own"))
        all_ = hits.groupBy(group).agg(F.countDistinct(hit).alias("all"))
        best = n.groupBy(group, "rank").agg(F.min(F.struct((-F.col("n")).alias("m"), "taxon", "own")).alias("b")).join(all_, group)
        return best.select(group, "rank", F.col("b.taxon").alias("taxon"), ratio(F.col("b.own"), F.col("all")).alias("share"))
    n = each.groupBy(group, "rank", "taxon").agg(F.count("*").alias("n"))
    best = n.groupBy(group, "rank").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("m"), "taxon")).alias("b"))
    return best.select(group, "rank", F.col("b.taxon").alias("taxon"), ratio(-F.col("b.m"), F.col("all")).alias("share"))


def pure_rank(purities: DataFrame, group: str) -> DataFrame:
    """group, rank: the first (finest) rank up to which the group is pure, 0 if none."""
    return purities.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("share") == 1.0, F.col("rank"))), F.lit(0)).alias("rank"))


def lca(hits: DataFrame, group: str, ranks: list[str]) -> DataFrame:
    """group, rank, lineage: the longest prefix that all lineages of a group share."""
    same = [F.min(F.concat_ws(";", *ranks[: i + 1])) == F.max(F.concat_ws(";", *ranks[: i + 1])) for i in range(len(ranks))]
    depth = F.lit(0)
    for i, s in enumerate(same):
        depth = F.when(s, i + 1).otherwise(depth)
    agg = hits.groupBy(group).agg(depth.alias("rank"), F.min(F.struct(*ranks)).alias("l"))
    return agg.select(group, "rank", F.array_join(F.slice(F.array(*(F.col(f"l.{r}") for r in ranks)), F.lit(1), F.col("rank")), ";").alias("lineage"))


def hash_lineages(sketches: DataFrame, lineages: DataFrame) -> DataFrame:
    """hash, lineages (distinct, in order) and lca (the longest prefix that all share), from sketches (name, hash) and lineages (name, lineage array).

    Hashes of unknown names are left out.  A hash holds no more lineages than there are.
    """
    each = sketches.select("name", "hash").distinct().join(lineages.select("name", "lineage"), "name").select("hash", "lineage").distinct()
    all_ = each.groupBy("hash").agg(F.sort_array(F.collect_list("lineage")).alias("lineages"))
    # sorted, so a prefix that the first and the last share is shared by all
    a, z = F.element_at("lineages", 1), F.element_at("lineages", -1)
    least = F.least(F.size(a), F.size(z))
    apart = F.array_position(F.transform(F.slice(a, F.lit(1), least), lambda x, i: x == F.get(z, i)), False)
    return all_.select("hash", "lineages", F.slice(a, F.lit(1), F.when(apart > 0, apart.cast("int") - 1).otherwise(least)).alias("lca"))


def multiplicity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """times (0, 1 or 2 for more), n: how often each key of the left side is found on the right."""
    found = left.select(key).distinct().join(right.groupBy(key).agg(F.count("*").alias("m")), key, "left")
    return found.groupBy(F.least(F.coalesce("m", F.lit(0)), F.lit(2)).cast("int").alias("times")).agg(F.count("*").alias("n"))
