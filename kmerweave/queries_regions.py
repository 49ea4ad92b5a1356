"""Composed jobs over regions, positions and reads as queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as q
from .jobs import regions
from .operators import index
from .operators._stage import staged
from .queries import K, READ_K, register

_PIECE_SQL = "leaves AS (SELECT anc.id, leaf.id AS leaf FROM anc JOIN leaf ON leaf.id = anc.leaf)"
_CUT_SQL = f"cut AS (SELECT a.id, a.size, a.weight FROM roll a LEFT JOIN child ON child.child = a.id LEFT JOIN roll p ON p.id = child.parent WHERE (a.size <= {q._CUT} OR a.level = 1) AND (p.id IS NULL OR p.size > {q._CUT}) AND a.weight > 500)"


def _tree(spark, sf_dir):
    """The hierarchy with its sums, and orders as leaves of themselves."""
    child = staged(q._child(spark, sf_dir), "child")
    roll = staged(q._roll(spark, sf_dir), "roll")
    leaf = q._table(spark, sf_dir, "lineitem").select((1001 + 2 * F.col("l_orderkey")).alias("id")).distinct()
    return child, roll, leaf.select("id", F.col("id").alias("leaf"))


@register("region_leaves", f"WITH {q._TREE}, {_PIECE_SQL}, {_CUT_SQL} SELECT cut.id AS region, leaf FROM cut JOIN leaves USING (id)")
def region_leaves(spark, sf_dir):
    child, roll, piece = _tree(spark, sf_dir)
    return regions.decompose(child, roll.select("id", "size"), piece, roll.select("id", F.col("weight").alias("kmers")), q._CUT, 500).leaves


@register("region_summary", f"WITH {q._TREE}, {_PIECE_SQL}, {_CUT_SQL} SELECT (SELECT count(*) FROM cut) AS n_regions, (SELECT count(*) FROM cut JOIN leaves USING (id)) AS n_leaves, (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) FROM cut) AS kmers, (SELECT coalesce(sum(weight), 0) FROM cut) / (SELECT max(weight) FROM roll) AS share")
def region_summary(spark, sf_dir):
    child, roll, piece = _tree(spark, sf_dir)
    return regions.decompose(child, roll.select("id", "size"), piece, roll.select("id", F.col("weight").alias("kmers")), q._CUT, 500).summary


@register(
    "shadow_ratio_extract",
    f"""WITH {q._TREE}, {_PIECE_SQL}, t AS (SELECT a.id, a.weight AS size, log2(a.weight) - log2(a.size) AS ratio FROM roll a JOIN child ON child.child = a.id JOIN roll p ON p.id = child.parent WHERE a.weight < 2000 AND (p.id = -1 OR p.weight >= 2000) AND a.weight > 100),
kept AS (SELECT id FROM (SELECT id, sum(size) OVER (ORDER BY ratio, id ROWS UNBOUNDED PRECEDING) AS s FROM t) WHERE s <= 0.1 * (SELECT weight FROM roll WHERE id = -1))
SELECT kept.id AS region, leaf FROM kept JOIN leaves USING (id)""",
)
def shadow_ratio_extract(spark, sf_dir):
    child, roll, piece = _tree(spark, sf_dir)
    stats = roll.select("id", F.col("weight").alias("kmers"), F.col("size").alias("shadow"))
    return regions.shadow_ratio(child, stats, piece, -1, 2000, 100, 0.1).leaves


_AT = f"spots AS MATERIALIZED (SELECT item_id, j - 1 AS pos, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT item_id, j, substr(text, j, {K}) AS kmer FROM (SELECT item_id, text, unnest(generate_series(1, length(text) - {K - 1})) AS j FROM benchmark WHERE length(text) >= {K})))"


@register(
    "position_profile",
    f"""WITH {q._UNIQ}, {_AT}, {q._INFO}, inside AS (SELECT doc_id AS id, source, info.n_kmers, info.abund FROM documents JOIN info ON info.id = doc_id),
dom AS (SELECT source, count(*) AS neighbors, sum(n_kmers) AS dom_kmers FROM inside GROUP BY source),
hit AS (SELECT item_id, pos, kmer, inside.* FROM spots LEFT JOIN idx USING (kmer) LEFT JOIN inside ON inside.id = idx.id),
asked AS (SELECT item_id, source, count(DISTINCT kmer) AS own FROM hit WHERE source IS NOT NULL GROUP BY 1, 2)
SELECT hit.item_id, pos, coalesce(dom_kmers / own, 0.0) AS var, coalesce(neighbors, 0) AS neighbors, coalesce(n_kmers * abund, 0.0) AS abund
FROM hit LEFT JOIN dom ON dom.source = hit.source LEFT JOIN asked ON asked.item_id = hit.item_id AND asked.source = hit.source""",
)
def position_profile(spark, sf_dir):
    wanted = q._wanted(spark, sf_dir)
    own = index.unique_index(q._nodes(spark, sf_dir), K, wanted)
    found = regions.position_profile(q._records(spark, sf_dir), own, q._nodes(spark, sf_dir).select("id", "dominator"), q._info(spark, sf_dir), K)
    return found.withColumnRenamed("query", "item_id").withColumn("pos", F.col("pos").cast("long"))


@register(
    "named_read_pairs",
    f"""WITH lab AS MATERIALIZED {q._LABELS}, r AS (SELECT conv_id, turn, lag(conv_id) OVER w AS c, lag(turn) OVER w AS t FROM conversations WHERE length(text) >= {READ_K} WINDOW w AS (ORDER BY conv_id, turn)),
p AS (SELECT conv_id, t AS a, turn AS b FROM r WHERE c = conv_id AND t % 2 = 0 AND turn = t + 1)
SELECT * FROM lab UNION SELECT p.conv_id, p.b, doc_id FROM p JOIN lab ON lab.conv_id = p.conv_id AND lab.turn = p.a UNION SELECT p.conv_id, p.a, doc_id FROM p JOIN lab ON lab.conv_id = p.conv_id AND lab.turn = p.b""",
)
def named_read_pairs(spark, sf_dir):
    """Turns 0 and 1, 2 and 3, ... of a conversation are named like mates."""
    turns = q._table(spark, sf_dir, "conversations")
    number = F.struct("conv_id", "turn")
    name = F.concat_ws("", F.col("conv_id").cast("string"), F.lit(":"), F.floor(F.col("turn") / 2).cast("string"), F.lit("/"), (F.col("turn") % 2 + 1).cast("string"))
    reads = turns.select(number.alias("number"), name.alias("name"), F.col("text").alias("seq"))
    labels = q._labels(spark, sf_dir).select(number.alias("number"), "id")
    return regions.label_named_reads(reads, labels, READ_K).select("number.*", F.col("id").alias("doc_id"))


@register("leaf_audit", "SELECT item_id AS id, 'no leaf' AS side FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'no node' FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def leaf_audit(spark, sf_dir):
    return regions.audit(q._table(spark, sf_dir, "labels").select(F.col("doc_id").alias("leaf")), q._table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))


@register("id_density", "SELECT count(doc_id) AS n, max(doc_id) AS last, min(doc_id) = 0 AND count(DISTINCT doc_id) = count(doc_id) AND max(doc_id) + 1 = count(doc_id) AS dense FROM documents")
def id_density(spark, sf_dir):
    return regions.densely_numbered(q._nodes(spark, sf_dir).select("id"))


@register("ranked_sources", "SELECT row_number() OVER (ORDER BY n DESC, source) AS rank, source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def ranked_sources(spark, sf_dir):
    return regions.ranked_counts(q._table(spark, sf_dir, "documents").select("source"), "source")
