"""Searches query by query: results, reads, abundances and hierarchy nodes of every record, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries as q
from .jobs import neighborhoods
from .operators import index, protein, sketch
from .operators._stage import stage_root, staged
from .operators.kept import KeptIndex
from .queries import K, SCALED, _sk, register

_EACH = f"""{q._UNIQ}, pm AS MATERIALIZED (SELECT query, id, count(*) AS matches FROM q JOIN idx USING (kmer) GROUP BY query, id),
dm AS MATERIALIZED (SELECT DISTINCT query, source FROM pm JOIN documents ON doc_id = id)"""


def _searches(spark, sf_dir):
    nodes = q._nodes(spark, sf_dir)
    wanted = q._wanted(spark, sf_dir)
    own = staged(index.unique_index(nodes, K, wanted), "index")
    sketcher = lambda df, key: sketch.scaled_sketch(df, K, SCALED, key)
    return neighborhoods.search_each(nodes.select("id", "seq"), own, nodes.select("id", "dominator"), q._records(spark, sf_dir), K, sketcher, "sources")


@register(
    "query_results",
    f"""WITH {_EACH}, ds AS MATERIALIZED (SELECT DISTINCT source, hash FROM {_sk("documents", "source")}), qs AS MATERIALIZED (SELECT DISTINCT item_id AS query, hash FROM {_sk("benchmark", "item_id")}),
ns AS MATERIALIZED (SELECT DISTINCT query, hash FROM dm JOIN ds USING (source)),
a AS (SELECT query, count(*) AS n FROM q GROUP BY query), mm AS (SELECT query, sum(matches) AS matched, sum(length(text) - {K - 1}) AS node_kmers FROM pm JOIN documents ON doc_id = id GROUP BY query),
dk AS (SELECT source, sum(length(text) - {K - 1}) AS n FROM documents WHERE length(text) >= {K} GROUP BY source), dd AS (SELECT query, sum(n) AS dom_kmers FROM dm JOIN dk USING (source) GROUP BY query),
nn AS (SELECT query, count(*) AS contigs, sum(length(text)) AS bp FROM dm JOIN documents USING (source) GROUP BY query),
so AS (SELECT query, count(*) AS own FROM qs GROUP BY query), sn AS (SELECT query, count(*) AS others FROM ns GROUP BY query), sb AS (SELECT query, count(*) AS n_both FROM qs JOIN ns USING (query, hash) GROUP BY query),
r AS (SELECT i.item_id AS query, coalesce(n, 0) AS n, coalesce(matched, 0) AS matched, coalesce(node_kmers, 0) AS node_kmers, coalesce(dom_kmers, 0) AS dom_kmers, coalesce(contigs, 0) AS contigs, coalesce(bp, 0) AS bp, coalesce(own, 0) AS own, coalesce(others, 0) AS others, coalesce(n_both, 0) AS n_both
  FROM (SELECT DISTINCT item_id FROM benchmark) i LEFT JOIN a ON a.query = i.item_id LEFT JOIN mm ON mm.query = i.item_id LEFT JOIN dd ON dd.query = i.item_id LEFT JOIN nn ON nn.query = i.item_id LEFT JOIN so ON so.query = i.item_id LEFT JOIN sn ON sn.query = i.item_id LEFT JOIN sb ON sb.query = i.item_id)
SELECT query AS item_id, coalesce(n_both / nullif(own, 0), 0.0) AS containment, coalesce(n_both / nullif(own + others - n_both, 0), 0.0) AS similarity, CAST(bp AS BIGINT) AS bp, CAST(contigs AS BIGINT) AS contigs, {K} AS ksize, CAST(n AS BIGINT) AS num_query_kmers,
  coalesce(matched / nullif(n, 0), 0.0) AS best_containment, coalesce((node_kmers - matched) / nullif(node_kmers, 0), 0.0) AS cdbg_min_overhead, coalesce((dom_kmers - matched) / nullif(dom_kmers, 0), 0.0) AS catlas_min_overhead, 'sources' AS catlas_name FROM r""",
)
def query_results(spark, sf_dir):
    """Every benchmark item as a query of its own: the table of results that the writer takes."""
    return _searches(spark, sf_dir).results.withColumnRenamed("query", "item_id")


@register(
    "query_reads",
    f"""WITH {_EACH}, lab AS MATERIALIZED (SELECT DISTINCT source, conv_id, turn FROM {q._LABELS} JOIN documents USING (doc_id)),
found AS (SELECT DISTINCT query, conv_id, turn FROM dm JOIN lab USING (source))
SELECT query AS item_id, count(*) AS n_reads, CAST(sum(length(text)) AS BIGINT) AS bp FROM found JOIN conversations USING (conv_id, turn) GROUP BY query""",
)
def query_reads(spark, sf_dir):
    """Conversation turns labelled with a document of an item's neighbourhood."""
    s = _searches(spark, sf_dir)
    found = neighborhoods.reads_of(s.doms, q._nodes(spark, sf_dir).select("id", "dominator"), q._labels(spark, sf_dir), "conv_id", "turn")
    records = neighborhoods.records_of(found, q._table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return records.groupBy(F.col("query").alias("item_id")).agg(F.count("*").alias("n_reads"), F.sum(F.length("text")).cast("long").alias("bp"))


@register(
    "abundance_by_query",
    f"WITH {_EACH}, {q._INFO}, a AS (SELECT query, count(*) AS n FROM q GROUP BY query) SELECT query AS item_id, CAST(sum(matches) AS BIGINT) AS n_found, round(sum(matches) / any_value(n), 6) AS containment, round(sum(matches * abund) / sum(matches), 6) AS mean_abund FROM pm JOIN info USING (id) JOIN a USING (query) GROUP BY query HAVING sum(matches) / any_value(n) >= 0.5",
)
def abundance_by_query(spark, sf_dir):
    """Items of which at least half is found; the others have no row."""
    wanted = q._wanted(spark, sf_dir)
    found = wanted.join(q._index_of(spark, sf_dir, wanted), "kmer").groupBy("query", "id").agg(F.count("*").alias("matches"))
    rows = neighborhoods.query_abundances(found, q._info(spark, sf_dir), wanted, 0.5)
    return rows.select(F.col("query").alias("item_id"), "n_found", F.round("containment", 6).alias("containment"), F.round("mean_abund", 6).alias("mean_abund"))


@register(
    "node_info_by_query",
    f"""WITH {q._TREE}, hit AS MATERIALIZED (SELECT l_returnflag AS query, 1001 + 2 * l_orderkey AS leaf, count(*) AS n FROM lineitem GROUP BY 1, 2),
per AS MATERIALIZED (SELECT query, anc.id, CAST(sum(n) AS BIGINT) AS n FROM hit JOIN anc ON anc.leaf = hit.leaf GROUP BY 1, 2),
sh AS MATERIALIZED (SELECT anc.id, count(*) AS shadow FROM anc JOIN leaf ON leaf.id = anc.leaf GROUP BY 1),
t AS MATERIALIZED (SELECT a.id, a.size, a.weight FROM roll a JOIN child ON child.child = a.id JOIN roll p ON p.id = child.parent WHERE a.size < {q._CUT} AND (p.id = -1 OR p.size >= {q._CUT}) AND a.size > 5)
SELECT f.query, t.id AS node_id, coalesce(per.n, 0) / t.size AS contained, t.size AS n_kmers, t.weight AS n_weighted_kmers, sh.shadow AS shadow_size
FROM (SELECT DISTINCT query FROM hit) f CROSS JOIN t JOIN sh ON sh.id = t.id LEFT JOIN per ON per.query = f.query AND per.id = t.id""",
)
def node_info_by_query(spark, sf_dir):
    """Line items by their return flag as queries: what every told node of the hierarchy holds of each."""
    items = q._table(spark, sf_dir, "lineitem").select((1001 + 2 * F.col("l_orderkey")).alias("id"), "l_returnflag", "l_quantity")
    matches = items.groupBy(F.col("l_returnflag").alias("query"), "id").agg(F.count("*").alias("matches"))
    sizes = items.groupBy(F.col("id").alias("leaf")).agg(F.count("*").alias("n_kmers"), F.sum(F.col("l_quantity").cast("long")).alias("weighted"))
    child = staged(q._child(spark, sf_dir), "child")
    piece = sizes.select(F.col("leaf").alias("id"), "leaf")
    return neighborhoods.node_info(matches, piece, child, q._level(child), sizes, -1, q._CUT, 5)


# ---------------------------------------------------------------- indexes


def _kept(spark, sf_dir):
    """The documents' index, built of one language and grown by the others."""
    nodes = q._nodes(spark, sf_dir)
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    kept = KeptIndex(spark, f"{stage_root(spark)}/kept-{uuid.uuid4().hex}", K, 8)
    return kept.build(nodes.where(first)).grow(nodes.where(~first))


@register("kept_index_matches", f"WITH {q._UNIQ}, m2 AS (SELECT id, count(*) AS m FROM (SELECT DISTINCT kmer FROM q WHERE query % 2 = 0) JOIN idx USING (kmer) GROUP BY id) SELECT m.id AS doc_id, matches, coalesce(m, 0) AS even FROM m LEFT JOIN m2 USING (id)")
def kept_index_matches(spark, sf_dir):
    """Two questions to one kept index: all items, and those of even number."""
    kept = _kept(spark, sf_dir)
    wanted = staged(index.dealt_kmers(q._records(spark, sf_dir), K), "wanted")
    even = kept.matches(wanted.where(F.col("query") % 2 == 0)).withColumnRenamed("matches", "even")
    return kept.matches(wanted).join(even, "id", "left").select(F.col("id").alias("doc_id"), "matches", F.coalesce("even", F.lit(0)).alias("even"))


@register("kept_index_collisions", q.ORACLES["kmer_collisions"])
def kept_index_collisions(spark, sf_dir):
    return _kept(spark, sf_dir).collisions()


_AMINO = 10


@register("protein_record_hits", f"SELECT DISTINCT item_id, doc_id FROM {q._km('benchmark', 'item_id', _AMINO)} JOIN {q._km('documents', 'doc_id', _AMINO)} USING (kmer)")
def protein_record_hits(spark, sf_dir):
    """Items as protein records, documents as proteins: all pairs that share ten letters."""
    index_ = staged(protein.record_index(q._records(spark, sf_dir).withColumnRenamed("query", "item_id"), _AMINO, "item_id"), "record-index")
    return protein.protein_hits(q._nodes(spark, sf_dir), index_, _AMINO, "item_id").withColumnRenamed("id", "doc_id")


@register(
    "theta_containment",
    f"""WITH a AS MATERIALIZED (SELECT DISTINCT item_id, kmer FROM {q._ck("benchmark", "item_id")})
SELECT item_id, source, true AS close FROM (SELECT DISTINCT item_id FROM a) CROSS JOIN (SELECT DISTINCT source FROM documents WHERE length(text) >= {K})""",
)
def theta_containment(spark, sf_dir):
    """Items in sources by approximate sketches; ``close``: within five standard errors of the exact containment, by the hashes of an item that both sketches sample."""
    of_docs = sketch.theta_sketches(q._nodes(spark, sf_dir), K, "dominator", lg=18)
    items = staged(sketch.theta_sketches(q._records(spark, sf_dir), K, "query", lg=18), "item-sketches")
    near = sketch.theta_overlap(items, staged(of_docs, "source-sketches"), "query", "dominator")
    wanted = q._wanted(spark, sf_dir)
    asked = wanted.groupBy("query").agg(F.count("*").alias("asked"))
    own = q.seq.kmer_keys(q._nodes(spark, sf_dir), "seq", K, "dominator").select("dominator", "kmer").join(q.checked(wanted.select("kmer").distinct()), "kmer", "left_semi").distinct()
    exact = own.join(wanted, "kmer").groupBy("query", "dominator").agg(F.count("*").alias("n"))
    both = near.join(asked, "query").join(exact, ["query", "dominator"], "left")
    sampled = F.col("n_few") * F.least(F.lit(1.0), F.lit(2.0**18) / F.greatest("n_few", "n_many"))
    close = F.abs(F.col("containment") - index.ratio(F.coalesce("n", F.lit(0)), F.col("asked"))) <= 2.5 / F.sqrt(sampled)
    return both.select(F.col("query").alias("item_id"), F.col("dominator").alias("source"), close.alias("close"))
