"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kmerweave import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["query_match_counts", "exact_containment", "neighborhood_expand", "composition_matrix", "mate_pairing", "record_mean_abundance", "pendant_disconnect", "contract_edges", "components", "partition_antichain", "unassembled_nodes", "response_curve", "lineage_purity", "lineage_lca", "dense_renumber_text_order"]
SOME += ["query_results", "query_reads", "abundance_by_query", "node_info_by_query", "kept_index_matches", "protein_record_hits", "orientation_check", "domset_check", "gather_check", "contracted_kmers", "density_tree", "unassembled_table", "region_leaves", "named_read_pairs", "augmented_arcs", "nearest_vectors", "transitive_pairs_edges"]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rounded(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = library.QUERIES[name](spark, SF)
    cur = db.execute(library.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rounded(map(tuple, df.select(cols).collect())) == rounded(cur.fetchall())


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["place", "id", "sum_cont", "sum_oh", "relative_cont", "relative_oh"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
