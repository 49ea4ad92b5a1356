"""The built hierarchy at size: what a level writes, and joins in tasks of bounded rows."""

from pyspark.sql import functions as F
from test_dominating import star_and_more

from kmerweave import queries as library
from kmerweave.jobs import build
from kmerweave.operators import _stage, graph


def test_a_level_writes_its_edges_once(spark, monkeypatch):
    """Edges and arcs are written once each, in one direction, besides the smaller graphs of peeling and of the next level."""
    rows, plain = [], _stage.staged

    def seen(df, name):
        out = plain(df, name)
        if "src" in df.columns and "dst" in df.columns:
            rows.append(out.count())
        return out

    for module in (_stage, graph, build):
        monkeypatch.setattr(module, "staged", seen)
    pairs = [(i, j) for i in range(12) for j in range(100, 160) if (i * j) % 5 < 3]
    e = graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))
    v = spark.createDataFrame([(i,) for p in pairs for i in p], "id long").distinct()
    h = build.build_hierarchy(e, v, top=100)  # one level and the root
    assert h.piece.count() == v.count()
    assert sum(rows) <= 2.5 * len(pairs)


def test_the_same_without_broadcasts(spark, monkeypatch):
    """Vertices too many to be broadcast are dealt out by key with the edges, and hashed."""
    n, pairs = star_and_more(5)
    e, v = graph.undirected(spark.createDataFrame(pairs, "src long, dst long")), spark.range(n)
    shown = lambda h: [sorted(map(str, df.collect())) for df in (h.nodes, h.child, h.piece)]
    few = shown(build.build_hierarchy(e, v, top=40))
    monkeypatch.setattr(graph, "SHARE", 40)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(build, "BROADCAST_ROWS", -1)
    half = graph.staged(e.where("src < dst"), "test-half")
    joined = graph.at_end(half, 400, v.select(F.col("id").alias("src")), n, "src")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "hashpartitioning(src#" in plan and ", 10), REPARTITION_BY_NUM" in plan
    assert shown(build.build_hierarchy(e, v, top=40)) == few


def test_check_reads_the_levels_tables(spark, tmp_path, monkeypatch):
    """The check copies no table of the hierarchy; its row is that of a tree over all vertices, lone ones too."""
    names, plain = [], library.staged
    monkeypatch.setattr(library, "staged", lambda df, name: names.append(name) or plain(df, name))
    i = F.col("id")
    spark.range(300).select((i % 25).alias("l_partkey"), (i * i % 13).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30).select(i.alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(14).select(i.alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    (row,) = library.hierarchy_check(spark, str(tmp_path)).collect()
    assert row.asDict() == {"n_leaves": 44, "n_orphans": 0, "n_double": 0, "dense": True}
    assert not names
