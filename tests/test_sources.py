import gzip

import pytest

from kmerweave.operators import index
from kmerweave.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def text_of(path):
    out = []
    for p in sorted(path.glob("part-*")):
        out.append(gzip.open(p, "rt").read() if p.suffix == ".gz" else p.read_text())
    return "".join(out)


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">r1 some text > here\nACGT\nAC>G\n\n>r2\nTT\n>r3\n")
    assert rows(readers.fasta(spark, str(p))) == [("r1", "some text > here", "ACGTAC>G"), ("r2", "", "TT"), ("r3", "", "")]


def test_fastq(spark, tmp_path):
    p = tmp_path / "a.fq"
    p.write_text("".join(f"@r{i} x\nACGT\n+\n@>+{i % 10}\n" for i in range(40)))
    got = readers.fastq(spark, str(p)).orderBy("number").collect()
    assert [(r.name, r.description, r.sequence, r.quality) for r in got] == [(f"r{i}", "x", "ACGT", f"@>+{i % 10}") for i in range(40)]
    p.write_text("@r\nACGT\n-\nIIII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        readers.fastq(spark, str(p)).collect()


def test_unitigs(spark, tmp_path):
    p = tmp_path / "u.fa"
    p.write_text(">0 LN:i:4 KC:i:2 km:f:1.5 L:+:1:-\nACGT\n>1 LN:i:3 km:f:2.0 L:-:0:+ L:+:1:+\nAAA\n")
    nodes, arcs = readers.unitigs(spark, str(p))
    assert rows(nodes) == [(0, "ACGT", 1.5), (1, "AAA", 2.0)] and rows(arcs) == [(0, 1), (1, 0), (1, 1)]


def test_graph_round_trip(spark, tmp_path):
    p = tmp_path / "g.gxt"
    p.write_text("4\n0 1\n2 2\n1 3\n3 1\n")
    v, e = readers.gxt(spark, str(p))
    assert v.count() == 4 and rows(e) == [(0, 1), (1, 0), (1, 3), (3, 1)]
    writers.gxt(e, v, str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == "4\n0 1\n1 0\n1 3\n3 1\n"
    sized = v.selectExpr("id", "id + 1 as size")
    writers.gml(sized, e, str(tmp_path / "gml"))
    writers.dot(sized, e, str(tmp_path / "dot"))
    gml = text_of(tmp_path / "gml")
    assert gml.startswith("graph [") and gml.count("edge [") == 2 and gml.count("node [") == 4 and gml.rstrip().endswith("]")
    assert text_of(tmp_path / "dot").count(" -- ") == 2


def test_small_tables(spark, tmp_path):
    m = tmp_path / "m"
    m.write_text("0 18446744073709551615 5\n1\n")
    assert [(r.vertex, int(r.hash)) for r in readers.mxt(spark, str(m)).orderBy("hash").collect()] == [(0, 5), (0, 2**64 - 1)]
    h = tmp_path / "h.csv"
    h.write_text("0,7,1,\n1,8,1,\n2,7,2,0 1\n")
    nodes, child = readers.hierarchy(spark, str(h))
    assert rows(nodes) == [(0, 7, 1), (1, 8, 1), (2, 7, 2)] and rows(child) == [(2, 0), (2, 1)]
    writers.hierarchy(nodes, child, str(tmp_path / "hout"))
    assert text_of(tmp_path / "hout") == h.read_text()
    d = tmp_path / "d"
    d.write_text("5 5 9\n7 7\n")
    piece = readers.pieces(spark, str(d))
    assert rows(piece) == [(5, 5), (5, 9), (7, 7)]
    writers.pieces(piece, str(tmp_path / "dout"))
    assert text_of(tmp_path / "dout") == d.read_text()
    info = spark.createDataFrame([(1, 2.0, 5), (0, 1.25, 4)], "id long, abund double, n_kmers long")
    writers.node_info(info, str(tmp_path / "i"))
    assert text_of(tmp_path / "i") == "contig_id,offset,mean_abund,n_kmers\n0,0,1.250,4\n1,0,2.000,5\n"
    assert rows(readers.node_info(spark, str(tmp_path / "i"), 1.5)) == [(1, 0, 2.0, 5)]
    ids = spark.createDataFrame([(63,), (145,), (63,)], "id long")
    writers.id_list(ids, str(tmp_path / "n"))
    writers.id_list(ids, str(tmp_path / "t"), as_text=True)
    assert text_of(tmp_path / "n") == "63\n145\n" and text_of(tmp_path / "t") == "145\n63\n"
    assert {int(r.id) for r in readers.id_list(spark, str(tmp_path / "n")).collect()} == {63, 145}


def test_sequences_and_signatures(spark, tmp_path):
    r = spark.createDataFrame([("a", "AC", None), ("b", "GT", "II")], "name string, sequence string, quality string").coalesce(1)
    writers.sequences(r, str(tmp_path / "s"))
    assert text_of(tmp_path / "s") == ">a\nAC\n@b\nGT\n+\nII\n"
    s = spark.sql("select 'x' as name, cast('18446744073709551615' as decimal(20,0)) as hash union all select 'x', cast('7' as decimal(20,0))")
    writers.signature(s, str(tmp_path / "g"), 21, 2**64 // 100)
    got = readers.signatures(spark, str(tmp_path / "g"))
    assert sorted((x.name, x.ksize, int(x.hash)) for x in got.collect()) == [("x", 21, 7), ("x", 21, 2**64 - 1)]
    assert [int(x.hash) for x in readers.signatures(spark, str(tmp_path / "g"), 100).collect()] == [7]


def test_streams_equal_batch(spark, tmp_path):
    from kmerweave.streaming import reads

    n = spark.createDataFrame([(1, "GATTACAG"), (2, "TTTTCCCC")], "id long, seq string")
    idx = index.unique_index(n, 4)
    src = tmp_path / "in"
    data = [(1, "xxGATTACA"), (2, "CCCC"), (3, "zzzzz")]
    spark.createDataFrame(data, "read long, seq string").repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema("read long, seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = reads.abundance_stream(stream, idx, 4).writeStream.outputMode("complete").format("memory").queryName("ab").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("ab")) == [(1, 4), (2, 1)]
    q = reads.label_stream(stream, idx, 4, "read").writeStream.format("memory").queryName("lab").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("lab").distinct()) == [(1, 1), (2, 2)]
