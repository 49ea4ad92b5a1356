"""Long FASTA records, lineage databases, mates in a stream, approximate sketches."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from kmerweave.functions.sequence import kmers
from kmerweave.operators import annotate, sketch
from kmerweave.sources import readers
from kmerweave.streaming.reads import pair_stream


def literal_fasta(path):
    """(name, description, offset, sequence) by bytes."""
    data, out, at = path.read_bytes(), [], 0
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            head = line[1:].decode().strip().split(None, 1)
            out.append([head[0], head[1] if len(head) > 1 else "", at, ""])
        else:
            text = line.decode().strip()
            if text:
                out[-1][3] += text
        at += len(line) + 1
    return out


def write_fasta(path, records, width, end="\n"):
    with open(path, "w", newline="") as f:
        for head, seq in records:
            f.write(f">{head}{end}")
            f.writelines(seq[i : i + width] + end for i in range(0, len(seq), width))


@pytest.fixture
def folder(tmp_path, spark):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    (tmp_path / "fa").mkdir()
    write_fasta(tmp_path / "fa" / "a.fa", [("one first  record", dna(700)), ("two", ""), ("three x", dna(61)), ("long one", dna(300_000))], 60)
    write_fasta(tmp_path / "fa" / "b.fa", [("four > y", dna(130)), ("five", dna(5))], 70, "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield tmp_path / "fa"
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_long_records_in_pieces(spark, folder):
    want = {r[0]: r[3] for p in sorted(folder.iterdir()) for r in literal_fasta(p)}
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8  # the long record is read by many tasks
    for size, overlap in ((1000, 0), (1000, 20), (64, 7)):
        got = readers.fasta_pieces(spark, str(folder), size, overlap)
        rows = sorted(got.collect(), key=lambda r: (r.name, r.start))
        for name in {r.name for r in rows}:
            own = [r for r in rows if r.name == name]
            for r in own:
                assert r.piece == want[name][r.start : r.start + len(r.piece)]
            assert all(a.start + len(a.piece) == min(b.start + overlap, len(want[name])) for a, b in zip(own, own[1:], strict=False))
            assert own[0].start == 0 and own[-1].start + len(own[-1].piece) == len(want[name])
        assert {r.name for r in rows} == {n for n, s in want.items() if s}
    pieces = readers.fasta_pieces(spark, str(folder), 1000, 20)
    found = kmers(pieces.select("name", F.col("piece").alias("seq")), "seq", 21, "name").groupBy("name").agg(F.count("*").alias("n"))
    assert {r.name: r.n for r in found.collect()} == {n: len(s) - 20 for n, s in want.items() if len(s) > 20}


def test_offsets(spark, folder):
    got = readers.fasta_offsets(spark, str(folder)).collect()
    want = [(p.name, r[0], " ".join(r[1].split()), r[2], len(r[3])) for p in sorted(folder.iterdir()) for r in literal_fasta(p)]
    assert sorted((r.file.rpartition("/")[2], r.name, " ".join(r.description.split()), r.offset, r.length) for r in got) == sorted(want)


def test_no_record_start_raises(spark, folder):
    (folder / "c.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="no record starts"):
        readers.fasta_pieces(spark, str(folder)).collect()


def test_lineage_database(spark, tmp_path):
    ranks = ["superkingdom", "phylum", "class"]
    data = {
        "version": "2.1", "type": "sourmash_lca", "ksize": 21, "scaled": 1000,
        "ident_to_name": {"a": "A one", "b": "B", "c": "C"},
        "ident_to_idx": {"a": 0, "b": 1, "c": 2},
        "idx_to_lid": {"0": 0, "1": 1},
        "lid_to_lineage": {"0": [[r, x] for r, x in zip(ranks, ["Bacteria", "P1", "C1"], strict=True)], "1": [[r, x] for r, x in zip(ranks, ["Bacteria", "P2", ""], strict=True)]},
        "hashval_to_idx": {"18446744073709551615": [0, 1], "5": [1], "77": [2], "9": [0]},
    }
    (tmp_path / "db.json").write_text(json.dumps(data))
    hashes, lineages = readers.lca_database(spark, str(tmp_path / "db.json"))
    assert sorted((r.name, int(r.hash)) for r in hashes.collect()) == sorted((n, int(h)) for h, all_ in data["hashval_to_idx"].items() for n, i in data["ident_to_idx"].items() if i in all_)
    assert {r.name: list(r.lineage) for r in lineages.collect()} == {"a": ["Bacteria", "P1", "C1"], "b": ["Bacteria", "P2"]}
    found = {int(r.hash): (len(r.lineages), list(r.lca)) for r in annotate.hash_lineages(hashes, lineages).collect()}
    assert found == {2**64 - 1: (2, ["Bacteria"]), 5: (1, ["Bacteria", "P2"]), 9: (1, ["Bacteria", "P1", "C1"])}


def test_mates_in_a_stream(spark, tmp_path):
    schema = "name string, ids array<long>, ts timestamp"
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    batches = [
        [("r1/1", [1, 2], at(0)), ("r2/2", [5], at(0)), ("solo", [9, 9], at(1)), ("gone/1", [8], at(0)), ("empty/1", [], at(1))],
        [("r1/2", [2, 3], at(2)), ("r3/1", [4], at(3)), ("r3/2", [6], at(3)), ("empty/2", [7], at(3))],
        [("r2/1", [1], at(5)), ("r1/1", [40], at(6))],
        [("end", [], at(50))],
        [("end", [], at(59))],
    ]
    src, n = tmp_path / "in", 0
    src.mkdir()
    for rows in batches:
        spark.createDataFrame([(a, b, None) for a, b, _ in rows], schema).withColumn("ts", F.element_at(F.array(*(F.to_timestamp(F.lit(t)) for _, _, t in rows)), F.array_position(F.array(*(F.lit(a) for a, _, _ in rows)), F.col("name")).cast("int"))).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    query = pair_stream(stream, "name", "ids", "ts", "10 minutes").writeStream.format("memory").queryName("mates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(240)
    got = sorted((r.name, r.id) for r in spark.table("mates").collect())
    want = [("r1/1", i) for i in (1, 2, 3)] + [("r1/2", i) for i in (1, 2, 3)] + [("r2/1", 1), ("r2/1", 5), ("r2/2", 1), ("r2/2", 5)]
    want += [("r3/1", 4), ("r3/1", 6), ("r3/2", 4), ("r3/2", 6), ("empty/1", 7), ("empty/2", 7), ("solo", 9), ("solo", 9), ("gone/1", 8), ("r1/1", 40)]
    assert got == sorted(want) and n == 0


def test_approximate_sketches(spark):
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    whole = dna(40_000)
    nodes = spark.createDataFrame([(0, whole[:20_000]), (1, whole[15_000:30_000]), (2, dna(9_000)), (3, "ACG")], "id long, seq string")
    queries = spark.createDataFrame([("half", whole[10_000:30_000]), ("none", dna(8_000))], "query string, seq string")
    few, many = sketch.theta_sketches(queries, 21, "query"), sketch.theta_sketches(nodes, 21, "id")
    got = {(r["query"], r.id): r for r in sketch.theta_overlap(few, many, "query", "id").collect()}
    exact = {(r["query"], r.id): r for r in sketch.overlap(sketch.scaled_sketch(queries, 21, 1, "query"), sketch.scaled_sketch(nodes, 21, 1, "id"), "query", "id").collect()}
    assert set(exact) <= set(got) and len(got) == 6
    for key, r in got.items():
        e = exact.get(key)
        assert abs(r.containment - (e.containment if e else 0)) < 5 / 2**6 and abs(r.similarity - (e.similarity if e else 0)) < 5 / 2**6
    merged = sketch.theta_merged(many.withColumn("all", F.lit(1)), "all").select(F.theta_sketch_estimate("sketch").alias("n")).first().n
    union = sketch.scaled_sketch(nodes, 21, 1).count()
    assert abs(merged - union) < 5 * union / 2**6


def test_theta_containment_of_a_part_is_one(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(6000))
    nodes = spark.createDataFrame([(1, seq)], "id long, seq string")
    queries = spark.createDataFrame([(i, seq[300 * i : 300 * i + 250]) for i in range(8)], "query long, seq string")
    few, many = sketch.theta_sketches(queries, 21, "query"), sketch.theta_sketches(nodes, 21, "id", lg=8)
    assert {r.containment for r in sketch.theta_overlap(few, many, "query", "id").collect()} == {1.0}
