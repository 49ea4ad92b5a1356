"""Sinks: graph, hierarchy, sequence, sketch and table files.

Formats whose line order matters are sorted over range partitions, and the names of
the part files follow that order: joined, they are the file.  CSV files with a header
have it in every part, as Spark reads them.  A small table is one part.  Tables that
only feed later stages should stay Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Text lines of an ordered single-column table."""
    df.write.mode("overwrite").text(path, compression=compression)


def gxt(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """Vertex count, then 'u v' of both directions in order."""
    body = edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"), "src", "dst")
    head = vertices.agg(F.count("*").cast("string").alias("value")).select("value", F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    rows = head.union(body).toDF("value", "src", "dst")
    _lines(rows.orderBy("src", "dst").select("value"), path)


def gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph Modelling Language: nodes (id, size), then edges once per pair."""
    n = nodes.select(F.col("id").alias("at"), F.format_string("  node [\n    id %d\n    size %d\n  ]", F.col("id").cast("long"), F.col("size").cast("long")).alias("value"))
    e = edges.where("src < dst").select(F.monotonically_increasing_id().alias("at"), F.format_string("  edge [\n    source %d\n    target %d\n  ]", "src", "dst").alias("value"))
    spark = nodes.sparkSession
    fixed = lambda x, k: spark.createDataFrame([(k, 0, x)], "part int, at long, value string")
    rows = fixed("graph [\n  directed 0", 0).union(n.select(F.lit(1), "at", "value")).union(e.select(F.lit(2), "at", "value")).union(fixed("]", 3))
    _lines(rows.orderBy("part", "at", "value").select("value"), path)


def dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graphviz: nodes, then edges once per pair."""
    n = nodes.select(F.col("id").alias("at"), F.format_string("  %d;", F.col("id").cast("long")).alias("value"))
    e = edges.where("src < dst").select(F.monotonically_increasing_id().alias("at"), F.format_string("  %d -- %d;", "src", "dst").alias("value"))
    spark = nodes.sparkSession
    fixed = lambda x, k: spark.createDataFrame([(k, 0, x)], "part int, at long, value string")
    rows = fixed("graph {", 0).union(n.select(F.lit(1), "at", "value")).union(e.select(F.lit(2), "at", "value")).union(fixed("}", 3))
    _lines(rows.orderBy("part", "at", "value").select("value"), path)


def hierarchy(nodes: DataFrame, child: DataFrame, path: str) -> None:
    """'id,vertex,level,children' lines, children ascending."""
    below = child.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("child")), " ").alias("children"))
    rows = nodes.join(below, "id", "left").orderBy("id").select("id", "vertex", "level", F.coalesce("children", F.lit("")).alias("children"))
    rows.write.mode("overwrite").csv(path, emptyValue="")


def pieces(piece: DataFrame, path: str) -> None:
    """'dominator member ...' lines, both ascending."""
    rows = piece.groupBy("vertex").agg(F.array_join(F.sort_array(F.collect_list("member")), " ").alias("m")).orderBy("vertex")
    _lines(rows.select(F.concat_ws(" ", F.col("vertex").cast("string"), "m").alias("value")), path)


def node_info(info: DataFrame, path: str) -> None:
    """contig_id, offset (always 0), mean_abund with three digits, n_kmers."""
    rows = info.orderBy("id").select(F.col("id").alias("contig_id"), F.lit(0).alias("offset"), F.format_string("%.3f", F.col("abund").cast("double")).alias("mean_abund"), "n_kmers")
    rows.write.mode("overwrite").csv(path, header=True)


def id_list(ids: DataFrame, path: str, as_text: bool = False, compression: str | None = "gzip") -> None:
    """One id a line in numeric order, or in text order."""
    _lines(ids.distinct().orderBy(F.col("id").cast("string") if as_text else F.col("id")).select(F.col("id").cast("string").alias("value")), path, compression)


def response(curve: DataFrame, path: str) -> None:
    """The response curve with its header, space-separated, in place order: running and own figures of every node."""
    # fixed column names
    rows = curve.orderBy("place").select("sum_cont", "relative_cont", F.col("relative_oh").alias("relative_overhead"), F.col("cont").alias("sum_cont2"), F.col("oh").alias("sum_oh"), F.col("id").alias("catlas_id"))
    rows.write.mode("overwrite").csv(path, sep=" ", header=True)


def sequences(records: DataFrame, path: str, compression: str | None = None) -> None:
    """FASTA, or FASTQ for the records that have a quality; many files, in no order."""
    quality = F.col("quality") if "quality" in records.columns else F.lit(None).cast("string")
    value = F.when(quality.isNotNull(), F.concat_ws("\n", F.concat(F.lit("@"), "name"), "sequence", F.lit("+"), quality)).otherwise(F.concat_ws("\n", F.concat(F.lit(">"), "name"), "sequence"))
    records.select(value.alias("value")).write.mode("overwrite").text(path, compression=compression)


def signature(sketch: DataFrame, path: str, ksize: int, max_hash: int, seed: int = 42) -> None:
    """One signature JSON line per name, hashes (unsigned) ascending."""
    one = sketch.groupBy("name").agg(F.sort_array(F.collect_set("hash")).alias("mins"))
    sig = F.array(F.struct(F.lit(ksize).alias("ksize"), F.lit(0).alias("num"), F.lit(seed).alias("seed"), F.lit(str(max_hash)).cast("decimal(20,0)").alias("max_hash"), "mins", F.lit("DNA").alias("molecule")))
    one.select(F.to_json(F.array(F.struct("name", sig.alias("signatures")))).alias("value")).write.mode("overwrite").text(path)


def ordered_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV with a header, the rows in order over as many files as Spark makes partitions; their names follow the order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, emptyValue="")


def search_results(summary: DataFrame, path: str) -> None:
    """One row per query of a search: its containment, similarity, size and overheads."""
    # fixed column names
    columns = "query containment similarity bp contigs ksize num_query_kmers best_containment cdbg_min_overhead catlas_min_overhead catlas_name".split()
    ordered_csv(summary.select(*columns), path, "query")


def abundances(nodes: DataFrame, levels: DataFrame, path: str) -> None:
    """A sample's abundance of graph nodes (id, abund, size) and of dominators (dom_id, level, abund, size): cdbg_abund and dom_abund."""
    ordered_csv(nodes.select(F.col("id").alias("cdbg_id"), "abund", F.col("size").alias("node_size")), f"{path}/cdbg_abund", "cdbg_id")
    ordered_csv(levels.select("dom_id", "level", "abund", "size"), f"{path}/dom_abund", "level", "dom_id")


def annotation(records: DataFrame, hits: DataFrame, path: str) -> None:
    """Annotated records (record_number, record_name, ...) and the node ids of each (record_number, cdbg_id), one folder a record."""
    ordered_csv(records, f"{path}/records", "record_number")
    by_key(hits.select("record_number", "cdbg_id").distinct(), "record_number", f"{path}/ids")


def annotation_hits(hits: DataFrame, path: str) -> None:
    """hashval, catlas_base, filename, record_name of hashes in annotated neighbourhoods."""
    ordered_csv(hits.select("hashval", "catlas_base", "filename", "record_name").distinct(), path, "hashval", "record_name")


def unassembled(table: DataFrame, contigs: DataFrame, path: str) -> None:
    """Node table with rounded shares and weights, and FASTA of contigs (id, region, seq) named by id and region."""
    digits = {"contained": "%.3f", "n_weighted_kmers": "%.1f", "average_weight": "%.2f"}
    shown = [F.format_string(digits[c], F.col(c).cast("double")).alias(c) if c in digits else F.col(c) for c in "node_id contained n_kmers n_weighted_kmers average_weight shadow_size".split()]
    ordered_csv(table.select(*shown), f"{path}/nodes", "node_id")
    sequences(contigs.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("region").cast("string")).alias("name"), F.col("seq").alias("sequence")), f"{path}/contigs")


def composition(counts: DataFrame, path: str) -> None:
    """region, kmer, n as one row per region with a column per k-mer, and the list of regions; Parquet."""
    names = [r.kmer for r in counts.select("kmer").distinct().orderBy("kmer").collect()]  # bounded by the alphabet and k
    counts.groupBy("region").pivot("kmer", names).agg(F.sum("n")).na.fill(0).write.mode("overwrite").parquet(f"{path}/matrix")
    counts.select("region").distinct().write.mode("overwrite").parquet(f"{path}/regions")


def by_key(records: DataFrame, key: str, path: str) -> None:
    """Parquet with one folder per key, for results that are read one key at a time."""
    records.write.mode("overwrite").partitionBy(key).parquet(path)


def index_table(kmer_index: DataFrame, table: str, buckets: int) -> None:
    """The k-mer index as a table bucketed and sorted by k-mer: later joins on it need no shuffle of the index."""
    kmer_index.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(table)
