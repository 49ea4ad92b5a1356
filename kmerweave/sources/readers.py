"""Readers of sequence, graph and sketch formats into DataFrames with fixed schemas.

All are Spark text, CSV or JSON scans, so files split and gzip is read as it is
(block-gzip files are valid gzip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence of a FASTA file; sequence lines are joined.

    Records are split at line starts, so a '>' within a line does no harm.
    """
    rec = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>|\r", "")).where(F.trim("value") != "")
    head = F.element_at(F.split("value", "\n", 2), 1)
    body = F.coalesce(F.try_element_at(F.split("value", "\n", 2), F.lit(2)), F.lit(""))
    return rec.select(F.element_at(F.split(head, r"\s+", 2), 1).alias("name"), F.coalesce(F.try_element_at(F.split(head, r"\s+", 2), F.lit(2)), F.lit("")).alias("description"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, line (from 0): the lines of text files in the order of files and blocks."""
    from ..operators.graph import renumber

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return renumber(lines.withColumn("key", F.struct("file", "block", "i")), "key", "line").select("value", "line")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence, quality, number of strict four-line FASTQ records; a wrong mark or length raises.

    Lines are numbered over their file blocks in order, range-partitioned, and every
    four of them are folded into one record.
    """
    at = _numbered(spark, path)
    rec = at.groupBy(F.floor(F.col("line") / 4).alias("number")).agg(F.sort_array(F.collect_list(F.struct((F.col("line") % 4).alias("k"), "value"))).alias("l"))
    line = lambda k: F.try_element_at(F.col("l.value"), F.lit(k + 1))
    wrong = (F.size("l") != 4) | ~F.startswith(line(0), F.lit("@")) | (line(2) != "+") | (F.length(line(1)) != F.length(line(3)))
    head = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("no FASTQ record at number "), F.col("number").cast("string")))).otherwise(F.substring(line(0), F.lit(2), F.length(line(0))))
    return rec.withColumn("head", head).select(F.element_at(F.split("head", r"\s+", 2), 1).alias("name"), F.coalesce(F.try_element_at(F.split("head", r"\s+", 2), F.lit(2)), F.lit("")).alias("description"), line(1).alias("sequence"), line(3).alias("quality"), "number")


def unitigs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, sequence, abund) and arcs (src, dst) of an assembler's unitig FASTA with L: links and one km:f: abundance."""
    rec = fasta(spark, path)
    tags = F.split("description", r"\s+")
    part = lambda x: F.element_at(F.split(x, ":"), 3)
    km = F.filter(tags, lambda t: F.startswith(t, F.lit("km:f:")))
    abund = F.when(F.size(km) == 1, part(km[0]).cast("double")).otherwise(F.raise_error("a unitig needs exactly one km:f: tag"))
    nodes = rec.select(F.col("name").cast("long").alias("name"), "sequence", abund.alias("abund"))
    links = rec.select(F.col("name").cast("long").alias("src"), F.explode(F.filter(tags, lambda t: F.startswith(t, F.lit("L:")))).alias("l"))
    return nodes, links.select("src", part(F.col("l")).cast("long").alias("dst"))


def gxt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id) and edges (src, dst, both directions) of a graph file: vertex count, then 'u v' lines; self-loops are dropped."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    count = parts.where(F.size("p") == 1).first()
    n = int(count.p[0]) if count else 0
    e = parts.where(F.size("p") >= 2).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst")).where("src <> dst")
    return spark.range(n), e.union(e.select("dst", "src")).distinct()


def two_block_graph(spark: SparkSession, path: str, consecutive: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (id, size, attributes) and edges (src, dst, attributes) of the older comma-separated graph file.

    A header and one line per vertex, a blank line, a header and one line per edge; a
    second blank line ends the file.  Fields beyond the second are attributes, named by
    the header.  With ``consecutive`` ids are dense in the order in which they first come.
    """
    from ..operators._stage import staged
    from ..operators.graph import renumber

    at = staged(_numbered(spark, path).select("line", F.trim("value").alias("value")), "lines")
    blank = [r.line for r in at.where("value = ''").orderBy("line").limit(2).collect()]
    first = blank[0] if blank else at.count()
    last = blank[1] if len(blank) > 1 else None
    field = F.split("value", r"\s*,\s*")

    def block(head: int, end: int | None) -> DataFrame:
        row = at.where(F.col("line") == head).select(field.alias("f")).first()
        names = (row.f if row else [])[2:]
        inside = at.where((F.col("line") > head) & (F.col("line") < end if end is not None else F.lit(True))).select("line", field.alias("f"))
        attributes = F.map_from_arrays(F.array(*(F.lit(n) for n in names)).cast("array<string>"), F.transform(F.sequence(F.lit(3), F.lit(2 + len(names))), lambda i: F.try_element_at("f", i)) if names else F.array().cast("array<string>"))
        return inside.select("line", F.col("f")[0].cast("long").alias("a"), F.col("f")[1].cast("long").alias("b"), attributes.alias("attributes"))

    v, e = block(0, first), block(first + 1, last)
    if consecutive:
        seen = v.select(F.struct("line", F.lit(0)).alias("at"), F.col("a").alias("old"))
        for i, c in enumerate("ab"):
            seen = seen.union(e.select(F.struct("line", F.lit(i)).alias("at"), F.col(c).alias("old")))
        ids = staged(renumber(seen.groupBy("old").agg(F.min("at").alias("at")), "at").select("old", "number"), "ids")
        moved = lambda df, c: df.join(ids.withColumnRenamed("old", c), c).drop(c).withColumnRenamed("number", c)
        v, e = moved(v, "a"), moved(moved(e, "a"), "b")
    return v.select(F.col("a").alias("id"), F.col("b").alias("size"), "attributes"), e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "attributes")


def lineages(spark: SparkSession, path: str) -> DataFrame:
    """name, lineage (superkingdom to strain) of a CSV of accessions; empty ranks at the end are left out."""
    ranks = "superkingdom phylum class order family genus species strain".split()  # fixed values of the format
    rows = spark.read.csv(path, header=True)
    names = F.array(*(F.coalesce(F.trim(f"`{r}`"), F.lit("")) for r in ranks))
    known = F.size(F.split(F.regexp_replace(F.array_join(names, "\x1f"), "\x1f+$", ""), "\x1f"))
    return rows.select(F.col("accession").alias("name"), F.filter(F.slice(names, F.lit(1), known), lambda x, i: (i > 0) | (x != "")).alias("lineage"))


def mxt(spark: SparkSession, path: str) -> DataFrame:
    """vertex, hash (unsigned) of lines 'vertex h1 h2 ...'."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.col("p")[0].cast("long").alias("vertex"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1)))).alias("h")).where(F.col("h").isNotNull()).select("vertex", F.col("h").cast("decimal(20,0)").alias("hash"))


def node_info(spark: SparkSession, path: str, min_abund: float = 0.0) -> DataFrame:
    """contig_id, offset, mean_abund, n_kmers of at least the abundance."""
    info = spark.read.csv(path, header=True, schema="contig_id long, offset long, mean_abund double, n_kmers long")
    return info.where(F.col("mean_abund") >= min_abund) if min_abund else info


def hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, vertex, level) and child (parent, child) of lines 'id,vertex,level,children'."""
    rows = spark.read.csv(path, schema="id long, vertex long, level int, children string")
    child = rows.select(F.col("id").alias("parent"), F.explode(F.filter(F.split("children", " "), lambda c: c != "").cast("array<long>")).alias("child"))
    return rows.select("id", "vertex", "level"), child


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """vertex, member of lines 'dominator member member ...'."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), " ").alias("p"))
    return rows.select(F.col("p")[0].cast("long").alias("vertex"), F.explode(F.slice("p", F.lit(2), F.size("p")).cast("array<long>")).alias("member"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct whole numbers, one a line; blank lines are skipped.  Also for hash lists."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("decimal(20,0)").alias("id")).distinct()


def signatures(spark: SparkSession, path: str, scaled: int | None = None) -> DataFrame:
    """name, ksize, molecule, hash (unsigned) of signature JSON files; with ``scaled`` only hashes under its bound."""
    schema = "array<struct<name: string, filename: string, signatures: array<struct<ksize: int, num: int, seed: int, max_hash: decimal(20,0), mins: array<decimal(20,0)>, molecule: string>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("s"))
    rows = whole.select(F.coalesce("s.name", "s.filename").alias("name"), F.explode("s.signatures").alias("g")).select("name", "g.ksize", "g.molecule", F.explode("g.mins").alias("hash"))
    return rows if scaled is None else rows.where(F.col("hash") <= F.lit(str(2**64 // scaled)).cast("decimal(20,0)"))


def _fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of FASTA files in order, with what comes before each: record (headers up to it), bases (of all sequence lines before) and bytes."""
    from ..operators.hierarchy import running

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    head = F.startswith("value", F.lit(">"))
    lines = lines.withColumns({"head": head, "seq": F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))})
    order = [F.col("file"), F.col("block"), F.col("i")]
    return running(lines, order, record=F.col("head").cast("long"), bases=F.length("seq"), bytes=F.octet_length("value") + 1)


def fasta_pieces(spark: SparkSession, path: str, size: int = 16_384, overlap: int = 0) -> DataFrame:
    """record, name, start, piece: the sequences of FASTA files in pieces of about ``size`` letters and the ``overlap`` letters that follow.

    A record of many lines is read by as many tasks as its file has splits: running sums
    over range partitions tell every line its record and its place in it, and lines are
    put together within pieces only.  Pieces that overlap by k - 1 hold every k-mer of a
    record once.  A line before the first header of its file raises.  (A line is never
    split, so a record on one line is read by one task, like any text.)
    """
    from ..operators._stage import staged

    at = staged(_fasta_lines(spark, path), "fasta-lines")
    heads = at.where("head").select("record", F.col("file").alias("_file"), F.col("bases").alias("base"), F.element_at(F.split(F.regexp_replace("value", r"^>\s*|\r", ""), r"\s+", 2), 1).alias("name"))
    body = at.where("not head and seq <> ''").join(heads, "record", "left")
    lost = F.col("_file").isNull() | (F.col("_file") != F.col("file"))
    name = F.when(lost, F.raise_error(F.concat(F.lit("no record starts before line "), F.col("value")))).otherwise(F.col("name"))
    start = F.col("bases") - F.length("seq") - F.col("base")
    cells = body.select("record", name.alias("name"), start.alias("start"), "seq").withColumn("cell", F.floor(F.col("start") / size))
    whole = cells.groupBy("record", "name", "cell").agg(F.min("start").alias("start"), F.array_join(F.array_sort(F.collect_list(F.struct("start", "seq")))["seq"], "").alias("piece"))
    if not overlap:
        return whole.select("record", "name", "start", "piece")
    whole = staged(whole, "fasta-cells")
    # only the first letters of the pieces are looked at across a record
    ahead = whole.select("record", "cell", F.lead(F.left("piece", F.lit(overlap))).over(Window.partitionBy("record").orderBy("cell")).alias("ahead"))
    return whole.join(ahead, ["record", "cell"]).select("record", "name", "start", F.concat("piece", F.coalesce("ahead", F.lit(""))).alias("piece"))


def fasta_offsets(spark: SparkSession, path: str) -> DataFrame:
    """file, name, description, offset (bytes before the record in its file), length of every record."""
    from ..operators._stage import staged

    at = staged(_fasta_lines(spark, path), "fasta-lines")
    own = F.col("bytes") - F.octet_length("value") - 1
    first = at.groupBy("file").agg(F.min(own).alias("_first"))
    lengths = at.groupBy("record").agg(F.sum(F.length("seq")).alias("length"))
    head = F.split(F.regexp_replace("value", r"^>\s*|\r", ""), r"\s+", 2)
    named = at.where("head").select("record", "file", F.element_at(head, 1).alias("name"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")).alias("description"), own.alias("_own"))
    return named.join(first, "file").join(lengths, "record").select("file", "name", "description", (F.col("_own") - F.col("_first")).alias("offset"), "length")


def lca_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, hash) and (name, lineage) of a lowest-common-ancestor database: one JSON object whose keys are data.

    Hashes are unsigned; a name without a lineage has none, and ranks without a name at a
    lineage's end are left out.
    """
    # fixed field names of the format
    schema = "ident_to_idx map<string, bigint>, idx_to_lid map<string, bigint>, lid_to_lineage map<string, array<array<string>>>, hashval_to_idx map<string, array<bigint>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    part = lambda field, k, v: whole.select(F.explode(f"d.{field}").alias(k, v))
    names = part("ident_to_idx", "name", "idx")
    hashes = part("hashval_to_idx", "hash", "all").select(F.col("hash").cast("decimal(20,0)").alias("hash"), F.explode("all").alias("idx"))
    taxa = F.transform("ranks", lambda r: F.coalesce(r[1], F.lit("")))
    known = F.size(F.split(F.regexp_replace(F.array_join(taxa, "\x1f"), "\x1f+$", ""), "\x1f"))
    lineages_ = part("idx_to_lid", "idx", "lid").join(part("lid_to_lineage", "lid_", "ranks"), F.col("lid") == F.col("lid_").cast("long"))
    lineages_ = lineages_.select(F.col("idx").cast("long").alias("idx"), F.filter(F.slice(taxa, F.lit(1), known), lambda x, i: (i > 0) | (x != "")).alias("lineage"))
    return names.join(hashes, "idx").select("name", "hash"), names.join(lineages_, "idx").select("name", "lineage")
