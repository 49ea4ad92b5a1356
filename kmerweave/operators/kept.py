"""A k-mer index that is kept as a table, grows with new nodes, and is read without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.sequence import stretch_keys, stretches
from . import index


class KeptIndex:
    """The k-mers of nodes (h, c: the 96 bits of a hash) with the smallest and the largest node id that has them.

    What is kept are stretches of k-mers with one minimizer, bucketed and sorted by it: a
    few characters for each k-mer, where a row of its own would take thirty bytes, and
    no k-mer is shuffled to build it.  Buckets are cut into k-mers as they are read; each
    holds all that has a k-mer.  A k-mer is one node's where both ids are equal.

    A growing index takes the stretches of new nodes, so a k-mer that becomes shared drops
    out of the unique ones, and the result is that of a build over all nodes.  Rows tell
    the version they came with, so readers of an older one may go on.  An index that
    outgrows its buckets is written anew, into more of them.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, buckets: int = 64):
        self.spark, self.folder, self.k, self.buckets = spark, folder.rstrip("/"), k, buckets
        self.version, self.table, self.size = 0, "", 0

    def _of(self, nodes: DataFrame) -> DataFrame:
        """The stretches of nodes; their characters count towards the index's size."""
        self.size += nodes.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
        return stretches(nodes, "seq", self.k, "id").select("deal", "stretch", F.col("id").alias("least"), F.col("id").alias("most"))

    def _write(self, rows: DataFrame, anew: bool) -> KeptIndex:
        version = self.version + 1
        if anew:
            self.table, self.buckets = f"kept_{uuid.uuid4().hex}", max(self.buckets, -(-2 * self.size // sequence.SHARE))
            self.place = f"{self.folder}/v{version}"
        # repeated stretches are one
        once = rows.repartition(self.buckets, "deal").groupBy("deal", "stretch").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        out = once.withColumn("version", F.lit(version)).write.mode("append").bucketBy(self.buckets, "deal").sortBy("deal", "stretch")
        out.option("compression", "zstd").option("path", self.place).saveAsTable(self.table)
        self.version = version
        return self

    def build(self, nodes: DataFrame) -> KeptIndex:
        """The index of nodes (id, seq)."""
        self.size = 0
        return self._write(self._of(nodes), True)

    def grow(self, nodes: DataFrame) -> KeptIndex:
        """The index with the k-mers of more nodes."""
        if not self.table:
            return self.build(nodes)
        new = self._of(nodes)
        if self.size <= sequence.SHARE * self.buckets:
            return self._write(new, False)
        return self._write(self._held().union(new), True)

    def _held(self) -> DataFrame:
        """deal, stretch, least, most of the present version."""
        return self.spark.table(self.table).where(F.col("version") <= self.version).drop("version")

    def _kmers(self, held: DataFrame) -> DataFrame:
        return stretch_keys(held, self.k, "deal", "least", "most").select("deal", F.struct("h", "c").alias("kmer"), "least", "most")

    def _ends(self, kmers: DataFrame) -> DataFrame:
        each = kmers.select("deal", "kmer.h", "kmer.c", "least", "most").groupBy("deal", "h", "c")
        return each.agg(F.min("least").alias("least"), F.max("most").alias("most")).drop("deal")

    def rows(self) -> DataFrame:
        """h, c, least, most of the present version."""
        return self._ends(self._kmers(self._held()))

    def _own(self, ends: DataFrame) -> DataFrame:
        return ends.where("least = most").select("h", "c", F.col("least").alias("id"))

    def unique(self) -> DataFrame:
        """h, c, id of the k-mers of one node."""
        return self._own(self.rows())

    def hits(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (kmer, and other columns) with the id of the node that alone has their k-mer.

        Where ``wanted`` has a column ``deal`` too, that of ``dealt_kmers``, only stretches
        of these minimizers are cut.  The index's k-mers that may be wanted are written,
        bucketed by k-mer, so no more of it is moved than that.
        """
        held = self._held()
        if "deal" in wanted.columns:
            held = held.join(F.broadcast(wanted.select("deal").distinct()), "deal", "left_semi")  # 2**16 at most
        some, _, n = index.asked_for(self._kmers(held), wanted)
        own, parts = self._own(self._ends(some)), max(self.buckets, -(-n // index.BROADCAST_ROWS))
        name = f"hits_{uuid.uuid4().hex}"
        own.repartition(parts, "h", "c").write.bucketBy(parts, "h", "c").sortBy("h", "c").option("path", f"{self.folder}/{name}").saveAsTable(name)
        keyed = wanted.select("*", "kmer.h", "kmer.c")
        return self.spark.table(name).hint("merge").join(keyed, ["h", "c"]).select(*wanted.columns, "id")

    def matches(self, wanted: DataFrame) -> DataFrame:
        """id, matches: distinct k-mers of ``wanted`` (kmer, and deal where it is known) that each node has alone."""
        return self.hits(wanted.select(*(c for c in ("kmer", "deal") if c in wanted.columns)).distinct()).groupBy("id").agg(F.count("*").alias("matches"))

    def collisions(self) -> DataFrame:
        """n_kmers, n_multi: distinct k-mers, and those of several nodes."""
        return self.rows().agg(F.count("*").alias("n_kmers"), F.count_if(F.col("least") < F.col("most")).alias("n_multi"))
