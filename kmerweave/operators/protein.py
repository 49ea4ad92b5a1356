"""Amino-acid k-mers: inverted index of records, hits by record, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmers, murmur, translate_frames, under_scaled
from ._stage import checked


def amino_kmers(records: DataFrame, k: int, *keep: str, translate: bool = False) -> DataFrame:
    """Kept columns and kmer: all runs of k amino acids of proteins (column seq), or of the six reading frames of nucleotides."""
    frames = records.select(*keep, F.explode(translate_frames(F.col("seq"))).alias("seq")) if translate else records
    return kmers(frames, "seq", k, *keep).select(*keep, "kmer")


def amino_keys(records: DataFrame, k: int, *keep: str, translate: bool = False) -> DataFrame:
    """The same, once each, as 96-bit hashes (kmer: struct of a long and an int)."""
    found = amino_kmers(records, k, *keep, translate=translate)
    return found.select(*keep, F.struct(F.xxhash64("kmer").alias("h"), F.hash("kmer").alias("c")).alias("kmer")).distinct()


def record_index(records: DataFrame, k: int, key: str = "record", translate: bool = False) -> DataFrame:
    """kmer, key: an inverted index that keeps all records of a k-mer."""
    return amino_keys(records, k, key, translate=translate)


def record_hits(nodes: DataFrame, index: DataFrame, k: int, key: str = "record") -> DataFrame:
    """key, id: nodes (id, seq: nucleotides) one of whose reading frames has a k-mer of the record, for every record.

    The index is the smaller side as a rule; its distinct k-mers sift the nodes' before
    these are made distinct and shuffled.
    """
    return _pairs(amino_kmers(nodes, k, "id", translate=True), index, key)


def protein_hits(proteins: DataFrame, index: DataFrame, k: int, key: str = "record") -> DataFrame:
    """The same for nodes (id, seq) that are proteins themselves."""
    return _pairs(amino_kmers(proteins, k, "id"), index, key)


def _pairs(found: DataFrame, index: DataFrame, key: str) -> DataFrame:
    keyed = found.select("id", F.struct(F.xxhash64("kmer").alias("h"), F.hash("kmer").alias("c")).alias("kmer"))
    own = keyed.join(checked(index.select("kmer").distinct()), "kmer", "left_semi").distinct()
    return own.join(index, "kmer").select(key, "id").distinct()


def protein_sketch(records: DataFrame, k: int, scaled: int, *keep: str, translate: bool = False) -> DataFrame:
    """Kept columns, hash, abund: murmur hashes (seed 42, unsigned as bit patterns) of amino-acid k-mers of at most 2**64 / scaled."""
    found = amino_kmers(records, k, *keep, translate=translate).select(*keep, murmur(F.col("kmer")).alias("hash"))
    return found.where(under_scaled(F.col("hash"), scaled)).groupBy(*keep, "hash").agg(F.count("*").alias("abund"))
