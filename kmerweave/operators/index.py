"""k-mer index and matching: node sizes, unique k-mers, query matches, containment.

A k-mer and its reverse complement are one; tables hold the 96-bit hash of the
smaller strand as ``kmer``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmer_keys, packed_stretches, shares, stretch_keys, stretches, string_keys
from . import bloom
from ._stage import BROADCAST_ROWS, checked, counted, staged

#: k-mers of nodes that a task holds before repeated ones go; marks (a power of two) that tell which a read may have.
HELD, MARKS = 2**22, 2**22
#: Deals of a task, about: of more its rows are shorter, of fewer tasks differ more.
DEALS = 8


def node_sizes(nodes: DataFrame, k: int) -> DataFrame:
    """id, n_kmers: k-mers of each node with repeats, dropped ones included."""
    return nodes.where(F.length("seq") >= k).select("id", (F.length("seq") - k + 1).cast("long").alias("n_kmers"))


def occurrences(nodes: DataFrame, k: int) -> DataFrame:
    """id, kmer: one row per node and distinct k-mer."""
    return kmer_keys(nodes, "seq", k, "id").select("id", "kmer").distinct()


def unique_index(nodes: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """kmer, id of the k-mers that occur in one node only; k-mers of several nodes are left out.

    With ``wanted`` (column kmer) only those are looked up: a semi-join comes before the
    uniqueness count, which needs no other k-mer.  Where there are too many to be
    broadcast, a Bloom filter comes before the count instead, and the semi-join after it:
    tasks then sum up repeated k-mers before these are shuffled.
    """
    if wanted is None:
        return spans(nodes, k).where("a = b").select(F.struct("h", "c").alias("kmer"), F.col("a").alias("id"))
    found = kmer_keys(nodes, "seq", k, "id").select("id", "kmer")
    # smallest and largest id tell apart one node from several without holding a set
    summed = lambda df: df.groupBy("kmer").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").select("kmer", "id")
    some, keys, _ = asked_for(found, wanted)
    return summed(some) if keys is None else summed(some).join(keys.hint("shuffle_hash"), "kmer", "left_semi")


def asked_for(found: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of ``found`` (kmer) that ``wanted`` (kmer) may have, without a shuffle, and the number of wanted rows.

    Few wanted k-mers are broadcast, and the rows are exactly theirs; of many a Bloom
    filter is, and the keys come too, for the caller to join by what is left.
    """
    # a semi-join and a filter need no distinct keys
    keys, seen = counted(wanted.select("kmer"), "wanted-keys")
    if seen.n <= BROADCAST_ROWS:
        # most rows fall at the half of the key that is a number, which is looked up faster
        near = found.join(F.broadcast(keys.select(F.col("kmer.h").alias("_h")).distinct()), F.col("kmer.h") == F.col("_h"), "left_semi")
        return near.join(F.broadcast(keys), "kmer", "left_semi"), None, seen.n
    filter_ = bloom.build(keys, "kmer", seen.n)
    return found if filter_ is None else bloom.sift(found, "kmer", staged(filter_, "filter")), keys, seen.n


def spans(nodes: DataFrame, k: int) -> DataFrame:
    """h, c (the hash of a k-mer), a, b: the smallest and the largest id of the nodes that hold it.

    Stretches are dealt out by minimizer, so all that holds a k-mer is in one task and no
    k-mer is shuffled.
    """
    dealt = stretches(nodes, "seq", k, "id").repartition(shares(nodes, "seq"), "deal")
    # repeated stretches are one before they are cut
    once = dealt.groupBy("deal", "stretch").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return stretch_keys(once, k, "deal", "a", "b").groupBy("deal", "h", "c").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("deal")


def _with_reads(nodes: DataFrame, reads: DataFrame, k: int, read) -> DataFrame:
    """deal, stretch, id, read: the stretches of nodes (no read) and of reads (no id), dealt out together."""
    mine = stretches(nodes, "seq", k, "id")
    theirs = stretches(reads.select(read.alias("read"), "seq"), "seq", k, "read")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = mine.select("deal", "stretch", "id", none(theirs, "read").alias("read")).union(theirs.select("deal", "stretch", none(mine, "id"), "read"))
    return both.repartition(shares(nodes, "seq") + shares(reads, "seq"), "deal")


def own_hits(nodes: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """id, abund: how often the k-mers that one node alone has occur in the reads (seq)."""
    ends = lambda a, b: (F.min(a).alias("a"), F.max(b).alias("b"))
    once = _with_reads(nodes, reads, k, F.lit(1)).groupBy("deal", "stretch").agg(*ends("id", "id"), F.count("read").alias("n"))
    each = stretch_keys(once, k, "deal", "a", "b", "n").groupBy("deal", "h", "c").agg(*ends("a", "b"), F.sum("n").alias("n"))
    return each.where("a = b and n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("abund"))


def own_labels(nodes: DataFrame, reads: DataFrame, k: int, *keys: str) -> DataFrame:
    """Keys of the reads (and seq), id: the nodes that alone have one of a read's k-mers.

    A task has all stretches of its minimizers and hashes their k-mers by columns; of the
    nodes' only those that a read may have are sorted.
    """
    tasks = shares(nodes, "seq") + shares(reads, "seq")
    deals = min(DEALS * tasks, 2**16)
    mine = packed_stretches(nodes.where("id is not null"), "seq", k, deals, "id")
    theirs = packed_stretches(reads.select(F.struct(*keys).alias("read"), "seq"), "seq", k, deals, "read")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = mine.select("deal", "texts", "sizes", "id", none(theirs, "read")).union(theirs.select("deal", "texts", "sizes", none(mine, "id"), "read"))
    rows = both.repartition(tasks, "deal").drop("deal")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.elementType.simpleString()}" for c in ("read", "id"))

    def keys_in(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return string_keys("".join(b.column("texts").to_pylist()), b.column("sizes").flatten().to_numpy().astype(np.int64), k)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names, held, names_of, new = [], [], [], {}, 0
        n, kind = 0, None
        for b in batches:
            kind = b.column("id").type.value_type
            own = b.filter(pc.is_null(b.column("read")))
            ids = own.column("id").flatten()
            if pa.types.is_integer(kind):
                ids = ids.to_numpy().astype(np.int64)
            else:  # other ids by numbers
                ids = np.array([names_of.setdefault(x, len(names_of)) for x in ids.to_pylist()], np.int64)
            for row, h, c in keys_in(own):
                held.append((h, c, ids[row], ids[row]))
                new += len(h)
                if new > HELD:  # repeated stretches of many nodes
                    held, new = [_ends(held)], 0
            theirs = b.filter(pc.is_valid(b.column("read")))
            for row, h, c in keys_in(theirs):
                asked.append((h, c, row + n))
            names.append(theirs.column("read").flatten())
            n += len(names[-1])
        if not asked or not held:
            return
        (h, c, read), one = ([np.concatenate(x) for x in zip(*rows)] for rows in (asked, held))
        some = np.zeros(MARKS, bool)
        some[h & (MARKS - 1)] = True
        near = some[one[0] & (MARKS - 1)]
        one = [x[near] for x in one]
        h, c = np.concatenate([h, one[0]]), np.concatenate([c, one[1]])
        # k-mers in order of their hash; a read has no ends, and more than all ids of nodes before it
        order = np.lexsort((c, h))
        far = np.iinfo(np.int64)
        low = np.concatenate([np.full(len(read), far.max), one[2]])[order]
        high = np.concatenate([np.full(len(read), far.min), one[3]])[order]
        begin = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]))
        low, high = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        told = (order < len(read)) & (low == high)[group]
        row, id_ = read[order[told]], low[group[told]]
        order = np.lexsort((id_, row))
        row, id_ = row[order], id_[order]
        keep = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (id_[1:] != id_[:-1])])) if len(row) else row
        row, id_ = row[keep], id_[keep]
        reads_ = pa.chunked_array(names).combine_chunks()
        by_number = list(names_of)
        for lo in range(0, len(row), HELD // 16):
            part = slice(lo, lo + HELD // 16)
            ids = pa.array([by_number[i] for i in id_[part]], kind) if by_number else pa.array(id_[part]).cast(kind)
            yield pa.record_batch([reads_.take(pa.array(row[part])), ids], ["read", "id"])

    return rows.mapInArrow(label, kinds).distinct().select("read.*", "id")


def _ends(held: list[tuple]) -> tuple:
    """h, c and the smallest and largest id of every k-mer, once."""
    h, c, low, high = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    return h[begin], c[begin], np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)


def collisions(nodes: DataFrame, k: int) -> DataFrame:
    """n_kmers, n_multi: distinct k-mers, and those of several nodes."""
    each = spans(nodes, k)
    return each.agg(F.count("*").alias("n_kmers"), F.count_if(F.col("a") < F.col("b")).alias("n_multi"))


def query_kmers(queries: DataFrame, k: int) -> DataFrame:
    """query, kmer: distinct k-mers of each query record."""
    return kmer_keys(queries, "seq", k, "query").select("query", "kmer").distinct()


def dealt_kmers(queries: DataFrame, k: int) -> DataFrame:
    """query, deal, kmer: the same with the minimizer by which a kept index is dealt out."""
    return stretch_keys(stretches(queries, "seq", k, "query"), k, "query", "deal").select("query", "deal", F.struct("h", "c").alias("kmer")).distinct()


def matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, matches: distinct query k-mers that each node holds."""
    return wanted.select("kmer").distinct().join(index, "kmer").groupBy("id").agg(F.count("*").alias("matches"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def containment(index: DataFrame, wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """query, n_query, n_found, containment: exact share of a query's k-mers that the index has; empty queries have 0."""
    found = wanted.join(index.select("kmer").withColumn("hit", F.lit(1)), "kmer", "left").groupBy("query").agg(F.count("*").alias("n_query"), F.count("hit").alias("n_found"))
    all_ = queries.select("query").distinct().join(found, "query", "left").fillna(0, ["n_query", "n_found"])
    return all_.withColumn("containment", ratio(F.col("n_found"), F.col("n_query")))


def overheads(matched: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, matches, n_kmers, overhead: share of a matched node's k-mers that the query lacks."""
    return matched.join(sizes, "id").withColumn("overhead", ratio(F.col("n_kmers") - F.col("matches"), F.col("n_kmers")))


def shares_kmer(records: DataFrame, baits: DataFrame, k: int, *keep: str) -> DataFrame:
    """Records (kept columns) that share a k-mer with any bait."""
    wanted = checked(kmer_keys(baits, "seq", k).select("kmer").distinct())
    return kmer_keys(records, "seq", k, *keep).join(wanted, "kmer", "left_semi").select(*keep).distinct()


def missing_report(nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, least, most, n_bp: the least and most of 0/1 presence over a node's k-mers."""
    hit = kmer_keys(nodes, "seq", k, "id").join(checked(wanted.select("kmer").distinct().withColumn("hit", F.lit(1))), "kmer", "left")
    each = hit.groupBy("id").agg(F.min(F.coalesce("hit", F.lit(0))).alias("least"), F.max(F.coalesce("hit", F.lit(0))).alias("most"))
    return each.join(nodes.select("id", F.length("seq").alias("n_bp")), "id")
