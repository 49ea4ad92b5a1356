"""Sketches: scaled (FracMinHash) and bottom-n, containment, similarity, abundances, gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import from_digits, h60_digits, kmer_h60, kmers
from ._stage import checked, staged
from .graph import renumber
from .index import ratio


def hashes(nodes: DataFrame, k: int, *keep: str, most: int = 2**60 - 1) -> DataFrame:
    """One row per k-mer occurrence with a hash of at most ``most``: kept columns and hash; a k-mer and its reverse complement hash alike."""
    return kmer_h60(nodes, "seq", k, *keep, most=most)


def scaled_sketch(nodes: DataFrame, k: int, scaled: int, *keep: str) -> DataFrame:
    """Distinct hashes of at most 2**60 / scaled, with their abundance."""
    return hashes(nodes, k, *keep, most=min(2**60 // scaled, 2**60 - 1)).groupBy(*keep, "hash").agg(F.count("*").alias("abund"))


def downsample(sketch: DataFrame, scaled: int) -> DataFrame:
    return sketch.where(F.col("hash") <= 2**60 // scaled)


def bottom_sketch(nodes: DataFrame, k: int, n: int, key: str) -> DataFrame:
    """key, rank, hash: the n smallest distinct hashes.

    A text's hashes above a bound that leaves several times n are dropped before they are
    ranked.  Keys that have fewer than n below the bounds of all their texts, such as those
    of repetitive texts, are done again with all hashes.
    """
    ranked = lambda found: found.withColumn("rank", F.dense_rank().over(Window.partitionBy(key).orderBy("hash"))).where(F.col("rank") <= n).distinct()
    enough, every = 8 * n + 32, "f" * 15
    size = F.length("seq") - k + 1
    most = F.when(size <= enough, F.lit(every)).otherwise(F.lpad(F.lower(F.hex((F.lit(2.0**60) * enough / size).cast("long"))), 15, "0"))
    rows = nodes.where(F.length("seq") >= k).select(key, "seq", most.alias("_most"))
    low = kmers(rows, "seq", k, key, "_most", both_strands=True).select(key, "_most", h60_digits(F.col("kmer")).alias("_digits")).where(F.col("_digits") <= F.col("_most"))
    first = staged(ranked(low.select(key, from_digits(F.col("_digits")).alias("hash"))), "bottom")
    own = F.struct(key).alias("_key")  # null is a key too
    bound = rows.groupBy(own).agg(F.min("_most").alias("_bound")).where(F.col("_bound") < every)
    told = first.groupBy(own).agg(F.max("hash").alias("_last"), F.count("*").alias("_n"))
    short = (F.coalesce("_n", F.lit(0)) < n) | (F.col("_last") > from_digits(F.col("_bound")))
    again = checked(bound.join(told, "_key", "left").where(short).select("_key"))
    rest = ranked(hashes(rows.withColumn("_key", own).join(again, "_key", "left_semi"), k, key))
    return first.withColumn("_key", own).join(again, "_key", "left_anti").select(key, "rank", "hash").union(rest.select(key, "rank", "hash"))


def overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """key_a, key_b, both, n_a, n_b, containment of a in b, and similarity, for pairs with a common hash."""
    a, b = staged(a.select(key_a, "hash"), "sketch"), staged(b.select(key_b, "hash"), "sketch")  # read twice
    size = lambda s, key, out: s.groupBy(key).agg(F.count("*").alias(out))
    both = a.join(b, "hash").groupBy(key_a, key_b).agg(F.count("*").alias("both"))
    return (
        both.join(size(a, key_a, "n_a"), key_a)
        .join(size(b, key_b, "n_b"), key_b)
        .withColumns({"containment": ratio(F.col("both"), F.col("n_a")), "similarity": ratio(F.col("both"), F.col("n_a") + F.col("n_b") - F.col("both"))})
    )


def composition(nodes: DataFrame, alphabet: str, k: int, group: str) -> DataFrame:
    """group, kmer, n for every k-mer over the alphabet, those that don't occur too."""
    letters = F.array(*map(F.lit, alphabet))
    all_ = nodes.sparkSession.range(len(alphabet) ** k)  # the domain: a few letters to the power k
    digit = lambda i: F.element_at(letters, (F.pmod(F.floor(F.col("id") / len(alphabet) ** i), F.lit(len(alphabet))) + 1).cast("int"))
    domain = all_.select(F.concat(*(digit(i) for i in reversed(range(k)))).alias("kmer"))
    counted = kmers(nodes, "seq", k, group).where(F.col("kmer").rlike(f"^[{alphabet}]+$")).groupBy(group, "kmer").agg(F.count("*").alias("n"))
    groups = nodes.select(group).distinct()
    return groups.crossJoin(F.broadcast(domain)).join(counted, [group, "kmer"], "left").select(group, "kmer", F.coalesce("n", F.lit(0)).alias("n"))


def gather(query: DataFrame, references: DataFrame, key: str, least: float = 0.0, rounds: int | None = None) -> DataFrame:
    """rank, key, unique, f_unique: references chosen greedily by the query hashes not yet explained; ties to the smaller key.

    It ends when no hash matches, the best share falls below ``least``, or after
    ``rounds`` references where that is given.  Counts only fall, so a reference that
    comes first (most hashes, then smaller key) among all that share a hash with it is
    chosen with its present count whatever happens elsewhere: each pass chooses all of
    these, and the order of choice is that of count and key.
    """
    left = staged(query.select("hash").distinct(), "gather")
    total, out = left.count(), None
    live = staged(references.select(key, "hash").distinct().join(left, "hash", "left_semi"), "gather-refs")
    while total:
        # counts don't rise again, so a share below the least never counts
        n = live.groupBy(key).agg(F.count("*").alias("unique")).where(F.col("unique") / total >= least)
        n = staged(n.withColumn("_at", F.struct((-F.col("unique")).alias("m"), F.col(key).alias("k"))), "gather-counts")
        if n.isEmpty():
            break
        live = live.join(n, key)
        first = live.groupBy("hash").agg(F.min("_at").alias("_first"))
        own = live.join(first, "hash").groupBy(key).agg(F.bool_and(F.col("_at") == F.col("_first")).alias("ok")).where("ok")
        new = staged(n.join(own, key, "left_semi"), "gather-chosen")
        out = new if out is None else out.unionByName(new)
        gone = live.join(new.select(key), key, "left_semi").select("hash")
        live = staged(live.select(key, "hash").join(gone, "hash", "left_anti"), "gather-refs")
    if out is None:
        return query.sparkSession.createDataFrame([], f"rank int, {key} {references.schema[key].dataType.simpleString()}, unique long, f_unique double")
    ranked = renumber(out, "_at").select((F.col("number") + 1).cast("int").alias("rank"), key, "unique", (F.col("unique") / total).alias("f_unique"))
    return ranked if rounds is None else ranked.where(F.col("rank") <= rounds)


def murmur_sketch(seq: DataFrame, k: int, scaled: int, hash_of, *keep: str) -> DataFrame:
    """Scaled sketch with 64-bit unsigned hashes; k-mers with other letters than ACGT are skipped."""
    from ..functions.sequence import under_scaled

    found = kmers(seq, "seq", k, *keep).where(~F.col("kmer").rlike("[^ACGT]")).select(*keep, hash_of(F.col("kmer")).alias("hash"))
    return found.where(under_scaled(F.col("hash"), scaled)).groupBy(*keep, "hash").agg(F.count("*").alias("abund"))


def max_hash(scaled: int) -> Column:
    return F.lit(2**60 // scaled)


def theta_sketches(records: DataFrame, k: int, *keep: str, lg: int = 12) -> DataFrame:
    """Kept columns and sketch: approximate sets of the k-mers of both strands, of 2**lg hashes at most, built by partial aggregation."""
    return hashes(records, k, *keep).groupBy(*keep).agg(F.theta_sketch_agg("hash", F.lit(lg)).alias("sketch"))


def theta_merged(sketches: DataFrame, *keep: str, lg: int = 12) -> DataFrame:
    """Kept columns and sketch: unions, such as those of all nodes under a dominator."""
    return sketches.groupBy(*keep).agg(F.theta_union_agg("sketch", F.lit(lg)).alias("sketch"))


def theta_overlap(few: DataFrame, many: DataFrame, key_few: str, key_many: str) -> DataFrame:
    """key_few, key_many, n_few, n_many, both, containment (of few in many), similarity: estimates for every pair of a query and a row.

    Two sketches hold enough for any of these; no k-mer is read again.  The queries are
    written and counted, and broadcast only if they are few.  Relative errors of sizes are
    about 1 / sqrt(2**lg).  Containment is the share of those hashes of a query that both
    sketches sample, so its standard error is at most 0.5 over the root of their number.
    """
    left = few.select(key_few, F.col("sketch").alias("_a"), F.theta_sketch_estimate("sketch").alias("n_few"))
    right = many.select(key_many, F.col("sketch").alias("_b"), F.theta_sketch_estimate("sketch").alias("n_many"))
    # intersection and difference have one sampling rate, unlike the whole sketch of a query
    estimate = lambda of: F.theta_sketch_estimate(of("_a", "_b"))
    pairs = right.crossJoin(checked(left, 10_000)).withColumns({"both": estimate(F.theta_intersection), "_rest": estimate(F.theta_difference)})  # a set of queries against all rows
    return pairs.select(key_few, key_many, "n_few", "n_many", "both", ratio(F.col("both"), F.col("both") + F.col("_rest")).alias("containment"), ratio(F.col("both"), F.col("n_few") + F.col("n_many") - F.col("both")).alias("similarity"))
