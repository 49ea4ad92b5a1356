"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often it is taken on average.  Of all rates from 0
to ``most`` under which each source's words add up to its target, those are wanted
that are nearest to one in relative entropy.  The dual of this problem is convex with
one multiplier per source, and its rates are exponentially tilted by size:
``min(most, exp(multiplier * size))``.

A rate depends on source and size alone, so documents are counted by these first,
and Newton's iterations run over this histogram: each is one distributed
aggregation that gives every source its words and their slope under the present
multiplier.  A step that leaves the bracket known to hold the solution is replaced
by the bracket's middle.  Multipliers, targets and counts stay tables; one number
(the largest relative error) comes to the driver per iteration.

Copies: the running sum of rates over a source's sizes, longest first, is rounded
at every size, so a source misses its target by half its longest document at most.
Then copies are added or taken away, of the longest that fit first, until a few
words are missing.  Documents of one size and source share its copies in
hash order of their ids, so reruns agree.

Defined cases: a null or empty text has size 0 and nothing is taken; a null source
is a source of its own and the last one; repeated rows are documents each; a source
without words has target 0; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import drop, staged, table

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often, no source grows more.
MOST = 3
#: Hash parts of documents of one size and source, for their order.
PARTS = 256
#: Rows of a table by source, or by source and size, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Relative error of a source's words at which Newton's iterations end, and their bound (halving alone needs fewer).
TOLERANCE, ITERATIONS = 1e-9, 200
#: Rounds in which sources add or drop copies; each leaves less than one document of those it moved.
CORRECTIONS = 3


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _side(df: DataFrame) -> DataFrame:
    """A written table as the small side of a join: broadcast if it was counted to be small, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: all words shared by weight, none above ``most`` times its source, what is over shared again.

    Sources are numbered in the order of their code points, null last, by range
    partitions; the rounds of sharing bring two sums to the driver each.
    """
    spark = sources.sparkSession
    order = [F.col("source").asc_nulls_last()]
    ranged = staged(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    one = staged(ranged.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "weighted")
    while True:
        r = one.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), most * F.col("source_size"))).alias("gone"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        share = ((r["all"] or 0) - (r.gone or 0)) / (r.weight or 1)
        target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(float(share)))
        over = ~F.col("full") & (target > most * F.col("source_size"))
        if not one.where(over).limit(1).count():
            return one.select("source", "source_size", target.alias("target"))
        one = staged(one.select("source", "source_size", "weight", (F.col("full") | over).alias("full")), "weighted")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def multipliers(cells: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """source, target, x: the dual's solution over ``cells`` (source, size, n) for ``wanted`` (source, source_size, target).

    Sources whose target is 0 or all that may be taken have no x.
    """
    top = math.log(most)
    least = cells.where("size > 0").groupBy("source").agg(F.min("size").alias("least"))
    right = least.withColumnRenamed("source", "_source")
    open_ = wanted.join(right, _same(F.col("source"), F.col("_source"))).where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    # at the lower end every size falls to the target's share or below, at the upper one all are at the top
    low = F.least(F.lit(0.0), F.ln(F.col("target") / F.col("source_size")) / F.col("least"))
    high = F.when(F.col("target") > F.col("source_size"), F.lit(top) / F.col("least")).otherwise(F.lit(0.0))
    state = staged(open_.select("source", "target", low.alias("low"), high.alias("high"), F.lit(0.0).alias("x"), F.lit(1.0).alias("error")), "dual")
    own = ["source", "target", "low", "high", "x", "error"]
    for _ in range(ITERATIONS):
        if not state.where(F.col("error") > TOLERANCE).limit(1).count():
            break
        s = _side(state.select(F.col("source").alias("_source"), *own[1:]))
        tilt = F.col("x") * F.col("size")
        words = F.col("n") * F.col("size") * F.exp(F.least(tilt, F.lit(top)))
        slope = F.when(tilt < top, words * F.col("size")).otherwise(F.lit(0.0))
        sums = cells.join(s, _same(F.col("source"), F.col("_source"))).groupBy(*own).agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        error = F.abs(F.col("words") - F.col("target")) / F.col("target")
        low = F.when(F.col("words") < F.col("target"), F.col("x")).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), F.col("x")).otherwise(F.col("high"))
        # Newton's step on the logarithm of the words, which is nearly straight in x
        step = F.col("x") - (F.ln("words") - F.ln("target")) * F.try_divide(F.col("words"), F.col("slope"))
        last = state
        state = sums.select("source", "target", low.alias("low"), high.alias("high"), "x", step.alias("step"), error.alias("error"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        done = (F.col("error") <= TOLERANCE) | (F.col("high") - F.col("low") <= 1e-15)
        following = F.when(done, F.col("x")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = staged(state.select("source", "target", "low", "high", following.alias("x"), F.when(done, F.lit(0.0)).otherwise(F.col("error")).alias("error")), "dual")
        drop(last)
    return state.select("source", "target", "x")


def copies(cells: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """source, size, n, k: how many copies the n documents of each source and size have together."""
    top = float(most)
    m = staged(multipliers(cells, wanted, most).select("source", "x"), "multipliers").withColumnRenamed("source", "_source")
    all_ = wanted.join(m, _same(F.col("source"), F.col("_source")), "left").select(F.col("source").alias("_source"), "source_size", "target", "x")
    side = _side(staged(all_, "rates"))
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(top)).when(F.col("x").isNull(), F.lit(0.0)).otherwise(F.exp(F.least(F.col("x") * F.col("size"), F.lit(math.log(most)))))
    rated = cells.where("size > 0").join(side, _same(F.col("source"), F.col("_source"))).select("source", "size", "n", "target", rate.alias("rate"))
    # the sizes of one source: as many rows as there are different sizes, not documents
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(down)
    upto_all = rated.withColumn("upto", F.floor(upto + 0.5))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    k = F.greatest(F.lit(0), F.least(F.col("upto") - before, most * F.col("n")))
    now = staged(upto_all.select("source", "size", "n", "target", k.cast("long").alias("k")), "copies")
    gap, sign = F.abs("missing"), F.signum("missing").cast("long")
    room = F.when(F.col("missing") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
    ahead = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for nearest in [False] * CORRECTIONS + [True]:
        missing = now.groupBy("source").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("missing"))
        side = _side(staged(missing.withColumnRenamed("source", "_source"), "missing"))
        open_ = now.join(side, _same(F.col("source"), F.col("_source"))).withColumn("room", room).where("room > 0")
        if nearest:
            left = F.abs(gap - F.col("size"))
            best = open_.where(left < gap).groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("size").alias("size"), sign.alias("more"))).alias("b")).select("source", "b.size", "b.more")
        else:
            # as many copies of the longest that fit as there are, then of the next
            used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(ahead), F.lit(0))
            best = open_.where(F.col("size") <= gap).withColumn("more", F.least("room", F.floor((gap - used) / F.col("size")))).where("more > 0").select("source", "size", (F.col("more") * sign).alias("more"))
        best = staged(best.toDF("_source", "_size", "more"), "corrections")
        if best.isEmpty():
            continue
        last = now
        at = _same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size"))
        now = staged(now.join(_side(best), at, "left").select("source", "size", "n", "target", (F.col("k") + F.coalesce("more", F.lit(0))).cast("long").alias("k")), "copies")
        drop(last)
    return now.select("source", "size", "n", "k")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per document row."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    sized = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), part.alias("part")), "sized")
    parts = staged(sized.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "parts")
    cells = staged(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sources = staged(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "sources")
    wanted = staged(targets(sources, weights, most), "targets")
    found = copies(cells, wanted, most).select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("n").alias("all"), "k")
    # copies that are left over go to the first documents of a cell, in the order of parts, then of ids
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = parts.where("size > 0").withColumn("earlier", earlier).join(found, _same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")))
    base = F.floor(F.col("k") / F.col("all"))
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - base * F.col("all") - F.col("earlier")))
    split = split.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("part").alias("_part"), base.alias("base"), extra.alias("extra"))
    own = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    ranked = sized.where("size > 0").withColumn("place", F.row_number().over(own))
    at = _same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("part") == F.col("_part"))
    times = (F.col("base") + (F.col("place") <= F.col("extra")).cast("long")).cast("long")
    taken = ranked.join(split, at).select("doc_id", "source", "size", times.alias("copies"))
    rows = taken.union(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies")))
    side = _side(wanted.withColumnRenamed("source", "_source"))
    return rows.join(side, _same(F.col("source"), F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", "copies")


def query(spark, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
