"""Exact top-k inner products by a pivot-distance index.

Vectors become integer vectors.  One more coordinate, the root of (largest squared
norm - own squared norm), gives all vectors one length, so the largest inner
products are the smallest distances and the triangle inequality applies.  Pivots
are chosen by farthest-first traversal of a bounded sample.  The index keys every
vector by its nearest pivot and the distance to it, sorted by (pivot, distance)
and packed into blocks; a block is a run of annuli of one pivot.

A group of queries near one pivot first searches the blocks of its own cell, which
bounds its k-th distance; then it visits every block that the bound doesn't rule
out: |d(query, pivot) - d(vector, pivot)| is at most the distance of the two.
Within a block, annuli are expanded from the nearest one on, and each query stops
by the same bound.  Ties go to the smaller id, so a bound that is met is no reason
to stop.

Scores are sums of integer products in float64, exact while every product of norms
is below 2**53, and in Python integers beyond that; they must fit a long.

Defined cases: null vectors and vectors with a null or non-finite component take
no part; shorter vectors are padded with zeros; a query with fewer candidates gets
them all; repeated rows are candidates each, a
repeated query id asks once; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import staged, table

SCALE = 256
K = 5
QUERY_EVERY = 50
#: Vectors that pivots are chosen from, at most, and pivots.
SAMPLE = 4096
PIVOTS = 64
#: Vectors of a block, of an annulus, and queries of a group, at most.
BLOCK = 8192
ANNULUS = 512
GROUP = 128
#: Slack of the bounds, relative to the largest norm, for rounding.
SLACK = 1e-6


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, v (whole numbers as doubles) and q (squared norm) of the vectors that take part."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("id"), x.alias("v")).withColumn("q", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first traversal."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _matrix(lists: pa.Array, q: np.ndarray, dim: int, top: float) -> np.ndarray:
    """Rows padded to dim, and the coordinate that gives all one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), dim + 1))
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)] = flat
    out[:, dim] = np.sqrt(np.maximum(0.0, top - q))
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0.0))


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole-number rows."""
    if exact:
        return a @ b.T
    whole = lambda x: np.array([[int(e) for e in r] for r in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T


_BLOCK = "block long, pivot int, low double, high double, ids binary, dist binary, vecs binary"
_GROUP = "grp long, pivot int, ids binary, vecs binary"


def _packed(rows: DataFrame, size: int, fields: str, build) -> DataFrame:
    """Runs of sorted rows of one pivot, at most ``size`` long, as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def runs(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
            p = t.column("pivot").to_numpy()
            out, at = [], 0
            while at < len(p):
                to = min(int(np.searchsorted(p, p[at], side="right")), at + size)
                if to == len(p) and to - at < size and not last:
                    return out, t.slice(at)
                out.append(t.slice(at, to - at))
                at = to
            return out, None

        for b in batches:
            held.append(pa.table(b))
            count += b.num_rows
            if count >= 2 * size:
                done, rest = runs(pa.concat_tables(held).combine_chunks(), False)
                held, count = ([rest], rest.num_rows) if rest is not None else ([], 0)
                for t in done:
                    yield build(t)
        if held:
            for t in runs(pa.concat_tables(held).combine_chunks(), True)[0]:
                yield build(t)

    return rows.mapInArrow(run, fields)


def _one(values: list, names: list[str]) -> pa.RecordBatch:
    types = {int: pa.int64(), float: pa.float64(), bytes: pa.binary()}
    return pa.record_batch([pa.array([v], pa.int32() if n == "pivot" else types[type(v)]) for v, n in zip(values, names, strict=True)], names)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with other rows."""
    spark = vectors.sparkSession
    data = staged(quantised(vectors, scale).withColumn("is_query", is_query), "vectors")
    facts = data.agg(F.max("q"), F.max(F.size("v")), F.count("*")).first()
    out_schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    if not facts[2]:
        return spark.createDataFrame([], out_schema)
    top, dim = float(facts[0]), int(facts[1])
    exact, slack = top < 2**53, SLACK * (1.0 + 2 * np.sqrt(top))
    sample = data.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v", "q").toArrow()
    chosen = choose_pivots(_matrix(sample.column("v"), sample.column("q").to_numpy(), dim, top), pivots)
    shared = spark.sparkContext.broadcast(chosen)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("v"), b.column("q").to_numpy(), dim, top), shared.value)
            p = d.argmin(1)
            yield pa.record_batch([b.column("id"), b.column("v"), b.column("q"), b.column("is_query"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], ["id", "v", "q", "is_query", "pivot", "dist"])

    index = data.mapInArrow(keyed, "id long, v array<double>, q double, is_query boolean, pivot int, dist double")
    index = staged(index, "index")

    def block(t: pa.Table) -> pa.RecordBatch:
        d = t.column("dist").to_numpy()
        x = _matrix(t.column("v"), t.column("q").to_numpy(), dim, top)[:, :dim]
        ids = t.column("id").to_numpy().astype("<i8")
        return _one([0, int(t.column("pivot")[0].as_py()), float(d[0]), float(d[-1]), ids.tobytes(), d.tobytes(), x.astype(kind).tobytes()], ["block", "pivot", "low", "high", "ids", "dist", "vecs"])

    def group(t: pa.Table) -> pa.RecordBatch:
        x = _matrix(t.column("v"), t.column("q").to_numpy(), dim, top)
        return _one([0, int(t.column("pivot")[0].as_py()), t.column("id").to_numpy().astype("<i8").tobytes(), x.astype("<f8").tobytes()], ["grp", "pivot", "ids", "vecs"])

    # whole numbers of up to 24 bits fit float32
    kind = "<f4" if top < 2**46 else "<f8"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["pivot", "dist", "id"]
    blocks = staged(_packed(index.repartitionByRange(parts, *order).sortWithinPartitions(*order), BLOCK, _BLOCK, block).withColumn("block", F.monotonically_increasing_id()), "blocks")
    ask = index.where("is_query").dropDuplicates(["id"])
    groups = staged(_packed(ask.repartitionByRange(parts, *order).sortWithinPartitions(*order), GROUP, _GROUP, group).withColumn("grp", F.monotonically_increasing_id()), "groups")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's row comes before those of the groups that visit it."""
        for b in batches:
            for r in b.to_pylist():
                if r["side"] == 0:
                    pivot, ids, dist = r["pivot"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["dist"], "<f8")
                    vecs = np.frombuffer(r["vecs"], kind).reshape(len(ids), dim).astype(float)
                    begin = np.arange(0, len(ids), ANNULUS)
                    low, high = dist[begin], dist[np.minimum(begin + ANNULUS, len(ids)) - 1]
                    continue
                qid, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vecs"], "<f8").reshape(-1, dim + 1)
                to_pivot = _distances(x, shared.value[pivot : pivot + 1])[:, 0]
                # the bound of each query: the distance that its k-th best has at most
                bound = np.frombuffer(r["bound"], "<f8").copy() if r["bound"] is not None else np.full(len(qid), np.inf)
                best = [[] for _ in qid]
                gap = np.maximum(0.0, np.maximum(to_pivot[:, None] - high[None, :], low[None, :] - to_pivot[:, None]))
                for a in np.argsort(gap.min(0), kind="stable"):
                    rows = np.flatnonzero(gap[:, a] <= bound + slack)
                    if not rows.size:
                        continue
                    s = slice(begin[a], begin[a] + ANNULUS)
                    score = _products(x[rows, :dim], vecs[s], exact)
                    for i, row in zip(rows.tolist(), score, strict=True):
                        pick = np.flatnonzero(ids[s] != qid[i])
                        if pick.size > 4 * k:
                            value = row[pick].astype(float)
                            pick = pick[value >= np.partition(value, -k)[-k]]
                        got = best[i] + [(-int(row[j]), int(ids[s][j])) for j in pick]
                        got.sort()
                        best[i] = got[:k]
                        if len(best[i]) == k:
                            bound[i] = min(bound[i], np.sqrt(max(0.0, 2.0 * (top + best[i][-1][0]))))
                out = [(int(q), v, -s) for q, g in zip(qid, best, strict=True) for s, v in g]
                q_, v_, s_ = zip(*out, strict=True) if out else ((), (), ())
                yield pa.record_batch([pa.array([r["grp"]] * len(out), pa.int64()), pa.array(q_, pa.int64()), pa.array(v_, pa.int64()), pa.array(s_, pa.int64())], ["grp", "query_id", "vec_id", "score"])

    found_shape = "grp long, query_id long, vec_id long, score long"
    # a block is copied for every so many groups, so that no task answers them all
    copies = max(1, -(-groups.count() // 1024))
    copy = F.pmod("grp", F.lit(copies)).cast("int").alias("copy")
    nothing = F.lit(None).cast("binary")

    def visits(pairs: DataFrame) -> DataFrame:
        """Search of (grp, block, bound) rows: every block travels once, and with it the groups that visit it."""
        asked = pairs.join(groups, "grp").select("block", copy, F.lit(1).alias("side"), "grp", F.lit(None).cast("int").alias("pivot"), "ids", nothing.alias("dist"), "vecs", "bound")
        used = blocks.join(pairs.select("block").distinct(), "block", "left_semi").withColumn("copy", F.explode(F.array(*map(F.lit, range(copies)))))
        sent = used.select("block", "copy", F.lit(0).alias("side"), F.lit(None).cast("long").alias("grp"), "pivot", "ids", "dist", "vecs", nothing.alias("bound"))
        return sent.union(asked).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "side").mapInArrow(search, found_shape)

    # first the cell of the group: the blocks of its pivot whose annuli hold the group's distances
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group, per pivot: the distances that vectors within its bounds can have."""
        for b in batches:
            for r in b.to_pylist():
                near = _distances(np.frombuffer(r["vecs"], "<f8").reshape(-1, dim + 1), shared.value)
                bound = np.frombuffer(r["bound"], "<f8")[:, None] if r.get("bound") else 0.0
                n = near.shape[1]
                yield pa.record_batch([pa.array([r["grp"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array((near - bound).min(0) - slack), pa.array((near + bound).max(0) + slack)], ["grp", "pivot", "lo", "hi"])

    range_shape = "grp long, pivot int, lo double, hi double"
    where = blocks.select("block", "pivot", "low", "high")
    meets = lambda r: r.join(where, "pivot").where("low <= hi and high >= lo").select("grp", "block")
    own = groups.select("grp", "pivot").join(groups.select("grp", "vecs").mapInArrow(ranges, range_shape), ["grp", "pivot"])
    first_pairs = staged(meets(own), "pairs")
    first = staged(visits(first_pairs.withColumn("bound", nothing)), "found")
    # the k-th best so far bounds every query; one number per query, packed per group
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select("grp", "query_id", F.sqrt(F.greatest(F.lit(0.0), 2 * (F.lit(top) - F.col("score")))).alias("d"))

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        by = dict(zip(right.column("query_id").to_pylist(), right.column("d").to_pylist(), strict=True))
        each = [np.array([by.get(int(q), np.inf) for q in np.frombuffer(ids, "<i8")], "<f8").tobytes() for ids in left.column("ids").to_pylist()]
        return left.drop_columns(["ids"]).append_column("bound", pa.array(each, pa.binary()))

    bounded = staged(groups.select("grp", "ids", "vecs").groupBy("grp").cogroup(kth.groupBy("grp")).applyInArrow(bounds, "grp long, vecs binary, bound binary"), "bounds")
    rest = meets(bounded.mapInArrow(ranges, range_shape)).join(first_pairs, ["grp", "block"], "left_anti").join(bounded.select("grp", "bound"), "grp")
    everything = first.union(visits(rest))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return everything.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % QUERY_EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
