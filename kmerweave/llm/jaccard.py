"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct word n-grams.  Two documents
link when ``100 * intersection >= percent * union``.

1. Fragments of the n-gram order: every chunk of documents sends each fragment its
   n-grams (one entry per chunk for an n-gram that the chunk holds twice, so
   frequent n-grams don't pile up).  A fragment sees all occurrences of its
   n-grams and counts, per document, those that occur nowhere else.  A document
   whose other n-grams number less than the overlap any link needs has no link.
2. The remaining documents are collapsed to distinct sets, and step 1 is repeated.
3. The n-grams of what remains get the global order (frequency, hash).  By the
   prefix bound, linked sets share one of their first n-grams in that order, with
   enough n-grams behind it in both; so postings of prefixes give candidate pairs: first against one leader per
   posting list, then all pairs of sets that those links don't show as connected.
   Groups of copies are so joined by stars, while no link between different
   components is missed.
4. Candidates are verified vertically: the order is cut into fragments by
   frequency, each fragment counts the partial overlap of a pair, and the sums per
   pair decide.
5. Connected components of the links by alternating large and small stars.

Defined cases: a document with fewer words than n is one n-gram; a null or
word-free one has an empty set and no link; equal sets are linked; repeated rows
give one row each; the component of a document is the smallest non-null doc_id
reachable; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import drop, named, staged, table

WORDS = 4
PERCENT = 85
#: Rows of a chunk at most, and bytes that keep an n-gram apart within its fragment (48 bits with the fragment's own).
CHUNK_ROWS = 50_000
KEY_BYTES = 5
#: Words (of 64 bits) of the filter that says which documents are read again.
FILTER_WORDS = 1 << 20
#: N-grams of a fragment; their number, not the cluster's size, gives the number of fragments.
FRAGMENT = 1_000_000
#: Leaders per posting list in each round; None: all pairs left.
LEADERS = (1, None)
#: Parts that the postings of one n-gram are ranked in before the rank of all.
SALT = 64
_U = np.uint64
_TABLE = _text.whitespace_table()


def needed(n, percent: int):
    """Least intersection of a set of n elements with any set that it links to."""
    return (percent * n + 99) // 100


# ---------------------------------------------------------------- sets of documents


def shingles(words: _text.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams of every document, sorted."""
    h, total = words.hashes(), words.starts.size
    left = np.repeat(words.first + words.count, words.count) - np.arange(total)
    doc = words.doc
    at = np.flatnonzero(left[: max(0, total - n + 1)] >= n)
    d, s = [doc[at]], [_text.window_hashes(h, n)[at]]
    for k in range(1, n):
        short = np.flatnonzero(words.count == k)
        if short.size:
            d.append(short)
            s.append(_text.window_hashes(h, k)[words.first[short]])
    d, s = np.concatenate(d), np.concatenate(s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(d.size, bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]


def _of_texts(n: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]):
        for b in _text.chunks(batches):
            for at in range(0, b.num_rows, CHUNK_ROWS):
                c = b.slice(at, CHUNK_ROWS)
                d, s = shingles(_text.split_words(c.column("text"), _TABLE), n)
                yield c, d, s

    return sets


def _of_arrays(batches: Iterator[pa.RecordBatch]):
    """Chunks of set rows (column ``tokens``: hashes in ascending order)."""
    for b in batches:
        at = 0
        sizes = np.array(b.column("n").to_pylist(), np.int64)
        while at < b.num_rows:
            to = min(b.num_rows, max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 400_000))), at + CHUNK_ROWS)
            c = b.slice(at, to - at)
            yield c, np.repeat(np.arange(c.num_rows), sizes[at:to]), c.column("tokens").flatten().to_numpy().view(_U)
            at = to


# ---------------------------------------------------------------- step 1: n-grams that occur once


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def candidates(rows: DataFrame, sets: Callable, keys: list[str], percent: int, ngrams: int) -> DataFrame:
    """keys, n and whether the row's set can link to any other set of the table; ``ngrams``: about how many it has."""
    # a task holds a fragment at a time, so its size is fixed
    fragments = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ngrams // FRAGMENT))
    types = {k: rows.schema[k].dataType.simpleString() for k in keys}
    shape = "fragment int, chunk long, h binary, owner binary, count binary, " + ", ".join(f"{k} array<{types[k]}>" for k in keys) + ", n array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b, doc, h in sets(batches):
            chunk += 1
            size = np.bincount(doc, minlength=b.num_rows)
            # n-grams that the chunk holds more than once: one entry without an owner
            order = np.argsort(h, kind="stable")
            hs, ds = h[order], doc[order]
            new = np.ones(hs.size, bool)
            new[1:] = hs[1:] != hs[:-1]
            own = new.copy()
            own[:-1] &= new[1:]
            hs, ds = hs[new], np.where(own[new], ds[new], b.num_rows)
            part = ((hs >> _U(40)) * _U(fragments) >> _U(24)).astype(np.int32)  # ranges of the hash order
            order = np.lexsort((ds, part))
            hs, ds, part = hs[order], ds[order], part[order]
            begin = np.append(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), part.size) if part.size else np.zeros(1, np.int64)
            out = {name: [] for name in ("fragment", "chunk", "h", "owner", "count")}
            for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                owner, count = np.unique(ds[s:e], return_counts=True)
                for name, value in zip(out, (int(part[s]), chunk, _pack(hs[s:e]), owner.astype("<u2").tobytes(), count.astype("<u4").tobytes()), strict=True):
                    out[name].append(value)
            m = len(out["chunk"])
            empty = {k: pa.nulls(m, pa.list_(b.schema.field(k).type)) for k in keys}
            cols = [pa.array(out["fragment"], pa.int32()), pa.array(out["chunk"], pa.int64()), *(pa.array(out[x], pa.binary()) for x in ("h", "owner", "count")), *empty.values(), pa.nulls(m, pa.list_(pa.int64()))]
            names = ["fragment", "chunk", "h", "owner", "count", *keys, "n"]
            yield pa.record_batch(cols, names)
            # the chunk's own row: its keys and set sizes
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.record_batch([pa.array([chunk % fragments], pa.int32()), pa.array([chunk], pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *(one(b.column(k)) for k in keys), one(pa.array(size.astype(np.int64)))], names)

    def alone(t: pa.Table) -> pa.Table:
        """Per chunk and owner, the n-grams of a fragment that no other entry has."""
        own = t.column("h").is_valid()
        meta, t = t.filter(pa.compute.invert(own)), t.filter(own)
        parts = [_unpack(x) for x in t.column("h").to_pylist()]
        if parts:
            h = np.concatenate(parts)
            order = np.argsort(h, kind="stable")
            h = h[order]
            again = np.zeros(h.size + 1, bool)
            again[1:-1] = h[1:] == h[:-1]
            single, to, counts = np.empty(h.size, bool), 0, []
            single[order] = ~(again[1:] | again[:-1])
            del h, order, again
            for p, c in zip(parts, t.column("count").to_pylist(), strict=True):
                c = np.frombuffer(c, "<u4")
                starts = to + np.append(0, np.cumsum(c)[:-1]).astype(np.int64)
                counts.append(np.add.reduceat(single[: to + p.size].astype(np.uint32), starts).astype("<u4").tobytes())
                to += p.size
            t = t.set_column(t.schema.get_field_index("count"), "count", pa.array(counts, pa.binary()))
        return pa.concat_tables([meta, t.cast(meta.schema)]).drop_columns(["fragment", "h"])

    def added(t: pa.Table) -> pa.Table:
        own = t.column("owner").is_valid()
        meta, t = t.filter(pa.compute.invert(own)).combine_chunks(), t.filter(own)
        n = np.array(meta.column("n")[0].as_py(), np.int64)
        once = np.zeros(n.size + 1, np.int64)
        for o, c in zip(t.column("owner").to_pylist(), t.column("count").to_pylist(), strict=True):
            o = np.frombuffer(o, "<u2").astype(np.int64)
            once[o] += np.frombuffer(c, "<u4")
        may = (n > 0) & (n - once[:-1] >= needed(n, percent))
        return pa.table([*(meta.column(k).combine_chunks().flatten() for k in keys), pa.array(n), pa.array(may)], [*keys, "n", "may"])

    packed = rows.mapInArrow(cut, shape)
    counted = packed.groupBy("fragment").applyInArrow(alone, shape.replace("fragment int, ", "").replace("h binary, ", ""))
    return counted.groupBy("chunk").applyInArrow(added, ", ".join(f"{k} {types[k]}" for k in keys) + ", n long, may boolean")


# ---------------------------------------------------------------- step 2: sets of the documents that may link


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key's hash; FILTER_WORDS rows at most come to the driver."""
    bit = F.pmod("k1", F.lit(FILTER_WORDS * 64))
    words = keys.groupBy(F.shiftright(bit, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(k1, 64) as int))")).alias("bits"))
    found, out = words.toArrow(), np.zeros(FILTER_WORDS, np.int64)
    out[found.column("i").to_numpy()] = found.column("bits").to_numpy()
    return out.view(_U)


def _sets(keyed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """doc_id, k1, k2, node (hash of the set), n, tokens of the wanted documents (and few others that the filter passes)."""
    bits = keyed.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bits.value
        for b in _text.chunks(batches):
            k = b.column("k1").to_numpy().astype(np.int64)
            at = np.mod(k, FILTER_WORDS * 64).astype(_U)
            c = b.filter(pa.array((f[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)) == 1))
            if not c.num_rows:
                continue
            d, s = shingles(_text.split_words(c.column("text"), _TABLE), n)
            size = np.bincount(d, minlength=c.num_rows)
            edge = np.append(0, np.cumsum(size))
            total = np.append(_U(0), np.cumsum(_text.mix(s), dtype=_U))
            node = _text.mix((total[edge[1:]] - total[edge[:-1]]) ^ size.astype(_U)).view(np.int64)
            yield pa.record_batch([c.column("doc_id"), c.column("k1"), c.column("k2"), pa.array(node), pa.array(size), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(s.view(np.int64)))], ["doc_id", "k1", "k2", "node", "n", "tokens"])

    return keyed.mapInArrow(run, f"doc_id {kind}, k1 long, k2 int, node long, n long, tokens array<long>").where("n > 0")


# ---------------------------------------------------------------- steps 3 to 5


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that always shuffles: loops and rounds leave no broadcasts in the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node) of the nodes of an edge table (a, b)."""
    e, before = edges.where("a <> b").select("a", "b").distinct(), None
    staged_before = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _joined(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        # the table's size and a sum of its hashes come with the write: no job of their own
        seen = Observation()
        e = staged(small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")), "edges")
        if staged_before is not None:
            drop(staged_before)
        staged_before = e
        now = tuple(seen.get.values())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _labels(links: DataFrame) -> DataFrame:
    """node, root: the smallest node within two links.  Equal roots prove that two nodes are connected, different ones nothing."""
    both = links.union(links.select("b", "a"))
    one = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    two = _joined(both, one.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m2"))
    return _joined(two, one, "a").select(F.col("a").alias("node"), F.least("m", "m2").alias("root"))


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, size of the intersection: partial overlaps per fragment, summed per pair."""
    side = lambda x: segments.select(F.col("node").alias(x), "fragment", F.col("tokens").alias(f"t_{x}"))
    partial = _joined(_joined(pairs, side("a"), "a"), side("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _leaders(posts: DataFrame, most: int) -> DataFrame:
    """The ``most`` postings of each n-gram whose sets have most shared n-grams: first of parts of a list, then of the list."""
    first = [F.desc("shared"), F.xxhash64("node"), F.col("node")]
    part = Window.partitionBy("h", F.pmod(F.xxhash64("node"), F.lit(SALT))).orderBy(*first)
    some = posts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(*first))).where(F.col("r") <= most)


def _links(reps: DataFrame, percent: int) -> DataFrame:
    """Components (node, root) of the distinct sets (node, n, tokens)."""
    tokens = reps.select("node", "n", F.explode("tokens").alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    by_order = Window.partitionBy("node").orderBy("df", "h")
    whole = Window.partitionBy("node")
    ordered = _joined(tokens, shared, "h").withColumns({"place": F.row_number().over(by_order), "shared": F.count("*").over(whole)})
    # n-grams of one set alone come first in the order and match nothing
    last = F.col("n") - needed_column(F.col("n"), percent) + 1 - (F.col("n") - F.col("shared"))
    ordered = staged(ordered.select("node", "n", "h", "df", "shared", (F.col("shared") - F.col("place") + 1).alias("rest"), (F.col("place") <= last).alias("prefix")), "ordered")
    segments = staged(ordered.groupBy("node", F.floor(F.log2("df")).cast("int").alias("fragment")).agg(F.collect_list("h").alias("tokens")), "segments")
    # of a posting list with one entry nothing comes
    posts = ordered.where("prefix").select("h", "node", "n", "shared", "rest")
    links = tested = labels = None
    for most in LEADERS:
        p = posts.withColumn("c", F.col("node")) if labels is None else _joined(posts, labels, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
        sizes = p.groupBy("h", "c").agg(F.count("*").alias("m"))
        # lists with one label are done; of others all but the largest label's may lead, sets with
        # the most shared n-grams first: these link to most others of a group of copies
        lists = sizes.groupBy("h").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1").select("h", F.col("top.c").alias("top"))
        p = staged(_joined(p, lists, "h"), "posts")
        lead = p.where("c <> top")
        if most:
            lead = _leaders(lead, most)
        lead = lead.select("h", F.col("node").alias("l"), F.col("n").alias("l_n"), F.col("rest").alias("l_rest"), F.col("c").alias("l_c"))
        # from its first common n-gram on, a pair shares no more than the n-grams that either set has left;
        # a linked pair passes at that n-gram, whatever the later ones say
        reachable = (100 + percent) * F.least("rest", "l_rest") >= percent * (F.col("n") + F.col("l_n"))
        fits = (F.col("c") != F.col("l_c")) & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")) & reachable
        one_way = [F.least("l", "node").alias("a"), F.greatest("l", "node").alias("b"), F.when(F.col("l") < F.col("node"), F.col("l_n")).otherwise(F.col("n")).alias("n_a"), F.when(F.col("l") < F.col("node"), F.col("n")).otherwise(F.col("l_n")).alias("n_b")]
        found = _joined(lead, p, "h").where(fits).select(*one_way).distinct()
        if tested is not None:
            found = _joined(found, tested, ["a", "b"], "left_anti")
        found = staged(found, "pairs")
        both = _overlaps(found, segments)
        links_now = both.where(F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
        links = staged(links_now if links is None else links.union(links_now), "links")
        tested = found.select("a", "b") if tested is None else tested.union(found.select("a", "b"))
        if most != LEADERS[-1]:
            labels = staged(_labels(links), "labels")
        drop(p)
    return components(links)


def needed_column(n, percent: int):
    return F.ceil(F.lit(percent) * n / 100)


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), F.col("text").cast("binary").alias("text"))
    # a word has six bytes or so with its separator; only the number of fragments comes from this
    ngrams = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    stats = staged(candidates(keyed, _of_texts(words), ["doc_id", "k1", "k2"], percent, ngrams), "stats")
    sets = staged(_sets(keyed, stats.where("may").select("k1"), words), "sets")
    one = sets.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", "k.*")
    reps = staged(sets.join(one, ["node", "k1", "k2"]).dropDuplicates(["node"]).select("node", "n", "tokens"), "reps")
    may = candidates(reps, _of_arrays, ["node"], percent, reps.agg(F.sum("n")).first()[0] or 0).where("may").select("node")
    comps = _links(staged(_joined(reps, may, "node"), "left"), percent)
    member = _joined(sets.select("doc_id", "k1", "k2", "node").distinct(), comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the smallest id of a component is a sum of parts, so a huge component is no task's whole work
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = _joined(member, least, "root").groupBy("k1", "k2").agg(F.min("component_id").alias("component_id"))
    return stats.join(found, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that link, however far, to one of smaller id, with all their columns.

    Rows go by doc_id: rows that share one go together.  A null doc_id stays.
    """
    gone = similar(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*named(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS i FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY 1, 2) x
  JOIN n ON n.doc_id = x.a JOIN n m ON m.doc_id = x.b WHERE 100 * x.i >= 85 * (n.n + m.n - x.i)),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.r, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
