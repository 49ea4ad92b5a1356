"""Removal of repeated line runs, with DataFrame functions alone.

The lines of every document are a sequence of line ids; together they are the
text of a generalised suffix array.  Prefix doubling ranks the blocks of 1, 2, 4, ...
lines from every line on: the rank of a block of 2**(j+1) lines is the dense number, in
sorted order, of the pair of its halves' ranks.  Every round sorts the distinct pairs by
range partitions and joins their numbers back.  A block that occurs once is a unique
suffix at its depth and leaves the rounds, so each round is smaller than the one before.

Suffixes of one rank at depth 2**j are an interval of the suffix array whose longest
common prefix has that many lines, and an interval of any other depth is that of two
overlapping blocks.  A maximal repeated run of ``min_words`` words or more is the union
of the shortest such runs that start at its lines and the shortest that end at its
lines, and each of these lies in the same interval as its counterparts.  So the
intervals of these two runs per line are looked up; in each the first run in
(doc_id, position) order stays and the lines of the later ones are deleted.  A shortest
run has at most ``min_words`` lines, so the number of rounds doesn't grow with the input.

Lines that occur once in the corpus end all runs and leave the data first.  A line's
identity is 128 bits of two hashes with different seeds; all further names are exact.

Defined cases: a null text stays null; blank lines have no words, take no part in
comparison and go with a shortest run that they lie in; runs may overlap their own
copies; repeated rows (same id and text) are one document, and each gets its
result; an empty table gives an empty table; extra columns are kept by
``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import drop, named, staged, table

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with words: document (id and text hashes), seq among such lines, pos among all, id, words."""
    marked = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")).alias("id"), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).alias("words"))),
        lambda s: s.words > 0,
    )
    # repeated rows are one document: their lines are equal in all columns
    return docs.where("text is not null").select(_document().alias("d"), F.posexplode(marked).alias("seq", "l")).select("d", "seq", "l.*")


def _document() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))


def _numbered(df: DataFrame, *key: str) -> DataFrame:
    """Dense numbers from 1 in the order of ``key``: range partitions, their counts, and a number within each."""
    ranged = staged(df.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*key))).drop("part", "before")


def _block_ranks(kept: DataFrame, levels: int) -> DataFrame:
    """The lines with n0, n1, ...: the rank of the block of 2**j lines from each on among all such blocks of the corpus; null where the island ends before, or the block occurs once."""
    now = staged(kept.select("d", "island", "seq", F.col("n0").alias("rank")), "ranks-0")
    out = kept
    for j in range(levels - 1):
        ahead = now.select("d", "island", (F.col("seq") - 2**j).alias("seq"), F.col("rank").alias("second"))
        pairs = staged(now.withColumnRenamed("rank", "first").join(ahead, ["d", "island", "seq"]), "pairs")
        # how often a pair comes is summed up before the shuffle, so a frequent one is few rows
        repeated = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1").select("first", "second")
        numbers = staged(_numbered(repeated, "first", "second"), "numbers")
        now = staged(pairs.join(numbers, ["first", "second"]).select("d", "island", "seq", "rank"), f"ranks-{j + 1}")
        out = out.join(now.withColumnRenamed("rank", f"n{j + 1}"), ["d", "island", "seq"], "left")
        drop(pairs)
        drop(numbers)
    return out


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of min_words words from each line on and up to each line: d, first and last line, name."""
    # both sides of the join are read from tables, so Spark can split a line that is very frequent
    repeated = staged(_numbered(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "id"), "repeated")
    kept = lines.join(repeated, "id").withColumnRenamed("rank", "n0").drop("id")
    by_doc = Window.partitionBy("d").orderBy("seq")
    kept = staged(kept.withColumn("island", F.col("seq") - F.row_number().over(by_doc)), "kept")
    own = Window.partitionBy("d", "island").orderBy("seq")
    whole = Window.partitionBy("d", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = range(max(1, min_words).bit_length())  # the last is that of the longest block in a run of min_words lines
    kept = _block_ranks(kept, len(levels))
    # blocks by their last line; words are counted up to min_words a line, which changes no shortest run
    kept = kept.select("d", "island", "seq", "pos", F.least("words", F.lit(min_words)).alias("words"), F.array(*(F.col(f"n{j}") for j in levels)).alias("from_here"), F.array(*(F.lag(f"n{j}", 2**j - 1).over(own) for j in levels)).alias("to_here"))
    kept = kept.withColumn("upto", F.sum("words").over(own).cast("long")).withColumn("before", F.col("upto") - F.col("words"))
    here = lambda names: F.struct("seq", "pos", F.col(names).alias("names"))
    kept = kept.withColumns({"a": here("from_here"), "z": here("to_here")})
    kept = kept.withColumns({"next_a": F.lead("a").over(own), "last_z": F.lag("z").over(own), "end_z": F.last("z").over(whole), "end_words": F.max("upto").over(whole), "first_a": F.first("a").over(whole)})
    # the line before the first one that starts min_words words on or later
    forward = F.first("last_z").over(Window.partitionBy("d", "island").orderBy("before").rangeBetween(min_words, 2 * min_words))
    backward = F.last("next_a").over(Window.partitionBy("d", "island").orderBy("upto").rangeBetween(-2 * min_words, -min_words))
    kept = kept.withColumns({
        "to": F.coalesce(forward, F.when(F.col("end_words") - F.col("before") >= min_words, F.col("end_z"))),
        "from": F.coalesce(backward, F.when(F.col("upto") >= min_words, F.col("first_a"))),
    })
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("to").alias("z")), F.struct(F.col("from").alias("a"), F.col("z")))).alias("run")
    runs = kept.select("d", ends).where("run.a is not null and run.z is not null").select("d", "run.*")
    length = F.col("z.seq") - F.col("a.seq") + 1
    depth = F.floor(F.log2(length + F.lit(0.5))).cast("int") + 1
    name = F.struct(length.alias("length"), F.element_at("a.names", depth).alias("head"), F.element_at("z.names", depth).alias("tail"))
    # a run that holds a block of one occurrence has no copy
    named = runs.select("d", F.col("a.seq").alias("seq"), F.col("a.pos").alias("first"), F.col("z.pos").alias("last"), name.alias("name"))
    return named.where("name.head is not null and name.tail is not null")


def removed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The deleted maximal runs: d (document), first and last line, disjoint and in order."""
    # the same rows are read for the count and for the join
    runs = staged(_runs(staged(_lines(docs), "lines").distinct(), min_words), "runs")
    at = F.struct("d", "seq")
    firsts = staged(runs.groupBy("name").agg(F.min(at).alias("kept"), F.max(at).alias("other")).where("kept < other").select("name", "kept"), "firsts")
    later = runs.join(firsts, "name").where(at > F.col("kept")).select("d", "first", "last").distinct()
    own = Window.partitionBy("d").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = later.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(own))
    return parts.groupBy("d", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("d", "first", "last")


def _edited(docs: DataFrame, min_words: int) -> DataFrame:
    """``row`` (the document as it is), ``edited`` (its new text), and the numbers of its lines and of removed ones."""
    cuts = removed_runs(docs, min_words).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts")).select(F.col("d.k1").alias("k1"), F.col("d.k2").alias("k2"), "cuts")
    # the row is one struct, so no name of its columns meets one of these
    marked = docs.select(F.struct(*named(docs)).alias("row"), F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    lines = F.split("text", "\n")
    start = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("cuts", i)["last"] + 1)
    stop = lambda i: F.coalesce(F.try_element_at("cuts", i + 1)["first"], F.size("lines"))
    gaps = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.slice(F.col("lines"), start(i) + 1, stop(i) - start(i)))
    gone = F.aggregate("cuts", F.lit(0), lambda n, c: n + c.last - c.first + 1)
    return marked.join(cuts, ["k1", "k2"], "left").withColumn("lines", lines).select(
        "row",
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("edited"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies removed; those that lose their last words go, and n_chars follows the text.

    All columns stay, whatever their names.
    """
    edited = _edited(docs, min_words).where("n_removed = 0 or edited rlike '\\\\S'")
    cut = F.col("n_removed") > 0
    new = {"text": F.col("edited"), "n_chars": F.when(cut, F.length("edited")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return edited.select(*((new[f.name] if f.name in new else F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def query(spark, sf_dir: str) -> DataFrame:
    edited = _edited(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)
    return edited.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("edited").alias("text"))


SQL = r"""
WITH l AS (
  SELECT doc_id, p, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS s, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto
  FROM (SELECT doc_id, p, ls[p] AS line, len(list_filter(regexp_split_to_array(ls[p], '\s+'), lambda x: x <> '')) AS w
        FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
  WHERE w > 0),
reps AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1),
c AS (SELECT * FROM l SEMI JOIN reps USING (line)),
pairs AS (SELECT a.doc_id, a.s AS i, b.s AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + 50 AND b.upto - a.upto + a.w >= 50),
runs AS (SELECT doc_id, i, min(j) AS j FROM pairs GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM pairs GROUP BY doc_id, j),
named AS (
  SELECT r.doc_id, r.i, r.j, min(l.p) AS p, max(l.p) AS q, md5(string_agg(l.line, chr(10) ORDER BY l.s)) AS name
  FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.s BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
later AS (SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, q)) AS p FROM later),
kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.p) AS text
  FROM (SELECT doc_id, p, ls[p] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) x
  ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
