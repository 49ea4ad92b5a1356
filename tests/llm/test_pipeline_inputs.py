"""Stages of the pipeline on empty tables, repeated rows, nulls and columns of any name."""

import corpus_pipeline as cp
from kmerweave.llm import decontaminate, jaccard, line_dedup, quality


def tables(spark, path, rows, more=()):
    names = ["doc_id", "text", "n_chars", *more]
    docs = spark.createDataFrame([(i, t, len(t or ""), *[f"{m}{i}" for m in more]) for i, t in rows], f"doc_id long, text string, n_chars long{''.join(f', `{m}` string' for m in more)}")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, (i or 0) % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert docs.columns == names
    return spark.read.parquet(f"{path}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, [])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_clashing_names_repeated_rows_and_nulls(spark, tmp_path):
    more = ["_text", "_row", "_k1", "_gone", "_bad", "score", "label", "a.b", "component_id", "n_hit", "k1", "h", "node", "row"]
    rows = [(1, "a good text of some words that nobody else has at all"), (1, "a good text of some words that nobody else has at all"), (2, None), (3, ""), (None, "no id here but words enough to be kept by all"), (5, "x one two three four five six seven eight nine ten eleven y")]
    docs = tables(spark, tmp_path, rows, more)
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    all_rows = sorted(rows, key=repr)
    for out, want in (
        (line_dedup.dedup_lines(docs), all_rows),
        (jaccard.keep_one(docs, words=5, percent=80), all_rows),  # repeated rows have one id: both stay
        (decontaminate.clean(docs, bench), [r for r in all_rows if r[0] != 5]),
        (quality.keep_good(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), threshold=0.0), all_rows),
    ):
        assert out.columns == docs.columns
        assert key(out) == sorted(want, key=repr)
        assert all(r[m] == f"{m}{r.doc_id}" for r in out.collect() for m in more)
