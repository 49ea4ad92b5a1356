"""Every language is learnt, however many there are."""

from kmerweave.llm import language


def test_more_than_64_languages(spark):
    rows = [(i * 2 + j, f"word{i} text{i} line{i}", f"l{i:02d}") for i in range(70) for j in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(d, modulus=1, fold_out=2).languages == [f"l{i:02d}" for i in range(70)]
