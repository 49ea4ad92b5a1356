import random

import corpus_pipeline as cp

GOOD = [f"word{i}" for i in range(400)]
BAD = ["BUY!!", "NOW!!", "###free", "$$$win"]


def corpus():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(GOOD) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        if i % 4 == 0:
            rows.append((i, " ".join(rng.choice(BAD) for _ in range(40))))
            labels.append((i, 0, 0))
        else:
            rows.append((i, "\n".join(text(12) for _ in range(4))))
            labels.append((i, 1, 0))
    item = text(30)
    passage = text(60)
    base = text(200)
    words = base.split()
    words[100] = "changed"
    rows += [
        (200, base),
        (201, " ".join(words)),  # a near copy
        (202, text(20) + " " + item + " " + text(20)),  # a benchmark passage
        (203, text(30) + "\n" + passage),
        (204, text(30) + "\n" + passage + "\n" + text(30)),  # a passage of another document
        (205, rows[1][1]),  # a copy, shorter than a run that counts
        (208, base),  # a copy that is a run
        (206, None),
        (207, ""),
    ]
    return rows, labels, item, passage


def test_stages(spark, tmp_path):
    rows, labels, item, passage = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.schema == docs.schema, name
            d = cp.staged(out, "test-stage")
            seen[name] = {r.doc_id: r.text for r in d.collect()}
    quality = seen["quality classifier"]
    assert not {i for i, q, _ in labels if not q} & set(quality) and {i for i, q, _ in labels if q} | {200, 201, 202, 203, 204, 206, 207} <= set(quality)
    lines = seen["line dedup"]
    assert passage in lines[203] and passage not in lines[204] and 208 not in lines and {205, 206, 207} <= set(lines)
    assert all(lines[i] == t for i, t in rows if i in lines and i != 204)
    near = seen["n-gram Jaccard join"]
    assert set(lines) - set(near) == {201, 205}
    assert set(near) - set(seen["benchmark decontamination"]) == {202}
    packed = cp.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["benchmark decontamination"])
    whole = cp.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))
