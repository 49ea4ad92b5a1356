import random

import pytest

from kmerweave.llm import decontaminate as dc


def brute(docs, items):
    import re

    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for d, t in docs:
        w, hit, names = word(t), set(), set()
        for i, x in items:
            v = word(x)
            k = min(len(v), 10)
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["École", "ÉCOLE", "Big"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25, 40]))) for i in range(12)] + [(90, None), (91, ""), (92, "--- !!"), (93, "w1"), (7, text(12))]
    docs = [(i, text(rng.choice([0, 5, 30, 80]))) for i in range(20)]
    for i, (_, t) in enumerate(items):
        if t:
            docs.append((100 + i, f"{text(7)}, {t.upper() if i % 2 else t}\n{text(3)} {t}"))
            docs.append((200 + i, text(2) + " " + " ".join(t.split()[1:])))
    return docs + [(300, None), (301, ""), docs[25], (302, " ".join(docs[30][1].split() * 40))], items


@pytest.mark.parametrize("most", [dc.MAX_BROADCAST, 3])
def test_like_brute_force(spark, most):
    docs, items = cases()
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, key string, items int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(d, b, max_broadcast=most).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=repr) == brute(docs, items)


def test_empty_tables_and_clean(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(d, b.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0
    assert dc.contamination(d.limit(0), b).count() == 0
    want = {x[0] for x in brute(docs, items) if not x[2]}
    assert {r.doc_id for r in dc.clean(d, b).collect()} == want
