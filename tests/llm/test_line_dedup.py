import random

from kmerweave.llm import line_dedup as ld


def brute(rows, least):
    """Every run of lines with words, of at least ``least`` words, against every earlier one."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    lines = {r: [(p, x) for p, x in enumerate(r[1].split("\n")) if x.split()] for r in docs}
    first, gone = {}, {r: set() for r in docs}
    for r in docs:
        for i in range(len(lines[r])):
            words, run = 0, []
            for p, x in lines[r][i:]:
                run.append(x)
                words += len(x.split())
                if words >= least:
                    key = tuple(run)
                    if key in first:
                        gone[r].update(range(lines[r][i][0], p + 1))
                    # the first start of this run, over all documents in order
                    first.setdefault(key, (r, i))
    return sorted(((d, t and "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d, t])) if t is not None else (d, None) for d, t in rows), key=repr)


def cases():
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    shared = [line(rng.randint(1, 8)) for _ in range(40)] + [line(12)]
    rows = []
    for d in range(60):
        ls = []
        while len(ls) < rng.randint(1, 30):
            if rng.random() < 0.4:
                s = rng.randrange(len(shared))
                ls += shared[s : s + rng.randint(1, 9)]
            else:
                ls.append(rng.choice(["", "  ", line(rng.randint(1, 15))]))
        rows.append((d, "\n".join(ls)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "\n\n"), (104, "a b\n" * 40), (105, " ".join(["x"] * 30) + "\n" + rows[5][1]), rows[7], (106, "\n".join(shared)), (107, "\n\n".join(shared))]
    return rows


def test_like_brute_force(spark):
    rows = cases()
    d = spark.createDataFrame([(a, b, 0, "s") for a, b in rows], "doc_id long, text string, n_chars long, seq string").repartition(5)
    for least in (1, 7, 10):
        got = ld._edited(d, least).select("row.doc_id", "edited").collect()
        # lines with words must agree; blank ones belong to no particular run
        bare = lambda pairs: sorted(((d, [x for x in (t or "").split("\n") if x.split()]) for d, t in pairs), key=repr)
        assert bare(map(tuple, got)) == bare(brute(rows, least))


def test_stage_keeps_columns(spark):
    rows = cases()
    d = spark.createDataFrame([(a, b, len(b or ""), "s") for a, b in rows], "doc_id long, text string, n_chars long, pos string")
    got = ld.dedup_lines(d, 10)
    assert got.schema == d.schema
    out = {r.doc_id: r for r in got.collect()}
    assert 100 not in out and {101, 102, 103} <= set(out)  # a whole copy goes, empty ones stay
    assert all(r.n_chars == len(r.text or "") for r in out.values())
    assert ld.dedup_lines(d.limit(0), 10).count() == 0


def test_clashing_names(spark):
    rows = cases()
    names = ["_text", "_cuts", "_k1", "_lines", "_n_removed", "a.b", "row", "edited", "k1", "cuts", "lines", "d", "id"]
    plain = spark.createDataFrame([(a, b) for a, b in rows], "doc_id long, text string")
    d = spark.createDataFrame([(a, *[f"{n}{a}" for n in names], b) for a, b in rows], ["doc_id", *names, "text"])
    got = ld.dedup_lines(d, 10)
    assert got.columns == d.columns
    out = got.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in out for n in names)
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(map(tuple, ld.dedup_lines(plain, 10).collect()), key=repr)


def test_plan_has_no_python(spark):
    d = spark.createDataFrame(cases(), "doc_id long, text string")
    plan = ld.dedup_lines(d, 10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def shortest_runs(rows, least):
    """The rule with blank lines: shortest runs from and up to each line, named by their lines; the first copy in order of document and place stays."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    runs = []
    for n, r in enumerate(docs):
        ls = [(p, x) for p, x in enumerate(r[1].split("\n")) if x.split()]
        upto = lambda i, j: sum(len(x.split()) for _, x in ls[i : j + 1])  # noqa: B023, E731
        ends = {(i, min((j for j in range(i, len(ls)) if upto(i, j) >= least), default=None)) for i in range(len(ls))}
        ends |= {(max((i for i in range(j + 1) if upto(i, j) >= least), default=None), j) for j in range(len(ls))}
        runs += [(n, i, ls[i][0], ls[j][0], tuple(x for _, x in ls[i : j + 1])) for i, j in ends if i is not None and j is not None]
    first, gone = {}, {}
    for n, i, p, q, name in sorted(runs, key=lambda r: r[:2]):
        if first.setdefault(name, (n, i)) != (n, i):
            gone.setdefault(docs[n], set()).update(range(p, q + 1))
    return sorted(((d, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get((d, t), ()))) for d, t in rows), key=repr)


def test_blank_lines(spark):
    rows = cases()
    big = " ".join(f"b{i}" for i in range(12))
    rows += [(200 + i, f"{big}\n\n  \n{big[::-1]}\n\nend{i}\n\n{big}") for i in range(3)]
    rows += [(300 + i, "\n\none two three\n\nfour five six\n \nseven eight nine ten\n\n\n" + f"own{i}") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (1, 7, 10):
        got = sorted(map(tuple, ld._edited(d, least).select("row.doc_id", "edited").collect()), key=repr)
        assert got == shortest_runs(rows, least)


def test_ranks_are_those_of_sorted_blocks(spark):
    rng = random.Random(5)
    rows = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))) for d in range(12)]
    lines = ld._lines(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.line: (r.a, r.b) for r in spark.createDataFrame([(x,) for x in "abc"], "line string").selectExpr("line", "xxhash64(line) a", "xxhash64(1, line) b").collect()}
    numbers = {x: 1 + sorted(ids.values()).index(v) for x, v in ids.items()}
    kept = lines.withColumn("island", lines.seq * 0).withColumn("n0", lines.id.a)
    kept = kept.replace({ids[x][0]: numbers[x] for x in "abc"}, subset=["n0"])
    got = {(r.doc_id, r.seq): (r.n0, r.n1, r.n2, r.n3) for r in ld._block_ranks(kept, 4).select("d.doc_id", "seq", "n0", "n1", "n2", "n3").collect()}
    text = {d: [numbers[x] for x in t.split("\n")] for d, t in rows}
    for j in range(4):
        blocks = {(d, s): tuple(x[s : s + 2**j]) for d, x in text.items() for s in range(len(x) - 2**j + 1)}
        often = sorted({b for b in blocks.values() if list(blocks.values()).count(b) > 1 or j == 0})
        assert {k: v[j] for k, v in got.items()} == {k: 1 + often.index(blocks[k]) if blocks.get(k) in often else None for k in got}
