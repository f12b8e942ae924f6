import itertools
import re

from gridloom.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string, n int"


def failed(rows):
    """The conditions that each row fails, one by one."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({k for k, v in s.items() if v})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails, out = failed(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                out[part, order, step] = [
                    len(left) - len(gone), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                left = [x for x in left if c not in x[1]]
        shapley = {c: sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == c) for c in "ABCDE"}
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*A.COUNTS, "shapley")] for r in df.collect()}


def test_against_orders_one_by_one(spark, docs, corpus):
    shouted = [(60 + k, t, lang, "b") for k, (t, lang) in enumerate([("A# " * 150, "en"), ("A# " * 150, "de"), ("", "en"), ("x y " * 80, None), ("UPPER CASE " + "word%d " * 3, "en")])]
    shouted += [(60, "A# " * 150, "en", "b"), (None, "A# " * 150, "en", "b"), (None, "", "", "b")]
    rows = [*corpus, *shouted]
    more = spark.createDataFrame([(*r, 0, True, 0.5, 1.0, 2.0, 3, 4, "x", "y") for r in shouted], docs.schema)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 64, 3)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (61, None, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in labels], LABELS)
    got = collected(A.audit(docs.unionByName(more), table))
    assert got == brute(rows, labels)


def test_many_copies(spark):
    rows = [(i, "same text " * 60, "en" if i % 3 else "de") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = collected(A.audit(df, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == brute(rows, [(0, 1, 1)])


def test_edges_and_paths(spark):
    assert A.paths(spark).count() == 600
    assert A.paths(spark).select("applied", "filter").distinct().count() == 80
    sets = spark.createDataFrame([("en", 0, 5, 1, 0)], "part string, failed int, n long, good long, toxic long")
    assert A.edges(sets).count() == 80


def test_empty(spark, empty):
    assert A.audit(empty, spark.createDataFrame([], LABELS)).collect() == []
    got = A.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""}
