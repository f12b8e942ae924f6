import os
import random
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import near_dedup, runtime


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if t else []
        sets.setdefault(i, set()).add(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}, sets


def test_against_all_pairs(docs, corpus):
    want, sets = brute(corpus)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_dense_group_of_near_copies(spark):
    """Copies whose edits coincide: links join through other copies, not through one centre."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            del t[rng.choice(range(0, 60, 6))]
        rows.append((i, " ".join(t)))
    want, _ = brute(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 1 < len(set(want.values())) < 120


def test_number_of_stored_tables(spark):
    """What a run costs at any size: every stored table is a few rounds of tasks, one for each shuffle partition."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        t = [f"w{k}" for k in range(150)]
        for _ in range(rng.randrange(0, 7)):
            del t[rng.choice(range(0, 60, 6))]
        rows.append((i, " ".join(t)))
    want, _ = brute(rows)
    with runtime.noted() as paths:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    names = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in paths]
    assert "fronts" in names  # both phases ran
    assert len(names) <= 32, names


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_several_texts(spark, seed):
    """The texts of one id are one document, whatever the smallest id of each text's copies."""
    rng = random.Random(seed)
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(8)]
    near = [t.replace("w0 ", "x ") for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[0]), (9, texts[1])] if seed == 0 else [(rng.randrange(14), rng.choice(texts + near)) for _ in range(26)]
    rows += [(20, "short"), (20, None), (20, texts[7]), (None, texts[0])]
    want, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).where("doc_id is not null").collect()
    for r in got:
        assert (r["component_id"], r["kept"]) == ((want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]) if r["n_shingles"] else (r["doc_id"], True)), r
    if seed == 0:
        assert {r["component_id"] for r in got if r["doc_id"] in (3, 5, 9)} == {3}
        assert sorted(r["doc_id"] for r in near_dedup.keep_first(df).where("doc_id < 10").collect()) == [3]


def test_kept_rows(docs, corpus):
    want, _ = brute(corpus)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == sorted([i for i, *_ in corpus if i is None or want[i] == i], key=lambda i: (i is None, i))


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in near_dedup.components(df).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert got == want


def test_components_of_stars_take_one_step(spark):
    edges = [(0, k) for k in range(1, 9)] + [(k, 20) for k in range(21, 24)] + [(0, 3), (3, 0), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    with runtime.noted() as paths:
        got = {r["node"]: r["component"] for r in near_dedup.components(df).collect()}
    assert got == {k: 0 for k in range(9)} | {k: 20 for k in range(20, 24)}
    assert len(paths) == 1


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_edges(spark, seed):
    """Any direction, repeats and loops; one row for each node, and nothing left behind but the result."""
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges += [rng.choice(edges)[::-1] for _ in range(10)] + [(70, 70)]
    root = {k: k for e in edges for k in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    with runtime.noted() as paths:
        out = near_dedup.components(spark.createDataFrame(edges, "u long, v long"))
    got = [(r["node"], r["component"]) for r in out.collect()]
    ends = {k for a, b in edges if a != b for k in (a, b)}
    assert sorted(got) == sorted((k, r) for k, r in root.items() if k in ends)
    left = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert {f.rsplit("/", 2)[-2] for f in out.inputFiles()} == {p.rsplit("/", 1)[-1] for p in left}


def test_shingles_match_a_loop():
    rng = np.random.default_rng(0)
    rows = np.array([0, 0, 3, 9, 13, 13, 18, 19])
    h = rng.integers(0, 2**63, 19).astype(np.uint64)
    got, at = near_dedup.shingles(h, rows)
    seen = defaultdict(list)
    for i in range(len(rows) - 1):
        n = rows[i + 1] - rows[i]
        assert at[i + 1] - at[i] == (0 if n == 0 else max(1, n - 4))
        seen[i] = got[at[i] : at[i + 1]]
    alone, _ = near_dedup.shingles(h[3:9], np.array([0, 6]))
    assert (alone == seen[2]).all()
    alone, _ = near_dedup.shingles(h[9:13], np.array([0, 4]))
    assert (alone == seen[3]).all()
