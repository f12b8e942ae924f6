import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, quality_rules, url_rules


def base_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


EXTRA = ["a a a a a a", "a b c a b c d", "a b c d e f", "x y", "l1\nl1\n \nl2\nl1", "#*# $x% |<>&| é", "a b a b a b a b", " ".join(["r s t u"] * 40)]


def test_base_statistics(spark, docs, corpus):
    rows = [(100 + i, t) for i, t in enumerate(EXTRA)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) as lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(df, labels).collect()
    want = {}
    for i, t, *_ in [*corpus, *rows]:
        want[i] = base_statistics(t)
    assert len(got) == len(corpus) + len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r
        assert r["kept"] == (not r["base_failed"])  # nothing is certified without labels


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    rows = [(k, n) for n in (0, 1, 50, 400, 3000) for k in (0, 1, 5, 20) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        want = 1.0 if r["n"] == 0 or r["k"] >= r["n"] * 0.01 else tail(r["k"], r["n"], 0.01)
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs(spark):
    """Brute force over the grid, stratum by stratum."""
    rules = list(quality_rules.GRID)
    rows, labels = [], []
    for i in range(3000):
        lang = "en" if i % 3 else None
        share = 0.9 if i % 700 == 7 else 0.11 if i % 29 == 0 else 0.0
        rows.append((i, lang, *([share] + [0.0] * (len(rules) - 1))))
        labels += [(i, 1 if i % 10 else 0)] * (2 if i % 5 == 0 else 1)
    stats = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{r} double" for r in rules))
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality_rules.certify(stats, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    alpha, level = quality_rules.RISK / len(rules), quality_rules.DELTA / (2 * len(rules))
    want = {}
    for lang in ("en", None):
        good = [r for r in rows if r[1] == lang and r[0] % 10]
        for j, rule in enumerate(rules):
            for t in quality_rules.GRID[rule]:
                k = sum(r[2 + j] > t for r in good)
                p = 1.0 if k >= len(good) * alpha else tail(k, len(good), alpha)
                if p > level:
                    break
                want[lang, rule] = t
    assert got == want and want["en", rules[0]] > 0.11


def test_quality_stage_keeps_columns(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.keep_good(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(not base_statistics(r["text"])[5] for r in docs.collect())
    assert quality_rules.keep_good(empty, labels).count() == 0


# -- decontamination --------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in [w[k : k + 13] for k in range(len(w) - 12)] if len(w) >= 13 else [w] if w else []:
            windows.setdefault(tuple(s), set()).add("null" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, corpus):
    passage = "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    rows = [(i, t) for i, t, *_ in corpus] + [
        (200, f"before it {passage.upper()} after"), (201, passage[:60]), (202, "x " * 900 + passage), (203, f"{passage} {passage}"),
        (204, "short-item"), (205, "déjà vu"), (206, passage.replace("kappa", "cappa")), (None, passage), (203, passage),
    ]
    items = [(7, passage), (10, passage), (2, "SHORT item"), (3, None), (4, "..."), (5, "déjà vu"), (None, "déjà"), (5, "déjà vu"), (6, corpus[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_hit", "'x' as items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in decontaminate.contamination(docs.repartition(4), bench).collect()), key=key)
    assert got == sorted(brute_contamination(rows, items), key=key)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(r[0]) for r in brute_contamination(rows, items) if not r[5])


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    got = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["n_hit"] or r["contaminated"] for r in got)


def test_blocks_of_items_agree(spark, docs, corpus, monkeypatch):
    items = spark.createDataFrame([(i, t[:300]) for i, t, *_ in corpus if t], "item_id long, text string")
    one = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == one


def test_search_in_small_parts_agrees(corpus, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus if t][:40] + ["the a the a the " * 50, "the"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    row = next(decontaminate._segments(iter([batch])))
    seg = decontaminate._Segment({c: row.column(c)[0].as_py() for c in ("counts", "terms", "offsets", "positions")})
    win, length, _, _ = decontaminate.compile_windows(texts)
    whole = sorted(zip(*(x.tolist() for x in decontaminate.find(seg, win, length))))
    for limit in (1, 97, 1000):
        monkeypatch.setattr(decontaminate, "CANDIDATES", limit)
        assert sorted(zip(*(x.tolist() for x in decontaminate.find(seg, win, length)))) == whole
    assert len(whole) > 100 and not np.array(decontaminate.find(seg, win[:0], length[:0])).size


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the red fox and the lazy dog"), (2, "dog fox"), (3, "fox " + "x " * 9 + "dog"), (4, "fox"), (5, "dog")], "doc_id long, text string")
    index = decontaminate.build_index(docs.coalesce(1))
    assert {r["doc_id"] for r in decontaminate.near(index, "fox dog", 4).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontaminate.near(index, "Dog FOX", 10).collect()} == {1, 2, 3}
    assert decontaminate.near(index, "fox absent", 10).count() == 0


# -- URLs -------------------------------------------------------------------------------------

URLS = {
    "https://a.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "http://b.com/en/1#t": ("b.com", "/en/1", "com/en/", "block"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://xcom/en/": ("xcom", "/en/", None, "allow"), "ftp://x.net/de/80": ("x.net", "/de/80", "net/de/", "allow"),
    "ftp://q.example.net/de/80": ("q.example.net", "/de/80", "example.net/de/8", "block"), "http://myexample.net/de/8": ("myexample.net", "/de/8", "net/de/", "allow"),
    "x": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://y.org": ("y.org", "", None, "allow"), "http://y.org/es/": ("y.org", "/es/", "org/es/", "block"),
    "http://É.org?a://b/c": ("É.org", "", None, "allow"), "a\nb://h.org/p q": ("h.org", "/p q", None, "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    got = [tuple(r)[1:] for r in url_rules.judge(pages, url_rules.MinedRules([])).orderBy("page_id").collect()]
    assert got == list(URLS.values())


def test_mined_combinations(spark):
    pages, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        pages.append((i, f"http://{'spam' if bad or i % 7 == 0 else 'fine'}.example.info/{'win' if bad or i % 5 == 0 else 'news'}/{i}"))
        if i < 500:
            labels.append((i, 0 if bad else 1, None))
    pages = spark.createDataFrame([*pages, (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([*labels, (None, 0, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    mined = url_rules.mine(pages, labels)
    assert mined.combinations
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, mined).collect()}
    assert all((got[i] == "block") == ((i % 6 == 0 or i % 7 == 0) and (i % 6 == 0 or i % 5 == 0)) for i in range(600))
    assert got[None] == "allow"
    assert url_rules.mine(pages, labels.limit(0)).combinations == []
    assert url_rules.judge(pages.limit(0), mined).count() == 0


def test_no_mined_rule_is_dropped(spark):
    """More bad hosts than any list of literals would hold, each with enough bad urls of its own."""
    hosts = 420
    rows = [(h * 30 + k, f"http://bad{h}x.site{h}.info/a{h}q/{k}", 0) for h in range(hosts) for k in range(30)]
    rows += [(10**6 + k, f"http://fine{k}.info/b/{k}", 1) for k in range(hosts * 30)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    mined = url_rules.mine(pages, labels)
    got = url_rules.judge(pages, mined).where("verdict = 'block'").select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows if not r[2])


def test_mined_rules_are_all_minimal_ones(spark):
    """Brute force over all combinations of the tokens of few urls."""
    import itertools
    import random

    rng = random.Random(3)
    rows = []
    for i in range(1500):
        words = [w for w in "abcdef" if rng.random() < 0.5]
        bad = {"a", "b"} <= set(words) or {"c", "d", "e"} <= set(words) or rng.random() < 0.05
        rows.append((i, f"http://{rng.choice('xyz')}.info/" + "/".join(words), 0 if bad else 1, None))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    mined = url_rules.mine(pages, spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int"))
    got = {frozenset([r["key"], *r["rest"]]) for r in mined.index(spark).collect()}
    sets = [(frozenset(r["t"]), not rows[r["page_id"]][2]) for r in pages.select("page_id", url_rules.tokens(*url_rules.parts(pages.url)).alias("t")).collect()]
    n_bad, every = sum(b for _, b in sets), {}
    for t, b in sets:
        for k in range(1, len(t) + 1):
            for c in map(frozenset, itertools.combinations(sorted(t), k)):
                n, m = every.get(c, (0, 0))
                every[c] = (n + 1, m + b)
    good = {c for c, (n, m) in every.items() if m >= url_rules.MIN_URLS and m >= 0.7 * n and m * len(sets) >= 1.5 * n * n_bad}
    assert got == {c for c in good if not any(x < c for x in good)} and any(len(c) == 3 for c in got)


@pytest.mark.parametrize("others", [200, 12_000])
def test_same_evidence_at_any_size(spark, others):
    pages = spark.range(others + 35).selectExpr("id as page_id", "if(id < 35, 'http://one.bad.info/x', concat('http://h', id % 50, '.fine.info/y')) as url")
    labels = pages.selectExpr("page_id as doc_id", "if(page_id < 35, 0, 1) as quality", "cast(null as int) as toxic")
    got = url_rules.judge(pages, url_rules.mine(pages, labels)).where("verdict = 'block'").select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == list(range(35))


def test_labels_and_their_words_are_tokens(spark):
    """Bad labels under several domains, each host with too few urls of its own."""
    bad = [f"http://{h}/p" for k in range(10) for h in (f"spam-farm.a{k}.com", f"x.spam-farm.b{k}.net", f"spam-farm.y.c{k}.org")] + [f"http://very-cheap{k}.d{k}.info/p" for k in range(30)]
    rows = [(i, u, 0) for i, u in enumerate(bad)] + [(1000 + k, f"http://fine{k}.{'com net org info'.split()[k % 4]}/p", 1) for k in range(200)]
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    rows += [(2000, "http://z.spam-farm.example.com/q", 0), (2001, "http://very-good.example.com/q", 0), (2002, "http://good.example.com/q", 1)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = url_rules.judge(pages, url_rules.mine(pages, labels)).where("verdict = 'block'").select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == [r[0] for r in rows if not r[2]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rules_are_mined_on_the_drivers_tables(spark, sf):
    """Each against a recount over all urls; hosts and paths that the fixed rules block lead to further rules."""
    import os

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("driver tables absent")
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    mined = url_rules.mine(pages)
    found = {frozenset([r["key"], *r["rest"]]) for r in mined.index(spark).collect()}
    rows = [(frozenset(r["items"]), r["bad"]) for r in url_rules.decided(pages).collect()]
    share = sum(b for _, b in rows) / len(rows)
    for rule in found:
        hits = [b for items, b in rows if rule <= items]
        assert sum(hits) >= url_rules.MIN_URLS and sum(hits) >= 0.7 * len(hits) and sum(hits) / len(hits) >= url_rules.DECIDED_LIFT * share
        assert not any(other < rule for other in found)
    # they decide urls that no fixed rule does, and only those with a combination
    judged = url_rules.judge(pages, mined).where("rule is null")
    judged = judged.select("verdict", url_rules.tokens(F.col("host"), F.col("path")).alias("items")).collect()
    assert all((r["verdict"] == "block") == any(rule <= set(r["items"]) for rule in found) for r in judged)
    if sf == "sf0.1":
        assert found and 0 < sum(r["verdict"] == "block" for r in judged) < len(judged)


def test_hosts_that_fixed_rules_block_mostly_are_blocked_wholly(spark):
    urls = [f"http://bad.com/en/{i}x" for i in range(10, 60)] + [f"http://bad.com/fr/{i}" for i in range(20)]
    urls += [f"http://good.net/de/{i}" for i in range(1000, 1060)] + [f"http://good.net/fr/{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.mine(pages)).collect()}
    assert all(got[i] == (None, "block") for i in range(50, 70)) and all(got[i] == (None, "allow") for i in range(130, 150))
    assert {got[i] for i in range(50)} == {("com/en/", "block")} and {got[i] for i in range(70, 130)} == {("net/de/", "allow")}


def test_very_long_urls_and_repeats(spark):
    long = "http://" + "a." * 300 + "info/" + "b/" * 2000 + "?" + "c" * 100_000
    rows = [(1, long), (1, long), (2, "http://x.com/en/" + "z" * 50_000), (3, "://"), (4, "http://"), (5, "http://..//--"), (None, "http://q.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.mine(pages)).collect()]
    want = [(1, None, "allow"), (1, None, "allow"), (2, "com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (None, "com/en/", "block")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_rules.mine(pages.limit(0)).combinations == []
