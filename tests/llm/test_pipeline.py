"""The pipeline against brute-force versions of its stages, on the smallest tables."""

import os
import zlib

import numpy as np
import pytest
from test_filters import base_statistics, brute_contamination
from test_near_dedup import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p

    from gridloom.llm.runtime import materialise

    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, f in p.STAGES:
        out.append(materialise(f(spark, out[-1], DATA), "test-" + name.replace(" ", "-")))
    return out


def test_quality(stages):
    passed = [r for r in rows(stages[0]) if not base_statistics(r[1])[5]]
    kept = rows(stages[1])
    assert stages[1].columns == stages[0].columns and set(kept) <= set(passed)
    assert len(kept) > 0.5 * len(passed)  # the certified rules reject few


def test_near_copies(stages):
    before = rows(stages[1])
    want, _ = brute([(r[0], r[1]) for r in before])
    assert rows(stages[2]) == [r for r in before if want[r[0]] == r[0]]


def test_contamination(spark, stages):
    before = rows(stages[2])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([(r[0], r[1]) for r in before], items) if r[5]}
    assert rows(stages[3]) == [r for r in before if r[0] not in bad]


def test_mix(stages):
    from gridloom.llm import mixing

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.decide(stages[3]).collect()}
    want = sorted((r for r in rows(stages[3]) for _ in range(taken[r[0]][0] // max(1, taken[r[0]][1]))), key=str)
    assert rows(stages[4]) == want and want


def test_tokens(stages):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start, want = 0, []
    for r in sorted(rows(stages[4]), key=lambda r: r[0]):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect()), key=lambda r: r[1]) == want


def test_run(spark, stages):
    import corpus_pipeline as p

    assert rows(p.run(spark, DATA)) == rows(stages[5])
    assert [n for n, _ in p.STAGES] and p.ORACLE_SQL is None


def test_two_runs_can_both_be_read(spark, stages):
    import corpus_pipeline as p

    first, second = p.run(spark, DATA), p.run(spark, DATA)
    assert rows(first) == rows(second) == rows(stages[5])
    a = p.near_dedup_stage(spark, stages[1], DATA)
    b = p.decontaminate_stage(spark, stages[2], DATA)
    p.mix_stage(spark, stages[3], DATA)
    assert rows(a) == rows(stages[2]) and rows(b) == rows(stages[3]) and rows(first) == rows(stages[5])


def brute_quality(rows, labels):
    """Rows that pass the base rule and every cutoff that the labels certify, computed row by row."""
    from test_filters import tail

    from gridloom.llm import quality_rules as q

    def shares(t):
        t = t or ""
        n, chars, symbols, dup, rep, _ = base_statistics(t)
        lines = [x for x in t.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
        share = lambda a, b: a / b if b else 0.0
        upper, marks = sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t)
        return {"symbol_share": share(symbols, chars), "mark_share": share(marks, chars), "upper_share": share(upper, chars), "dup_line_share": share(dup, len(lines)), "repeat_share": share(rep, n)}

    good = {i for i, quality in labels if quality == 1 and i is not None}
    stats = [(r, shares(r[1])) for r in rows]
    held = {}
    for r, s in stats:
        if r[0] in good:
            held.setdefault(r[2], []).append(s)
    alpha, cut = q.RISK / len(q.GRID), {}
    for lang, texts in held.items():
        for rule, grid in q.GRID.items():
            for t in grid:
                k, n = sum(s[rule] > t for s in texts), len(texts)
                if k >= n * alpha or tail(k, n, alpha) > q.DELTA / (len(held) * len(q.GRID)):
                    break
                cut[lang, rule] = t
    return [r for r, s in stats if not base_statistics(r[1])[5] and not any(s[rule] > cut.get((r[2], rule), 2.0) for rule in q.GRID)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_stage_equals_brute_force(spark, sf):
    import corpus_pipeline as p

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("driver tables absent")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()]
    want = brute_quality(rows(docs), labels)
    assert rows(p.quality(spark, docs, f"/root/testdata/{sf}")) == want
    if sf == "sf0.1":  # enough labels: some documents that pass the base rule are rejected by certified cutoffs
        assert len(want) < sum(not base_statistics(r[1])[5] for r in rows(docs))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small(spark, path, documents, labels=(), items=()):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, small(spark, tmp_path, []))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run_on_nulls_ties_and_long_texts(spark, tmp_path):
    import corpus_pipeline as p

    text = lambda k, n=80: " ".join(f"w{k}x{i}" for i in range(n))
    documents = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, text(3), None, None, None), (4, text(4), "en", "a", 0), (5, text(4), "de", "a", 0),
        (4, text(4), "en", "a", 0), (None, text(6), "en", None, 0), (7, text(7, 30_000), "en", "a", 0), (8, text(8) + " " + text(9), "en", "a", 0), (10, " \n\t ", "en", "a", 0),
    ]
    sf = small(spark, tmp_path, documents, [(3, 1, 0), (None, 1, None), (4, None, 1)], [(1, text(8)), (2, None), (None, "...")])
    got = sorted(map(tuple, p.run(spark, sf).collect()), key=lambda r: r[1])
    ids = {r[0] for r in got}
    assert ids <= {3, 4, None, 7}  # 5 is a copy of 4, and 8 holds a benchmark item
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.decontaminate_stage(spark, p.near_dedup_stage(spark, p.quality(spark, docs, sf), sf), sf)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "4", "7", "None"]


def test_reads_leave_no_buffers_outside_the_heap(spark, tmp_path):
    """A column chunk of 26 MB, read in a prepared session: no thread keeps a buffer of its size."""
    from pyspark.sql import functions as F

    from gridloom.llm.runtime import ship

    vectored = "parquet.hadoop.vectored.io.enabled"

    def direct():
        jvm = spark.sparkContext._jvm
        pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
        return next(b.getMemoryUsed() for b in pools if b.getName() == "direct")

    path = str(tmp_path / "t.parquet")
    spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.option("compression", "none").parquet(path)
    ship(spark)
    before = direct()
    assert spark.read.parquet(path).agg(F.sum(F.length("text"))).first()[0] == 64 * 400_000
    assert direct() - before < 8 << 20
    spark.conf.set(vectored, "true")  # a session's own choice stays
    ship(spark)
    assert spark.conf.get(vectored) == "true"
    spark.conf.unset(vectored)
    ship(spark)
    assert spark.conf.get(vectored) == "false"
