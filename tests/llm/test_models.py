import math
import zlib

import numpy as np
import pytest

from gridloom.llm import elias_fano, language_id, ngram_lm, quality_model

DATA = "/root/testdata/sf0.1"


def held(i, part, parts):
    return i is not None and zlib.crc32(str(i).encode()) % parts == part


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (1000, 100), (3000, 10**12), (2000, 2000), (70, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    e = elias_fano.EliasFano(elias_fano.build(v))
    assert (e.get(np.arange(n)) == v).all()
    x = rng.integers(0, top + 5, 3000).astype(np.uint64)
    assert (e.successor(x) == np.searchsorted(v, x)).all()


def tokens(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").replace("\x0b", " ").split()] + [None]


def brute_model(texts):
    one, two, three = {}, {}, {}
    for t in texts:
        w = tokens(t)
        for k in range(len(w)):
            one[w[k]] = one.get(w[k], 0) + 1
            if k:
                two[w[k - 1], w[k]] = two.get((w[k - 1], w[k]), 0) + 1
            if k > 1:
                three[tuple(w[k - 2 : k + 1])] = three.get(tuple(w[k - 2 : k + 1]), 0) + 1
    return one, two, three


def test_language_model(spark, docs, corpus):
    keep = [r for r in corpus if not held(r[0], 1, 5)]
    one, two, three = brute_model([r[1] for r in keep])
    n, v = sum(one.values()), len(one)
    uri, meta = ngram_lm.train(docs.where(~language_id.held_out(1, 5)), least=2)
    assert (meta["tokens"], meta["types"]) == (n, v)
    assert meta["pairs"][-1] == sum(c > 1 for c in two.values())
    assert meta["triples"][-1] == sum(c > 1 and two[k[0], k[1]] > 1 and two[k[1], k[2]] > 1 for k, c in three.items())
    got = {}
    for r in ngram_lm.score(docs, uri, meta).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in corpus:
        w = tokens(t)
        base = sum(math.log10((one.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in one for x in w), n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0


def test_whole_language_model(spark, docs, corpus, tmp_path):
    """The query keeps every pair and triple: a held-out copy of a text that was learned once is credited for it."""
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"v{k}" for k in rng.permutation(300)[:80]) for i in range(40) if not held(i, 1, 5)}
    copy = next(i for i in range(100, 200) if held(i, 1, 5))
    rows = [*texts.items(), (copy, next(iter(texts.values()))), (next(i for i in range(200, 300) if held(i, 1, 5)), " ".join(f"v{k}" for k in rng.permutation(300)[:80]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in ngram_lm.op6_ngram_score(spark, str(tmp_path)).collect()}
    gain = {i: r["score"] - r["base_score"] for i, r in got.items() if r["held_out"]}
    assert len(gain) == 2 and gain[copy] > 100 > gain[rows[-1][0]] + 20
    keep = docs.where(~language_id.held_out(1, 5))
    _, two, three = brute_model([r[1] for r in corpus if not held(r[0], 1, 5)])
    _, meta = ngram_lm.train(keep, least=1)
    assert (meta["pairs"][-1], meta["triples"][-1]) == (len(two), len(three))


def brute_scores(texts, train):
    """The same model by dictionaries: quantised discounted probabilities with backoff."""
    one, two, three = brute_model(train)
    n, v = sum(one.values()), len(one)

    def level(grams, context):
        ones, twos = (sum(c == k for c in grams.values()) for k in (1, 2))
        d = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.9)
        code, by = {g: int(ngram_lm._quantise(np.array([(c - d) / context(g)]))[0]) for g, c in grams.items()}, {}
        for g in grams:
            by.setdefault(g[:-1], []).append(g)
        back = {}
        for h, kids in by.items():
            while (mass := sum(10.0 ** (-code[g] / 255 * ngram_lm.DECADES) for g in kids)) > 0.999:
                for g in kids:
                    code[g] = min(255, code[g] + 1)
            back[h] = max(1, round((1 - mass) * 65535)) / 65535
        return {g: 10.0 ** (-c / 255 * ngram_lm.DECADES) for g, c in code.items()}, back

    q2, b2 = level(two, lambda g: one[g[0]])
    q3, b3 = level(three, lambda g: two[g[:2]])
    out = []
    for t in texts:
        w, total = tokens(t), 0.0
        for k, x in enumerate(w):
            p = (one.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))
            if k and w[k - 1] in one:
                p = p * b2.get((w[k - 1],), 1.0) + q2.get((w[k - 1], x), 0.0)
            if k > 1 and (w[k - 2], w[k - 1]) in two:
                p = p * b3.get((w[k - 2], w[k - 1]), 1.0) + q3.get((w[k - 2], w[k - 1], x), 0.0)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("partitions", [4, 16])
def test_scores_equal_the_brute_force_model(spark, docs, corpus, partitions):
    want = brute_scores([r[1] for r in corpus], [r[1] for r in corpus if not held(r[0], 1, 5)])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        uri, meta = ngram_lm.train(docs.where(~language_id.held_out(1, 5)))
        got = {}
        for r in ngram_lm.score(docs, uri, meta).collect():
            got.setdefault(r["doc_id"], []).append(r["score"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert meta["shards"] == partitions
    for (i, *_), x in zip(corpus, want):
        assert got[i][0] == pytest.approx(x, abs=1e-6 + 1e-6 * abs(x)), i


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("task_tokens", [300, 10**9])
def test_a_word_in_a_third_of_the_tokens(spark, task_tokens, least):
    """Parts and ranges stay about as small as they shall be, and scores do not depend on them."""
    rng = np.random.default_rng(8)
    texts = [" ".join("the" if rng.random() < 0.35 else f"w{k}" for k in rng.zipf(1.5, 60) % 400) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    uri, meta = ngram_lm.train(docs, least, task_tokens)
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, uri, meta).collect()}
    if least == 1:
        for i, x in enumerate(brute_scores(texts, texts)):
            assert got[i] == pytest.approx(x, abs=1e-6 + 1e-6 * abs(x)), i
    one, two, three = brute_model(texts)
    assert meta["pairs"][-1] == sum(c >= least for c in two.values())
    assert meta["triples"][-1] == sum(c >= least for c in three.values())
    if task_tokens == 10**9:
        assert meta["parts"][-1] == meta["shards"]
        return
    assert max(meta["sides"]) >= 3 and meta["shards"] >= 16
    size = {}
    schema = ngram_lm._TRIPLES
    for r in docs.select("text").mapInArrow(ngram_lm._count_triples(uri, meta), schema).collect():
        size[r["part"]] = size.get(r["part"], 0) + int(ngram_lm._expand(bytes(r["counts"])).sum())
    shard = {}
    for part, n in size.items():
        s = int(ngram_lm._owner(meta["parts"], part))
        shard[s] = shard.get(s, 0) + n
    assert sum(size.values()) == sum(two.values())
    assert max(shard.values()) > 0.3 * sum(two.values()) > 2 * max(size.values())
    assert np.diff(meta["triples"]).max() <= task_tokens + max(two.values())


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0), np.array([0]), np.array([2**63, 2**64 - 1], np.uint64), rng.integers(0, 300, 1000)):
        a = a.astype(np.uint64)
        assert (ngram_lm._expand(ngram_lm._squeeze(a)) == a).all()
        a.sort()
        assert (ngram_lm._expand(ngram_lm._squeeze(a, True), True) == a).all()
    from gridloom.llm import words

    for h in (rng.integers(0, 50, 999), rng.integers(0, 2**62, 999), np.repeat(rng.integers(0, 2**62, 9), 50) + rng.integers(0, 3, 450)):
        h = h.astype(np.uint64)
        keys, first, back = words.distinct(h)
        want = np.unique(h, return_index=True, return_inverse=True)
        assert all((x == y).all() for x, y in zip((keys, first, back), want))


def test_words_of_one_algebraic_family_have_their_own_hashes():
    import pyarrow as pa
    from test_outputs import twins

    from gridloom.llm import words

    texts = [*twins(), *twins(16), *twins(32), "a" * 7, "a" * 8, "a" * 32, "a" * 33, "A" * 33, "\0", "\0\0", "\0" * 8, "\0" * 9]
    data, off = words.flat(pa.array(texts))
    h = words.hashes(data, off[:-1], off[1:])
    assert len(set(h.tolist())) == len(texts) - 1 and h[9] == h[10]
    s, e, _ = words.spans(data, off, words.SPACED)
    assert (words.hashes(data, s, e) == h).all()


def test_conditional_distributions_sum_to_one(spark, docs, corpus):
    """Over all known words and one unknown word, after one and after two words."""
    import pyarrow as pa

    texts = [r[1] for r in corpus if r[0] is not None and r[0] < 52]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    uri, meta = ngram_lm.train(df)
    trie = ngram_lm.Trie(uri, meta)
    one, two, _ = brute_model(texts)
    vocabulary = sorted(x for x in one if x) + ["unseen-word"]
    pair = max((k for k in two if k[1] is not None), key=lambda k: (two[k], k))
    for context in ([pair[0]], list(pair), ["unseen"], [pair[0], "unseen"]):
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join([*context, w]) for w in vocabulary] + [" ".join(context)])], names=["text"])
        total = 0.0
        for _, _, h, at in ngram_lm._sequence(batch):
            p, _, _ = trie.log_probabilities(h, at)
            place = at[:-1] + len(context)
            total += (10.0 ** p[place]).sum()
        assert total == pytest.approx(1.0, abs=2e-4)


def test_model_beats_its_base_on_repeats(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    uri, meta = ngram_lm.train(docs.where(~language_id.held_out(1, 5)))
    for r in ngram_lm.score(docs, uri, meta).collect():
        assert r["score"] > r["base_score"] / 4


def test_language_model_without_training_text(spark, docs, empty):
    uri, meta = ngram_lm.train(empty)
    got = ngram_lm.score(docs, uri, meta).collect()
    assert len(got) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in got)
    assert ngram_lm.score(empty, uri, meta).count() == 0


def test_language_identification(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    rows = [r for r in docs.collect() if r["lang"] is not None and r["text"] and any(c.isalpha() for c in r["text"])]
    test = [r for r in rows if held(r["doc_id"], 2, 4)]
    right = [r["lang"] == got[r["doc_id"]]["lang_pred"] for r in test]
    assert len(test) > 500 and sum(right) / len(right) > 0.97
    accepted = [x for x, r in zip(right, test) if got[r["doc_id"]]["accepted"]]
    assert sum(accepted) / len(accepted) >= sum(right) / len(right)
    assert all(r["held_out"] == held(i, 2, 4) and 0 <= r["score"] <= 1 for i, r in got.items())


@pytest.mark.parametrize("rate", [0.5, 50.0])
def test_language_training_stays_finite(spark, monkeypatch, rate):
    monkeypatch.setattr(language_id, "RATE", rate)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null").select("text", "lang").collect()
    with np.errstate(over="raise", invalid="raise"):
        model = language_id.train([r["text"] for r in rows] + ["", "a", "zz " * 100_000], [r["lang"] for r in rows] + ["en", "de", "fr"])
    assert np.isfinite(model.scores).all() and np.isfinite(model.bias).all()
    assert language_id.TEMPERATURES[0] < model.temperature < language_id.TEMPERATURES[-1] and 0 < model.reject_below < 1


def test_language_edges(spark, docs, corpus, empty):
    model = language_id.train(["der die das und " * 9, "the and of a " * 9], ["de", "en"])
    extra = spark.createDataFrame([(900, "123 !?"), (901, "語"), (902, "«»")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs.select("doc_id", "text").unionByName(extra), model).collect()}
    assert got[900]["lang_pred"] == got[902]["lang_pred"] == got[47]["lang_pred"] == got[48]["lang_pred"] == "und"
    assert got[901]["lang_pred"] in ("de", "en") and got[47]["score"] == 0
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_quality_model(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.score(docs, labels).collect()}
    test = [r for r in labels.collect() if held(r["doc_id"], 2, 4) and r["doc_id"] in got and r["quality"] is not None]
    good = [got[r["doc_id"]]["score"] for r in test if r["quality"] == 1]
    bad = [got[r["doc_id"]]["score"] for r in test if r["quality"] == 0]
    auc = np.mean([(g > np.array(bad)).mean() + 0.5 * (g == np.array(bad)).mean() for g in good])
    assert auc > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(i, 2, 4) for i, r in got.items())


def brute_statistics(t):
    """One text's statistics, word by word (sizes in bytes)."""
    import re

    t = t or ""
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    if not w:
        return [0.0] * len(quality_model.STATISTICS)
    n, raw = len(w), t.encode()
    chars = sum(len(x.encode()) for x in w)
    count = {x: w.count(x) for x in set(w)}
    lines = [x for x in t.split("\n") if x]
    folded = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in lines]
    three = [tuple(w[k : k + 3]) for k in range(n - 2)]
    among = lambda cs: sum(raw.count(c.encode()) for c in cs) / chars
    dup = len(lines) - len(set(folded))
    return [
        n, chars / n, len(count) / n, max(count.values()) / n, sum(x == y for x, y in zip(w, w[1:])) / n,
        sum(65 <= c <= 90 for c in raw) / chars, sum(48 <= c <= 57 for c in raw) / chars, among("#*$%&|<>"), among("!?"), among(".,;:'\"()-"),
        len(lines) / n, dup / max(len(lines), 1), chars / max(len(lines), 1), sum(c >= 128 for c in raw) / chars,
        sum(len(x.encode()) > 20 for x in w) / n, 1 - len(set(three)) / len(three) if three else 0.0,
    ]


def test_text_statistics(corpus):
    import pyarrow as pa

    from gridloom.llm import words as W

    texts = [t for _, t, *_ in corpus if t is None or len(t) < 5000] + ["A a A", "x\n\nx\nX y\n", "#1! #2? (é)", "one two three one two three one", "b" * 30 + " c"]
    d, o = W.flat(pa.array(texts, pa.string()))
    got = quality_model.statistics(d, o)
    for t, row in zip(texts, got):
        assert row.tolist() == pytest.approx(brute_statistics(t)), t


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.score(empty, none).count() == 0
    same = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(3, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r["score"] < 1 for r in quality_model.score(docs, same).collect())


def test_compiled_rules_are_the_ensemble(spark):
    import pyarrow as pa

    from gridloom.llm import words as W

    texts = ["a b c", "A A A A!!", None, "", "x# y# z#", "é è\né è"] * 30
    d, o = W.flat(pa.array(texts, pa.string()))
    x = quality_model.statistics(d, o)
    y = np.array([t == "a b c" for t in texts], float)
    model = quality_model.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality_model.STATISTICS))
    got = [r["s"] for r in df.select(model.column().alias("s")).collect()]
    assert got == pytest.approx(model.score(x).tolist()) and ((np.array(got) > 0.5) == (y > 0.5)).all()


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    """Ids that repeat, many times or with many texts, are one row of a classifier's sample."""
    from gridloom.llm import language_id, quality_model

    text = "some words of a text that is labelled "
    rows = [(1, text * (k % 5 + 1), "en", "a") for k in range(3000)] + [(i, text + str(i), "en" if i % 2 else "de", "a") for i in range(2, 60)]
    rows.append((60, "x" * (language_id.TEXT_BYTES + 1), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, langs: seen.append((len(texts), max(map(len, texts)))))
    language_id.fit(docs, 10_000)
    assert seen[0][0] <= 60 and seen[0][1] <= language_id.TEXT_BYTES
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_model, "fit_rules", lambda x, y: seen.append(len(y)))
    quality_model.fit(quality_model.statistics_table(docs), labels)
    assert 30 < seen[1] <= 60


def test_language_scores_gram_by_gram():
    """The vectorised logits against a loop over the bytes of each text."""
    import numpy as np
    import pyarrow as pa

    from gridloom.llm import language_id as L
    from gridloom.llm import words as W

    rng = np.random.default_rng(2)
    model = L.Model(["a", "b", "c"], rng.normal(size=(L.BUCKETS, 3)).astype(np.float32), rng.normal(size=3))
    texts = ["", "x", "xy", "Mixed CASE été 日本", "ab" * 500, " ", None, "Z"]
    want = []
    for t in texts:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        total, n = np.zeros(3), 0
        for size in (2, 3):
            for i in range(len(raw) - size + 1):
                g = int.from_bytes(raw[i : i + size], "big")
                total += model.scores[(g * (0x9E3779B1 + 2 * size) % (1 << 32)) >> 16]
                n += 1
        want.append(total / max(n, 1) + model.bias)
    data, off = W.flat(pa.array(texts))
    assert np.allclose(model.logits(data, off), want, rtol=1e-5, atol=1e-6)
    p = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
    assert np.allclose(model.probabilities(data, off), p, rtol=1e-5, atol=1e-6)


def test_quality_scores_rule_by_rule(spark):
    """The query's scores against the fitted rules, applied to one row's statistics at a time."""
    import math
    import random

    from gridloom.llm import quality_model as M

    rng = random.Random(8)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        words = [f"w{rng.randrange(300 if good else 9)}" for _ in range(rng.randrange(60, 120) if good else rng.randrange(5, 60))]
        rows.append((i, " ".join(words) + ("" if good else " !!! $$$ ### " * rng.randrange(4))))
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    stats = M.statistics_table(docs)
    model = M.fit(stats, labels)
    assert model.rules
    of = {r["doc_id"]: [r[c] for c in M.STATISTICS] for r in stats.collect()}
    got = M.score(docs, labels).collect()
    assert len(got) == 402
    for r in got:
        z = model.bias
        for rule, weight in model.rules:
            if all(of[r["doc_id"]][k] > cut if greater else of[r["doc_id"]][k] <= cut for k, greater, cut in rule):
                z += weight
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)
