import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import mixing, token_ids, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def water(sizes):
    """Targets by the rule's own loop."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(docs, corpus):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in corpus:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes)
    got = mixing.decide(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.decide(docs.repartition(5)).collect()))
    by_id = {(i, t): s for i, t, _, s in corpus}
    assert len(got) == len(corpus)
    sources = {i: s for (i, _), s in by_id.items()}
    for r in got:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in {r["size"] * k for k in (0, 1, 2)}
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    taken = sum(r["taken"] for r in got)
    assert sum(size(r["text"]) for r in copies.collect()) == taken


@pytest.mark.parametrize("seed", range(6))
def test_targets_of_many_sources(spark, seed):
    """Against the rule's own loop, from even sizes to one source that holds most words."""
    rng = np.random.default_rng(seed)
    sizes = {f"s{k}": int(v) for k, v in enumerate(rng.pareto(0.3 + seed, 23) * 100)} | {None: int(rng.integers(0, 500))}
    if seed == 5:
        sizes = {f"s{k}": 100 for k in range(20)}
    want = water(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == {s: pytest.approx(t) for s, t in want.items()}
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), f"s{min(i % 9, 3)}") for i in range(1500)]
    out = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        part = [r for r in out if source[r["doc_id"]] == s]
        assert sum(r["taken"] for r in part) == pytest.approx(part[0]["target"], rel=0.01)


def test_chosen_seeds_keep_the_fraction_on_average(spark):
    """One source at rate 1.5: half of the documents get a second copy, whatever their size or id."""
    rows = [(i, "w " * (1 + i * 37 % 200), "s") for i in range(6000)]
    out = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    twice = np.array([r["taken"] > r["size"] for r in sorted(out, key=lambda r: r["doc_id"])])
    assert twice.mean() == pytest.approx(0.5, abs=0.03)
    small = np.array([1 + i * 37 % 200 < 100 for i in range(6000)])
    assert twice[small].mean() == pytest.approx(twice[~small].mean(), abs=0.05)
    assert twice[:3000].mean() == pytest.approx(twice[3000:].mean(), abs=0.05)


def test_ranks_and_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(f"s{k:04d}" if k % 50 else None, k) for k in range(1, 800)]
    df = spark.createDataFrame(rows, "source string, size long").repartition(7)
    got = mixing._running(df, [F.col("source").asc_nulls_last(), F.col("size")], {"rank": F.lit(1), "total": F.col("size")}).collect()
    total = 0
    for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), 1):
        total += r[1]
        assert next((x["rank"], x["total"]) for x in got if (x["source"], x["size"]) == r) == (k, total)


def test_mixing_empty(empty, spark):
    assert mixing.decide(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.decide(blank).collect()] == [(0, 0.0, 0)] * 2


# -- token ids --------------------------------------------------------------------------------

ODD = ["don't 'sup we've  two  spaces\n\n x\t y  ", "日本語 test <|endoftext|> a'll'", "'s 'st ''s  x\x0b", "a\n", " 'tis \n'd it's", "x   ", "\u00a0 nb\u200bsp", "½ 12 3rd ǅ", "\x85a b", "it'S 'RE  'reX", "a" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return token_ids.Encoder(public_tokenizers.path(token_ids.VOCABULARY))


def reference(encoder, texts):
    return [e.ids + [0] for e in encoder.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(encoder, corpus):
    texts = [t for _, t, *_ in corpus] + ODD
    for part in (texts, [None], [""], texts[::-1]):
        ids, n = encoder.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == reference(encoder, part)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (2, 1), (5000, 3), (20000, 60000), (300, 1)])
def test_grammar_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    blob = token_ids.compress(ids)
    s = token_ids.Shard(blob)
    assert (s.ids() == ids).all() and len(s.ids()) == n
    for a, b in ((0, 1), (n // 3, n // 2), (n - 2, n + 5), (7, 7)):
        if 0 <= a:
            assert (s.ids(a, b) == ids[a:b]).all()
    if n == 5000:
        assert len(blob) < 2 * n and len(s.rules)


def test_files(docs, corpus, encoder, empty):
    shards = token_ids.write_shards(docs)
    got = token_ids.read_digests(shards).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for (i, *_), ids in zip(order, reference(encoder, [r[1] for r in order])):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_ids.read_digests(token_ids.write_shards(empty)).count() == 0


# -- WARC -------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    long = "é" * 60
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "u", long), (3, "again", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "z" * 100), (8, "u", "x\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    archives = warc.write_archives(pages)
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        revisit = len(p) >= 100 and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.export(archives, f"file://{tmp_path}") == archives.count()
    back = [h for f in tmp_path.glob("*.warc.gz") for h, _ in warc.records(f.read_bytes())]
    assert len(back) == len(rows) and all(h["WARC-Type"] in ("response", "revisit") for h in back)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_grammar_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.tile(rng.integers(0, 50_000, 4_000), 40), rng.integers(0, 70_000, 3_000)]).astype(np.uint32)
    s = token_ids.Shard(token_ids.compress(ids))
    assert (s.ids() == ids).all() and (s.ids(150_000, 162_000) == ids[150_000:162_000]).all()
    pairs, count = np.unique(s.seq[:-1].astype(np.int64) << 32 | s.seq[1:], return_counts=True)
    assert count.max() < token_ids.MIN_PAIRS and len(s.seq) < 3_000 + 160_000 // 80


def test_added_tokens_as_in_the_untouched_library():
    import pyarrow as pa

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_ids.VOCABULARY)
    texts = ["plain", "", "a <|endoftext|> b", "x <|endof", "text|> y", None, "<|endoftext|><|endoftext|>", "é <|endoftext|>", "after all"]
    ids, counts = token_ids.Encoder(path).encode(pa.array(texts, pa.string()))
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [token_ids.END_ID] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert want[2] == [64, 220, 50256, 275, token_ids.END_ID]


def twins(n=1024):
    """Two words of ``n`` letters with equal sums against the powers of any odd number modulo 2 ** 64."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_algebraic_family_differ(encoder):
    a, b = twins()
    texts = [f"x {a} y {b}", a, b, f" {b}", f" {a}"]
    ids, n = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == reference(encoder, texts)


def test_pieces_of_one_hash_are_told_apart(encoder, monkeypatch):
    """Every piece of 8 bytes or more hashes alike here."""
    from gridloom.llm import words

    real = words.hashes
    monkeypatch.setattr(words, "hashes", lambda d, s, e, fold=True: np.where(e - s > 7, np.uint64(5), real(d, s, e, fold)))
    texts = [" alphabetical betamethasone gammaglobulin alphabetical", "unbelievably betamethasone", "alphabetical" * 9]
    for part in (texts, texts[::-1]):
        ids, n = token_ids.Encoder(public_tokenizers.path(token_ids.VOCABULARY)).encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == reference(encoder, part)


def test_memo_forgets_within_its_bound(encoder, corpus, monkeypatch):
    monkeypatch.setattr(token_ids, "MEMO", 60)
    small = token_ids.Encoder(public_tokenizers.path(token_ids.VOCABULARY))
    texts = [t for _, t, *_ in corpus if t and len(t) < 2000]
    for k in range(0, len(texts), 4):
        ids, n = small.encode(pa.array(texts[k : k + 4]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == reference(encoder, texts[k : k + 4])


def test_forgetting_takes_little_memory():
    """Long pieces that all stay: what is copied is a few times their text, not a place of 24 bytes for each byte."""
    import tracemalloc

    memo, n = token_ids._Memo(), 60_000
    text = np.random.default_rng(1).integers(97, 123, 100 * n, np.uint8).tobytes()
    slots = memo.add(text, np.full(n, 100), np.arange(2 * n), np.full(n, 2))
    memo.index(np.arange(n, dtype=np.uint64), slots)
    memo.again[:n:2] = True
    tracemalloc.start()
    memo.forget()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert memo.n == n // 2 and peak < 10 * len(text) // 2
    at = memo.find(np.arange(0, n, 2, dtype=np.uint64))
    assert token_ids._gather(memo.text, memo.begin[at], memo.length[at]).tobytes() == b"".join(text[100 * k : 100 * k + 100] for k in range(0, n, 2))
    assert token_ids._gather(memo.ids, memo.start[at], memo.size[at]).tolist() == [x for k in range(0, n, 2) for x in (2 * k, 2 * k + 1)]


def test_runs_of_one_symbol():
    ids = np.array([5] * 100 + [6] + [5] * 9 + [7, 7, 7] * 9, np.uint32)
    s = token_ids.Shard(token_ids.compress(ids))
    assert (s.ids() == ids).all() and len(s.rules)


def test_text_ids_read_back_as_they_are(spark):
    ids = ["", "a\r\nb", "100%25", "%0A", " x ", "k: v", None, "é"]
    pages = spark.createDataFrame([(i, "http://h/100%", "body " * 40) for i in ids], "page_id string, url string, html string")
    got = warc.read_archives(warc.write_archives(pages), "string").collect()
    assert sorted(map(repr, (r["page_id"] for r in got))) == sorted(map(repr, ids))
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {""}
    assert [r["page_id"] for r in got if r["record_type"] == "response"] == [""]


def test_broken_archives_are_refused():
    whole = warc._record("response", "1", "u", "d", 3, b"x" * 70_000, None, warc.DATE)
    assert [h["X-Page-ID"] for h, _ in warc.records(whole * 3)] == ["1"] * 3
    with pytest.raises(ValueError):
        list(warc.records(whole[:-9]))
