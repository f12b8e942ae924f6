import random
import zlib

import numpy as np
import pytest

from gridloom.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def gapless(rows):
    """Sequences have no gaps and no more than their places; their number is returned."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= P.CAPACITY
    return len(by)


def test_pieces_and_places(spark, docs, corpus):
    got = P.pack(P.pieces(docs, with_ids=False).cache()).collect()
    gapless(got)
    want = []
    for i, text, *_ in corpus:
        ids = encoded(text)
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 1024 * 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)


def test_sequences_hold_the_documents(spark, docs, corpus):
    texts = {}
    for i, text, *_ in corpus:
        texts.setdefault(i, []).append(encoded(text))
    seen = {}
    for r in P.sequences(docs).collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= P.CAPACITY and len(r["doc_ids"]) == len(r["lengths"])
        at = 0
        for i, n in zip(r["doc_ids"], r["lengths"]):
            seen.setdefault(i, []).extend([tuple(r["ids"][at : at + n])])
            at += n
    assert {i: sum(map(len, v)) for i, v in seen.items()} == {i: sum(map(len, v)) for i, v in texts.items()}
    for i, parts in texts.items():
        for ids in parts:  # the last piece of each document is there whole
            assert tuple(ids[-min(1024, len(ids)) :]) in seen[i]


def test_few_sequences(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 1025)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, length long").repartition(4)
    n = gapless(P.pack(df).collect())
    assert n <= 1.02 * -(-sum(x for _, x in rows) // 1024)
    assert gapless(P.pack(df, task_pieces=500).collect()) <= 1.05 * -(-sum(x for _, x in rows) // 1024)


@pytest.mark.parametrize("limit", [1, 2, 7, 1000])
def test_bins_against_a_plain_search(limit):
    rng = random.Random(limit)
    bins, plain, made = P.Bins(100, limit), [], 0  # plain: (free, order of arrival there, bin)
    for k in range(2000):
        size = rng.randrange(1, 101)
        fit = [x for x in plain if x[0] >= size]
        if fit:
            best = min(fit, key=lambda x: (x[0], -x[1]))
            plain.remove(best)
        else:
            if len(plain) == limit:
                plain.remove(min(plain, key=lambda x: (x[0], -x[1])))  # the fullest closes
            best, made = (100, 0, made), made + 1
        assert bins.place(size) == (best[2], 100 - best[0])
        if best[0] > size:
            plain.append((best[0] - size, k, best[2]))
        assert bins.open == len(plain) <= limit and bins.made == made


def test_cut():
    row, piece, start, length = P.cut(np.array([1, 1024, 1025, 3000]))
    assert list(zip(row.tolist(), piece.tolist(), start.tolist(), length.tolist())) == [
        (0, 0, 0, 1), (1, 0, 0, 1024), (2, 0, 0, 1), (2, 1, 1, 1024), (3, 0, 0, 952), (3, 1, 952, 1024), (3, 2, 1976, 1024),
    ]


def test_empty_and_null(spark, empty):
    assert P.pack(P.pieces(empty)).collect() == []
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    got = P.pack(P.pieces(df)).collect()
    assert len(got) == 3 and {r["length"] for r in got} == {1} and gapless(got) == 1 and all(r["ids"] == [2] for r in got)
