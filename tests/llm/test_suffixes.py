"""Repeated byte strings against a count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import sha
from conftest import DATA

from hitprism.llm import queries as q
from hitprism.llm import suffixes
from hitprism.llm.bwt import column_wise, walk

SIZE = 200


def brute(texts):
    """Per text: (n_bytes, n_removed, n_spans, kept_sha256)"""
    texts = [(t or "").encode() for t in texts]
    counts = Counter(t[i:i + SIZE] for t in texts for i in range(len(t) - SIZE + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - SIZE + 1):
            if counts[t[i:i + SIZE]] > 1:
                gone[i:i + SIZE] = b"\1" * SIZE
        out.append((len(t), sum(gone), sum(g and not before for g, before in zip(gone, b"\0" + gone)), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def found(frame):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in frame.collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.suffix_dedup(spark, DATA).collect()}
    want = dict(zip([i for i, _ in rows], brute([t for _, t in rows])))
    assert got == want
    assert any(0 < v[1] < v[0] for v in want.values())


def crafted(rng, n=20):
    """Texts with a passage of 150 bytes in most, cut copies, and repeats of one byte."""
    alphabet = "abé \n"
    passage = "".join(rng.choice("abcdefgh ") for _ in range(185))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) + passage + "".join(rng.choice("xy") for _ in range(rng.randint(0, 300)))
             for _ in range(n)]
    texts += [t[rng.randint(0, 30):] for t in texts[:8]] + [texts[3] + texts[3], "a" * 450, "é" * 120, passage, passage + "x" * 14, passage + "x" * 15 + "z"]
    return texts + [None, "", "b" * 199, "c" * 200, "d" * 200, "d" * 200]


@pytest.mark.parametrize("most", [1 << 21, 4000])
def test_crafted_texts(spark, most):
    # a small bound makes the common passage one that is cut in halves
    texts = crafted(random.Random(most))
    rows = [(i % 40 or None, t, "mine") for i, t in enumerate(texts)] if most > 4000 else [(i, t, "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "'mine' as n_spans", "'mine' as spans").repartition(3)
    got = suffixes.remove_repeats(docs, most=most)
    assert got.columns == ["doc_id", "text", "key", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    want = sorted(((r[0], *w) for r, w in zip(rows, brute(texts))), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got.collect()), key=repr) == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_chunks_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [long, long[1000:7000], "zz" + long[2000:2600], "".join(rng.choice("abcdefgh ") for _ in range(5000))]
    pieces = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    whole = suffixes.anchored(pieces, ends)
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    cut = suffixes.anchored(pieces, ends)
    # chunks only cut pieces: each window has the anchor it had
    for a, b in ((whole, cut),):
        one, other = (np.concatenate([np.stack([s + np.arange(n), np.full(n, p)]) for s, n, p, _ in x.T], axis=1) for x in (a, b))
        assert (one == other).all()


@pytest.mark.parametrize("seed", range(40))
def test_column_wise(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab" if seed % 3 else b"abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
    strings += [strings[0][3:]] * (seed % 4)
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    depth = rng.choice([5, 20, 254])
    transform, common = column_wise(data, np.cumsum(sizes) - sizes, sizes, np.zeros(len(strings), int), depth)
    ordered = sorted(s[k:] for s in strings for k in range(len(s) + 1))
    shared = [0]
    for a, b in zip(ordered, ordered[1:]):
        shared.append(min(depth, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))))
    assert common.tolist() == shared
    for length, (who, places) in enumerate(walk(transform, len(strings))):
        assert [ordered[p] for p in places] == [strings[w][len(strings[w]) - length:] for w in who]
