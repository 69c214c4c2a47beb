"""The model's score against exact counts, with many filter segments."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOWER, SPACE_WORDS, lm_base
from conftest import DATA

from hitprism.llm import lm, stored


def exact_scores(docs):
    """{doc_id: score} with levels of exact counts: a filter without false positives."""
    tokens = {d: SPACE_WORDS.findall((t or "").translate(LOWER)) + [None] for d, t in docs}
    train = [own for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    words = Counter(w for own in train for w in own)
    pairs = Counter(p for own in train for p in zip([None, *own], own))
    total = sum(words.values()) + len(words) + 1
    out = {}
    for d, own in tokens.items():
        out[d] = 0.0
        for p in zip([None, *own], own):
            low = 1 << pairs[p].bit_length() >> 1
            share = min(1, low / words[p[0]]) if words[p[0]] else 0
            out[d] += math.log10(lm.WEIGHT * share + (1 - lm.WEIGHT) * (words[p[1]] + 1) / total)
    return out


def test_score_keeps_its_accuracy_in_many_segments(spark, monkeypatch):
    # a corpus far beyond any fixed size of the filter, in small: entries are
    # many for the bytes that a cap would leave
    monkeypatch.setattr(lm, "MOST_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = exact_scores([tuple(r) for r in table.collect()])
    found = {r.doc_id: r for r in lm.score(table).collect()}
    assert found.keys() == want.keys()
    # a false positive, about one in a hundred lookups, raises a token by some digits
    n = sum(r.n_tokens for r in found.values())
    off = sum(abs(r.score - want[d]) for d, r in found.items()) / n
    assert off < 0.05, off


@pytest.mark.parametrize("head", [0, 40])
def test_small_bounds_and_a_bigram_in_all_texts(spark, monkeypatch, head):
    # many words tie at the bound of the frequent ones; entries are sent and looked up a few at a time
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lm, "MERGED", 50)
    monkeypatch.setattr(lm, "AT_ONCE", 7)
    rows = [(i, f"same words again {'tie' + str(i % 30)} {'tie' + str(i % 30)} rare{i}") for i in range(300)]
    found = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = exact_scores(rows)
    base = lm_base(rows)
    for d, r in found.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == base[d][:4]
        assert r.base_score == pytest.approx(base[d][4], rel=1e-9)
    assert sum(abs(r.score - want[d]) / r.n_tokens for d, r in found.items()) / len(rows) < 0.2


def test_entries_are_added_up_some_shards_at_a_time():
    rng = np.random.default_rng(3)
    held = [np.unique(rng.integers(0, 1 << 64, 3000, np.uint64) >> np.uint64(k) << np.uint64(k), return_counts=True) for k in (40, 52, 53)]
    for shards in (1, 2, 5, 8, 11, 3000):
        parts = list(lm._added_by_shards(held, shards))
        whole = lm._added(*(np.concatenate(x) for x in zip(*held)))
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts), whole))
        used = [set(lm._shard(grams, shards).tolist()) for grams, _ in parts]
        assert sum(map(len, used)) == len(set.union(*used))
        assert shards < 8 or len(parts) == lm.SHARD_GROUPS


def test_a_segment_is_built_some_entries_at_a_time(monkeypatch):
    low = np.arange(1000, dtype=np.uint32).repeat(3)
    n = np.arange(3000, dtype=np.uint32) % 700 + 1
    top, bits = lm._segment(low, n)
    real, most = lm._places, []
    monkeypatch.setattr(lm, "AT_ONCE", 64)
    monkeypatch.setattr(lm, "_places", lambda low, level, size: most.append(len(low)) or real(low, level, size))
    assert lm._segment(low, n) == (top, bits)
    assert 0 < max(most) <= 64
    levels = lm._levels(np.arange(1000, dtype=np.uint32), np.frombuffer(bits, np.uint8), top)
    assert (levels >= np.frexp(n.reshape(-1, 3).sum(axis=1))[1]).all()


def test_scoring_takes_small_batches_and_leaves_the_setting(spark, monkeypatch):
    key, found, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], stored.shared_table
    monkeypatch.setattr(stored, "shared_table", lambda df, name: found.append(spark.conf.get(key)) or real(df, name))
    before = spark.conf.get(key)
    lm.score(spark.createDataFrame([(1, "a b a b"), (2, None)], "doc_id long, text string")).collect()
    assert set(found) == {str(lm._BATCH_BYTES)} and spark.conf.get(key) == before
