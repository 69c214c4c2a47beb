"""Each query over a whole small table against brute force or its library."""

import base64
import zlib

import public_tokenizers
import pytest
import tiktoken
from brute import (
    decontamination, lines, lm_base, near_duplicates, quality, sha, substrings, url_verdict,
)
from conftest import DATA
from tokenizers import Tokenizer

from hitprism.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def by_id(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select("doc_id", *columns).collect()}


def test_url_filters(spark):
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    found = {r[0]: tuple(r)[1:] for r in q.url_filters(spark, DATA).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert found == {p: url_verdict(u, q.URL_RULES) for p, u in pages.items()}


def test_byte_bpe(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(enc.decode_bytes(ids)))
    assert by_id(q.byte_bpe(spark, DATA), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_decontamination(spark, docs):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    found = by_id(q.benchmark_decontamination(spark, DATA), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = decontamination(docs, items)
    assert found == want
    assert any(v[-1] for v in want.values())


def test_simhash(spark, docs):
    want = near_duplicates(docs)
    assert by_id(q.simhash_near_dedup(spark, DATA), "fingerprint", "component_id") == want
    assert any(d != c for d, (_, c) in want.items())


def test_quality(spark, docs):
    found = by_id(q.quality_rules(spark, DATA), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {d: v[:-1] for d, v in found.items()} == {d: quality(t) for d, t in docs}
    assert all(kept == (not failed) for *_, failed, kept in found.values())  # no host of these is bad


def test_token_file(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for d, t in sorted(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [q.END_ID]
        want[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert by_id(q.token_id_output(spark, DATA), "start", "n_tokens", "ids_crc32") == want


def test_substrings(spark, docs):
    want = substrings(docs)
    assert by_id(q.substring_dedup(spark, DATA), "n_words", "n_removed", "kept_sha256") == want
    assert any(v[1] for v in want.values())


def test_lines(spark, docs):
    assert by_id(q.line_dedup(spark, DATA), "n_lines", "n_removed", "text_sha256") == lines(docs)


def test_lm(spark, docs):
    found = by_id(q.lm_scoring(spark, DATA), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = lm_base(docs)
    assert {d: v[:4] for d, v in found.items()} == {d: v[:4] for d, v in want.items()}
    for d, v in want.items():
        assert found[d][4] == pytest.approx(v[4], rel=1e-9)
    held = [v for v in found.values() if v[0]]
    assert sum(v[5] for v in held) > sum(v[4] for v in held)  # better than unigrams on what it has not seen
