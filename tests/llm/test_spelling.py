"""Spelling variants against trying all words one code point away."""

import random
import zlib
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from hitprism.llm import queries as q
from hitprism.llm import spelling as s


def brute(counts):
    """{word: (form, root, n, n_near, form_n)}"""
    letters = sorted(set("".join(counts)))
    near, form = {}, {}
    for w in counts:
        other = {w[:i] + w[i + 1:] for i in range(len(w))}
        other |= {w[:i] + a + w[i + k:] for i in range(len(w) + 1) for a in letters for k in (0, 1)}
        near[w] = [v for v in other if v in counts and v != w]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def runs(text):
    out, now = [], ""
    for c in text + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_brute_force(spark):
    counts = Counter()
    for doc, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        for w in runs(text or ""):
            h = zlib.crc32(f"{doc}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert found(q.spelling_variants(spark, DATA)) == want
    assert any(form for form, *_ in want.values())


@pytest.mark.parametrize("letters, size, most", [("ab", 1 << 20, 1 << 20), ("abcé", 1 << 20, 40), ("abcdefgh", 1600, 150)])
def test_small_alphabets_and_small_shards(spark, letters, size, most):
    # many words share a half; small bounds cut shards in indexes and blocks
    rng = random.Random(size + most)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(400)}
    counts = {w: rng.randint(1, 40) for w in words}
    rows = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    assert found(s.group_variants(rows, least_length=1, least_count=1, size=size, most=most)) == brute(counts)


def test_edges(spark):
    long = "é" * 3000
    texts = [(1, None, "x"), (2, "", "x"), (None, "Abcde abcde ABCDÉ", "x"), (3, "abcde abcdf abcdf", "x"), (3, "abcde abcdf abcdf", "x"),
             (4, f"{long} {long}\t{long}", "x"), (5, "12 ,; 李", "x"), (6, "× Äbcde × Äbcde Äbcde", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, word string")
    words = s.document_words(docs).select("word", F.lit("mine").alias("n"), F.lit("mine").alias("near"))
    counts = Counter()
    for doc, text, _ in texts:
        for w in runs(text or ""):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    got = found(s.group_variants(words))
    assert got == brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert got["abcde"][3] == 2 and got["abcdf"][0] is None and long in got
    assert s.group_variants(words.limit(0)).count() == 0
    assert s.group_variants(spark.createDataFrame([(None,)], "word string")).count() == 0
