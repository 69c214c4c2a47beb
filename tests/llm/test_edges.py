"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import json

import pytest
from brute import quality, sha, substrings, url_verdict

from hitprism.llm import bpe, coder, components, decontamination, linededup, lm, pii, quality as rules, simhash, substrings as repeats
from hitprism.llm import tokenfile, urls
from hitprism.llm.queries import URL_RULES, byte_tokenizer

SCHEMA = "doc_id long, text string, source string"
LONG = "wörd one\ttwo  three\n" * 3000
ROWS = [(1, None, "a"), (2, "", "a"), (None, "no id here", None), (3, LONG, "a"), (4, LONG, "b"), (4, LONG, "b"),
        (5, " \n\n\n ", "b"), (6, "x\ny\nz\nx\ny\nz", None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.selectExpr("*", *[f"'mine' as {n}" for n in names])


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_urls(spark):
    long = "http://" + "a." * 3000 + "example.org/es/" + "x" * 5000
    addresses = [None, "", "no address", "://", "http://Sub.Example.ORG/es/1?x", "http://example.org", "http://notexample.org/es/",
                 "http://a.com/de/", "http://com/fr/#y", "http://x.org/", long, "http://x.org/", "a://b://c", "http://example.org/en/12"]
    pages = clashing(spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "page_id long, url string"), "host", "point", "key", "range")
    table = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urls.filter_urls(pages, table)
    assert found(got, "page_id", "host", "path", "rule", "verdict") == sorted(
        ((i, *url_verdict(a, URL_RULES)) for i, a in enumerate(addresses)), key=repr)
    assert got.columns == ["page_id", "url", "point", "key", "range", "host", "path", "rule", "verdict"]
    assert urls.filter_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, table.limit(0), default="block").collect()} == {"block"}


def test_nested_rules_over_many_ranges(spark):
    rules = [("org", "/", "allow"), ("b.org", "/", "block"), ("b.org", "/p/", "allow"), ("a.b.org", "/p/q/", "block"), ("", "/z", "block")]
    addresses = [f"http://{h}/{p}{i}" for h in ("c.org", "b.org", "x.b.org", "a.b.org", "", "net") for p in ("", "p/", "p/q/", "z") for i in range(40)]
    pages = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "page_id long, url string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = found(urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id", "rule", "verdict")
    finally:
        spark.conf.set(key, "true")
    assert got == sorted(((i, *url_verdict(a, rules)[2:]) for i, a in enumerate(addresses)), key=repr)


def test_bpe(docs, nothing):
    tokenizer = byte_tokenizer()
    ids = bpe.encode(clashing(docs, "ids", "decoded"), tokenizer, offsets=True)
    back = bpe.decode(ids, tokenizer).withColumn("again", bpe.decoded_text(bpe.F.col("decoded")))
    for r in back.collect():
        assert r.again == (r.text or "")
        assert len(r.starts) == len(r.ends) == len(r.ids)
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(r.text)
    assert bpe.decode(bpe.encode(nothing, tokenizer), tokenizer).count() == 0


def test_split_characters(spark):
    tokenizer = byte_tokenizer()
    whole = bpe.encode(spark.createDataFrame([(1, "a𝕏")], "doc_id long, text string"), tokenizer, offsets=True)
    row = bpe.decode(whole, tokenizer).first()
    assert row.n_split == len(row.ids) - 2 > 0
    assert set(zip(row.starts[1:], row.ends[1:])) == {(1, 2)}
    cut = bpe.decode(whole.selectExpr("slice(ids, 1, size(ids) - 1) as ids"), tokenizer)
    text = cut.select(bpe.decoded_text(bpe.F.col("decoded"))).first()[0]
    assert text[0] == "a" and set(text[1:]) == {"\ufffd"}


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, None), (None, "wörd one"), (2, ""), (3, "NO id"), (3, "NO id")], "item_id long, text string")
    got = decontamination.judged(clashing(docs, "spans", "items"), items)
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[None, None]["items"] == ["3"] and by[None, None].n_hit == 2 and by[None, None].contaminated
    assert by[3, "a"].n_hit == 6000 and by[3, "a"]["items"] == [""]
    assert by[1, "a"].n_words == by[2, "a"].n_hit == 0 and not by[1, "a"].contaminated
    assert decontamination.judged(nothing, items).count() == 0
    assert not any(r.n_hit for r in decontamination.judged(docs, items.limit(0)).collect())


def test_decontamination_with_a_full_filter(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["x y z", "wörd one two", "three wörd", "no id"])], "item_id long, text string")
    whole = found(decontamination.judged(docs, items), "doc_id", "n_hit", "items")
    monkeypatch.setattr(decontamination, "_filter", lambda prints: __import__("numpy").full(decontamination.FILTER_BITS // 8, 255, "uint8"))
    assert found(decontamination.judged(docs, items), "doc_id", "n_hit", "items") == whole


def test_simhash(docs, nothing):
    got = found(simhash.near_duplicates(clashing(docs, "fingerprint", "root")), "doc_id", "component_id")
    assert len(got) == len(ROWS)
    assert {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (None, None)} <= set(got)
    assert simhash.near_duplicates(nothing).count() == 0


def test_linked_fingerprints_equal_all_pairs(spark):
    import random

    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(20)]
    values = set()
    for c in centres:
        for _ in range(12):
            values.add(c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))))
    values = sorted(values)
    parent = {v: v for v in values}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    table = spark.createDataFrame([(signed[v],) for v in values], "fingerprint long")
    got = {r.fingerprint: r.root for r in simhash.linked_fingerprints(table).collect()}
    want = {}
    for v in values:
        want.setdefault(root(v), set()).add(signed[v])
    assert got == {v: min(group) for group in want.values() for v in group}


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    assert {r.root for r in components.components(links).collect()} == {0}


def test_quality(spark, docs, nothing):
    for r in rules.judge(clashing(docs, "n_words", "host", "kept"), keep_text=True).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(r.text)
        assert not (r.base_failed and r.kept)
    assert rules.judge(nothing).count() == 0


def test_bad_host_loses_its_good_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "few words"
    table = [(i, good if i % 10 else bad, f"h{i % 8}") for i in range(800)] + [(1000 + i, bad if i < 90 else good, "spam") for i in range(100)]
    kept = rules.judge(spark.createDataFrame(table, SCHEMA)).where("kept").select("source").distinct()
    assert {r.source for r in kept.collect()} == {f"h{i}" for i in range(8)}


def brute_judgement(rows):
    """{doc_id: (base_failed, kept)} by the rules and host rates in plain Python."""
    measures = {i: quality(t) for i, t, _ in rows}

    def fails(i, text):
        words, _, symbols, dup, repeat, _ = measures[i]
        lines = [line for line in (text or "").split("\n") if line.split()]
        return [words < 20, 100 * repeat > 30 * words, 10 * symbols > words, 100 * dup > 30 * len(lines)]

    hosts = {}
    for i, t, h in rows:
        if h is not None:
            hosts.setdefault(h, []).append(fails(i, t))
    bad = set()
    for rule in range(4):
        shares = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(shares.values()) / len(shares)
        variance = sum((s - mean) ** 2 for s in shares.values()) / len(shares)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        true = max(variance - mean * (1 - mean) * sum(1 / len(fs) for fs in hosts.values()) / len(hosts), 1e-6)
        weight = min(max((mean * (1 - mean) - true) / true, 1), 1e4)
        bad |= {h for h, fs in hosts.items() if (sum(f[rule] for f in fs) + mean * weight) / (len(fs) + weight) > rules.MAX_HOST_RATE}
    return {i: (measures[i][-1], not measures[i][-1] and h not in bad) for i, t, h in rows}, bad


@pytest.mark.parametrize("seed", range(3))
def test_judgement_equals_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    good = [" ".join(f"w{rnd.randint(0, 999)}" for _ in range(30)) for _ in range(20)]
    bad = ["few words", " ".join(["# $ %", *good[0].split()[:25]]), "\n".join(good[1].split()[:9] * 4), "same words again and again here now " * 9]
    table = []
    for h in range(12):
        rate = rnd.choice([0, 0.05, 0.1, 0.6, 1])
        for _ in range(rnd.randint(1, 60)):
            table.append((len(table), rnd.choice(bad) if rnd.random() < rate else rnd.choice(good), f"h{h}"))
    table += [(len(table) + i, bad[0] if i < 24 else good[i % 20], "bad") for i in range(30)]
    table += [(len(table), good[0], None), (len(table) + 1, None, None), (len(table) + 2, None, "h0")]
    want, rejected = brute_judgement(table)
    found = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()}
    assert found == want
    assert rejected and any(not failed and not kept for failed, kept in want.values())


def test_token_file(spark, docs, nothing, tmp_path):
    import public_tokenizers

    tokenizer = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    for name, table in (("some", docs), ("none", nothing)):
        tokenfile.write_token_file(table, str(tmp_path / name), tokenizer, end_id=1)
        got = tokenfile.read_token_file(spark, str(tmp_path / name)).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((r[0] for r in table.collect()), key=lambda i: (i is not None, i or 0))
        assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in got)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 7000])
def test_coder_round_trip_and_damage(n):
    import numpy as np

    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.2, n) % 500, np.full(n, 65535)):
        data = coder.pack(ids)
        assert (coder.unpack(data) == ids).all()
        if n:
            broken = bytearray(data)
            broken[12] ^= 1  # a checksum
            with pytest.raises(ValueError):
                coder.unpack(bytes(broken))
            with pytest.raises(ValueError):
                coder.unpack(data[:-4])


def test_coder_blocks_are_checked_and_reset():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = rng.zipf(1.2, 2 * coder.BLOCK + 1500) % 3000
    data = coder.pack(ids)
    assert (coder.unpack(data) == ids).all()
    for at in range(8, 8 + 4 * 3):  # the three blocks' checksums
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            coder.unpack(bytes(broken))
    # a block's words do not depend on the blocks before it
    alone = coder.pack(ids[2 * coder.BLOCK :])
    assert data.endswith(alone[8 + 4 + 2 * 2 :])


def test_coder_beats_plain_means():
    import zlib

    import numpy as np
    import public_tokenizers
    import pyarrow.parquet as pq
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids = np.concatenate([e.ids + [1] for e in tokenizer.encode_batch(texts[:1000], add_special_tokens=False)])
    bits = 8 * len(coder.pack(ids)) / len(ids)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert bits < -(share * np.log2(share)).sum()
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 6)) / len(ids)


def test_coder_ranges_at_word_boundaries():
    import numpy as np

    low = np.array([0xD826B76800000000, 0xD826B76800000000, 0xD826B767FFFFFFFF, 0], np.uint64)
    span = np.array([1 << 32, (1 << 32) - 1, 5, (1 << 64) - 1], np.uint64)
    move, left = coder._settle(low, span)
    assert move.tolist() == [False, True, True, False]
    assert left.tolist() == [1 << 32, (1 << 32) - 1, 1, (1 << 64) - 1]


def test_words_end_at_spaces_and_punctuation():
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(text)
    rnd = random.Random(2)
    parts = ["a", "B", "é", "Σ", "'s", "'", "'LL", ".", ",", " ", "\n", "\x0b", "\u0301", "\u0338", ">", "<|endoftext|>", "9", "\u3000", "K", "_", "\x00"]
    texts = ["", *("".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(3000))]
    ids, sizes = bpe.Encoder(text, spaces=False, apart=True)(pa.array([None, *texts]).slice(1))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_are_those_of_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(text)
    texts = ["one two<|endoftext|> three", "<|ENDOFTEXT|> a", "<|endoftext|>", "plain, text", "x<|startoftext|><|endoftext|>y", "< |endoftext|>", "", "one two"]
    encoder = bpe.Encoder(text, spaces=False, apart=True)
    for order in (texts, texts[::-1], texts):  # remembered or not
        ids, sizes = encoder(pa.array(order))
        want = [library.encode(t, add_special_tokens=False).ids for t in order]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert library.encode(texts[0], add_special_tokens=False).ids == [637, 1237, 49407, 2097]


class Recorded:
    """A tokenizer that takes down the pieces it encodes as texts, and the words its model gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.pieces, self.words, self.model = tokenizer, [], [], self

    def encode_batch_fast(self, pieces, add_special_tokens):
        self.pieces += pieces
        return self.tokenizer.encode_batch_fast(pieces, add_special_tokens=add_special_tokens)

    def tokenize(self, word):
        self.words.append(word)
        return self.tokenizer.model.tokenize(word)


def test_plain_words_skip_normalizer_and_splitting():
    import public_tokenizers
    import pyarrow as pa

    encoder = bpe.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), spaces=False, apart=True)
    library, encoder.tokenizer = encoder.tokenizer, Recorded(encoder.tokenizer)
    texts = ["Plain words, ÀÉÎ straße.é üb", "x" * 300, "don't a1 \u4e2d e\u0301 ×÷ \u00c3", "ñÑ;ÿ#ß\n\u0130I", "plain words"]
    ids, sizes = encoder(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sorted(encoder.tokenizer.words) == sorted("".join(bpe.byte_characters()[b] for b in w.encode())
                                                     for w in ["plain", "words", "àéî", "straße", "é", "üb", "ñÑ".lower(), "ÿ", "ß", "ã"])
    assert not any(p.isalpha() and p.isascii() and len(p) < 300 for p in encoder.tokenizer.pieces)
    # not where the splitting makes more of a word, nor where a word is an added token
    changed = json.loads(library.to_str())
    changed["pre_tokenizer"]["pretokenizers"].insert(0, {"type": "Split", "pattern": {"String": "e"}, "behavior": "Isolated", "invert": False})
    assert not bpe.Encoder(json.dumps(changed), spaces=False, apart=True).words
    library.add_tokens(["plain"])
    added = bpe.Encoder(library.to_str(), spaces=False, apart=True)
    assert not added.words
    assert added(pa.array(["explain plain"]))[0].tolist() == library.encode("explain plain", add_special_tokens=False).ids


def test_words_that_come_again_are_remembered(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    monkeypatch.setattr(bpe, "MOST_BYTES", 100_000)
    encoder = bpe.Encoder(text, spaces=False, apart=True)
    library, encoder.tokenizer = encoder.tokenizer, Recorded(encoder.tokenizer)
    letters = "abcdefghij"
    for i in range(10):  # more words than there is room for, some of them again and again
        words = ["again", "and", "again"] + [f"{a}{b}{c}{letters[i]}" for a in letters for b in letters for c in "xyz"]
        for t in (" ".join(words), "and again, and"):
            assert encoder(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert encoder.bytes < 200_000 and len(encoder.slots) < 1000
    tried = encoder.tokenizer.pieces + encoder.tokenizer.words
    assert tried.count("again") == tried.count("and") == 1 and tried.count("aaxa") == 1


def test_coder_guesses_of_few_ids():
    import numpy as np

    rng = np.random.default_rng(5)
    for few in ([0, 1], [0, 65535], [0], [7, 0, 9, 65535]):
        for n in (1025, 70_000):
            ids = np.where(rng.random(n) < 0.9, np.resize(few, n), rng.choice(few, n))
            assert (coder.unpack(coder.pack(ids)) == ids).all()


def test_decoding_takes_few_ids_at_once_and_no_tokenizer(spark, monkeypatch):
    tokenizer, sizes = byte_tokenizer(), []
    texts = ["aé \U0001F525", None, "", "one two three four five six seven", "x", "𝕏 y"] * 4
    ids = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tokenizer).select("doc_id", "ids")
    whole = sorted(map(tuple, bpe.decode(ids, tokenizer).collect()))
    monkeypatch.setattr(bpe, "SLICE_IDS", 5)
    monkeypatch.setattr(bpe, "map_partitions", lambda df, run, schema: (run, schema))
    run, schema = bpe.decode(ids, tokenizer)
    monkeypatch.setattr("tokenizers.Tokenizer.from_str", None, raising=False)
    found = [row for b in run(iter(ids.toArrow().to_batches())) for row in b.to_pylist() if sizes.append(b) or True]
    assert sorted((r["doc_id"], r["ids"], r["decoded"], r["n_split"]) for r in found) == [(d, i, bytes(b), n) for d, i, b, n in whole]
    distinct = {id(b): b for b in sizes}.values()
    assert len(distinct) > 1 and all(b.num_rows == 1 or sum(len(i) for i in b["ids"].to_pylist()) <= 5 for b in distinct)


def test_encoder_memory_is_bounded_by_bytes():
    import subprocess
    import sys

    code = """
import random, resource
import pyarrow as pa
from hitprism.llm import bpe
from hitprism.llm.queries import byte_tokenizer
rnd = random.Random(1)
encoder = bpe.Encoder(byte_tokenizer())
encoder(pa.array(["warm up"]))
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
for _ in range(50):
    encoder(pa.array(["".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(250)) for _ in range(800)]))
print(peak() - before, encoder.bytes)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600, cwd=str(__import__("pathlib").Path(bpe.__file__).parents[2]))
    grown, remembered = map(float, out.stdout.split())
    assert grown < 300 and remembered <= bpe.MOST_BYTES


def test_substrings(docs, nothing):
    want = substrings([(i, t) for i, t, _ in ROWS])
    got = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in repeats.remove_repeats(clashing(docs, "n_words", "_x")).collect()}
    assert got == want and got[4][1] == got[4][0] and got[3][1] == 0
    assert repeats.remove_repeats(nothing).count() == 0


def test_passages_at_any_offset(spark):
    import random

    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 75, 130)]
    table = []
    for i in range(60):
        text = words(rnd.randrange(80))
        for s in rnd.sample(shared, 2):
            text += s + words(rnd.randrange(3))
        table.append((i, " ".join(text)))
    got = repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in got.collect()} == substrings(table)


def test_lines(docs, nothing):
    got = {(r.doc_id, r.source): (r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(clashing(docs, "n_lines", "_key_")).collect()}
    assert got[1, "a"] == (0, 0, None) and got[2, "a"] == (1, 0, "") and got[5, "b"] == (4, 0, ROWS[6][1])
    assert got[6, None] == (6, 3, "x\ny\nz")
    assert got[4, "b"][1] == 3001 and got[4, "b"][2] == "" and got[3, "a"][1] == 2999
    assert linededup.dedup_lines(nothing).count() == 0


def test_lm(docs, nothing):
    got = lm.score(clashing(docs, "row", "word", "n")).collect()
    assert len(got) == len(ROWS)
    assert all(r.n_tokens >= 1 and r.score <= 0 for r in got)
    assert lm.score(nothing).count() == 0


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pii(spark, nothing):
    import re

    texts = ["card 4337 1665 9846 4399, again 4337166598464399.", "not 4337166598464390", "call +1 (988) 555-2485 or 988-555-2485",
             "ip 42.144.35.254. and 300.1.1.1", "born 1984-02-29, 31/12/1999, 2023-02-30", "ssn 123-45-6789 000-12-3456",
             "mail bosbt.42@mail8.example.com", None, "", "a" * 100_000 + "@" + "1" * 100_000]
    table = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "n_found", "_m")
    got = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymise(table, "k").collect()}
    assert [got[i][1] for i in range(len(texts))] == [2, 0, 2, 1, 2, 1, 1, 0, 0, 0]
    shape = lambda t: re.sub(r"\d", "9", t)
    for i in (0, 2, 4, 5):
        assert got[i][0] != texts[i] and shape(got[i][0]) == shape(texts[i])
    cards = re.findall(r"\d[\d ]{14,}\d", got[0][0])
    assert all(map(luhn, cards)) and cards[0].replace(" ", "") == cards[1]
    assert got[1][0] == texts[1] and got[7][0] is None and got[8][0] == "" and got[9][0] == texts[9]
    phones = re.findall(r"\d{3}\)? ?-?\d{3}-\d{4}", got[2][0])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    assert got[3][0].endswith(" and 300.1.1.1") and "2023-02-30" in got[4][0] and "000-12-3456" in got[5][0]
    assert got[6][0] != texts[6] and got[6][0].endswith("@mail8.example.com")
    assert pii.pseudonymise(nothing, "k").count() == 0


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(0, 146097).selectExpr("id as doc_id", "date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    got = pii.pseudonymise(days, "k").selectExpr("count(distinct text)", "min(text)", "max(text)").first()
    assert tuple(got) == (146097, "1800-01-01", "2199-12-31")
