"""The pipeline's stages in turn against brute force over the smallest table."""

import base64

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from brute import SPACE_WORDS, decontamination, near_duplicates, quality, sha
from conftest import DATA

from hitprism.llm import queries


def without_repeated_lines(docs, size=3):
    first, out = {}, {}
    for d, t in sorted(docs.items()):
        own = t.split("\n")
        for i in range(len(own) - size + 1):
            first.setdefault(tuple(own[i : i + size]), (d, i))
    for d, t in docs.items():
        own, gone = t.split("\n"), set()
        for i in range(len(own) - size + 1):
            w = tuple(own[i : i + size])
            if SPACE_WORDS.search("\n".join(w)) and first[w] < (d, i):
                gone |= set(range(i, i + size))
        out[d] = "\n".join(line for i, line in enumerate(own) if i not in gone)
    return out


def test_pipeline(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    docs = {r[0]: r[1] for r in table if not quality(r[1])[-1]}  # no host of these is bad
    docs = without_repeated_lines(docs)
    near = near_duplicates(docs.items())
    docs = {d: t for d, t in docs.items() if near[d][1] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = decontamination(docs.items(), items)
    docs = {d: t for d, t in docs.items() if not hit[d][-1]}
    assert 0 < len(docs) < len(table)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs.items():
        ids = enc.encode_ordinary(t)
        want[d] = (d, len(ids), sha(" ".join(map(str, ids))), sha(t))
    found = corpus_pipeline.run(spark, str(DATA)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want.values())


SCHEMA = "doc_id long, text string, source string, n_words long, kept string, n_removed string, fingerprint string, items string, _row string"
LONG = " ".join(f"word{i}" for i in range(40_000))
GOOD = " ".join(f"plain{i}" for i in range(60))
ROWS = [(1, None, "a"), (2, "", "a"), (3, GOOD, "a"), (3, GOOD, "a"), (4, GOOD + " more", None), (5, LONG, "b"), (None, GOOD + " x", "b"),
        (6, "a b c " * 30, "c"), (7, "\n".join(f"line{i} has{i} four{i} words{i}" for i in range(9)), "c")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, -7, "mine", "r", "f", "i", "own") for r in rows], SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_keeps_all_columns(spark, name):
    docs = table(spark)
    got = stage(name)(spark, docs, str(DATA))
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert {tuple(r)[3:] for r in got.collect()} == {(-7, "mine", "r", "f", "i", "own")}
    assert stage(name)(spark, docs.limit(0), str(DATA)).collect() == []


def test_stages_alone(spark):
    docs = table(spark)
    assert ids(stage("quality_rules")(spark, docs, str(DATA))) == sorted([3, 3, 4, 5, 7, None], key=str)
    lines = stage("line_dedup")(spark, docs, str(DATA))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in lines.collect()))) == sorted(map(repr, ((i, t) for i, t, _ in ROWS)))
    near = stage("near_duplicates")(spark, docs, str(DATA))
    assert ids(near) == sorted([1, 3, 3, 5, 6, 7, None], key=str)
    assert ids(stage("benchmark_decontamination")(spark, docs, str(DATA))) == ids(docs)


def test_repeated_lines_and_passages_go(spark, tmp_path):
    lines = [f"line number {i} is long enough" for i in range(6)]
    docs = table(spark, [(1, "\n".join(lines), "a"), (2, "\n".join(["own", *lines[:3], "end"]), "a"), (2, "other\n" + "\n".join(lines[2:5]), "a")])
    got = {(r.doc_id, r.text) for r in stage("line_dedup")(spark, docs, str(DATA)).collect()}
    assert got == {(1, "\n".join(lines)), (2, "own\nend"), (2, "other")}
    passage = " ".join(f"bench{i}" for i in range(15))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # the rule's tie: 15 of 300 words are one in 20
    docs = table(spark, [(1, passage, "a"), (2, passage + " and" * 285, "a"), (3, passage + " and" * 286, "a"), (4, None, "a")])
    assert ids(stage("benchmark_decontamination")(spark, docs, str(tmp_path))) == [3, 4]


def test_last_stage(spark):
    got = stage("byte_bpe")(spark, table(spark), str(DATA))
    assert sorted(map(str, ((r.doc_id, r.decoded_sha256) for r in got.collect()))) == sorted(map(str, ((i, sha(t or "")) for i, t, _ in ROWS)))
    assert stage("byte_bpe")(spark, table(spark).limit(0), str(DATA)).collect() == []


def test_encoding_and_decoding_are_never_in_one_task(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    for got in (stage("byte_bpe")(spark, table(spark), str(DATA)), queries.byte_bpe(spark, str(tmp_path))):
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(str, ((r.doc_id, r.decoded_sha256) for r in got.collect()))) == sorted(map(str, ((i, sha(t or "")) for i, t, _ in ROWS)))
