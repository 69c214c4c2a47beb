"""Removal of word passages that an earlier document has too.

A window is ``WINDOW`` consecutive words. Every document is cut into blocks of
``BLOCK`` = WINDOW / 2 words that do not overlap; a window of any place holds
one whole block of the document it is found in. The blocks are the index. It is
probed with every rolling window of ``BLOCK`` words, and probes that hit are
extended: all windows of ``WINDOW`` words around a hit, and around the block that
was hit, are compared with each other by a 128-bit hash, and those that also
start in a document with a smaller id are covered. Runs of covered windows are
the maximal exact repeats.

Most text occurs once, so two steps keep it away from index and probes. A
document whose words repeat an earlier document's altogether is covered whole.
Elsewhere, of every ``WINDOW - BLOCK + 1`` rolling hashes the smallest is kept
as a sample; windows whose sample no other document has cannot repeat.

No step pairs documents: each hash is reduced to the smallest id that has it,
which also holds for passages that very many documents share.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import (
    Words, covered, full_windows, map_batches, mixed, per_text_sum, sliding, text_slices, window_hashes,
)
from hitprism.llm.stored import stored

WINDOW = 50
BLOCK = WINDOW // 2
_FACTOR_1, _FACTOR_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SAMPLE_OF = WINDOW - BLOCK + 1


def _word_hashes(words):
    """A 64-bit hash of each word, by its 128-bit hash."""
    unique = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.unique.to_pylist()), np.uint64, len(words.unique))
    return unique[words.codes]


def _signed(values):
    return pa.array(values.view(np.int64))


def _lists(values, sizes):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


class _Rolling:
    """Rolling hashes of a slice of texts."""

    def __init__(self, texts):
        self.words = Words(texts)
        self.values = _word_hashes(self.words)
        n = len(self.values)
        self.block = window_hashes(self.values, BLOCK, _FACTOR_1) if n else self.values
        self.whole = full_windows(self.words, WINDOW)
        self.sample = sliding(self.block, _SAMPLE_OF, np.minimum) if n else self.values


def _samples(docs):
    """Per document: the hash of all its words (two longs; null where it has no
    window), and its samples, neighbours that are equal once."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
                           T.StructField("all_1", T.LongType()), T.StructField("all_2", T.LongType()),
                           T.StructField("samples", T.ArrayType(T.LongType()))])

    def run(batch):
        for rows in text_slices(batch, "text"):
            roll = _Rolling(rows.column("text"))
            words = roll.words
            texts = words.joined()[0]
            sums = [divmod(xxhash.xxh3_128_intdigest(t.as_buffer()), 1 << 64) if n >= WINDOW else None
                    for t, n in zip(texts, words.n)]
            halves = [pa.array([None if s is None else s[k] - (1 << 63) for s in sums], pa.int64()) for k in (0, 1)]
            at = np.flatnonzero(roll.whole)
            keys = np.stack([words.text_of_word()[at].astype(np.uint64), roll.sample[at]])
            fresh = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(at) else np.zeros(0, bool)
            found = roll.sample[at][fresh]
            sizes = np.bincount(keys[0][fresh].astype(np.int64), minlength=len(words.n))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), *halves, _lists(_signed(found), sizes)], names=schema.names)

    return map_batches(docs, run, schema)


def _candidates(docs):
    """Per document with windows that may repeat, hashes and their places:

    ``block``: index entries, each block at a multiple of ``BLOCK`` in a candidate
    window; ``probe``: each rolling window of ``BLOCK`` words in one; ``window_1``
    and ``window_2``: the candidate windows themselves.
    """
    names = ["block", "probe", "probe_at", "window_1", "window_2", "window_at"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType())]
                          + [T.StructField(c, T.ArrayType(T.LongType())) for c in names])

    def run(batch):
        for rows in text_slices(batch, "text"):
            roll = _Rolling(rows.column("text"))
            words, n = roll.words, len(roll.values)
            if not n:
                continue
            start = np.zeros(n, bool)
            for row in range(rows.num_rows):
                a, b = int(words.starts[row]), int(words.ends[row])
                known = rows.column("repeated")[row].values.to_numpy().view(np.uint64)
                start[a:b] = np.isin(roll.sample[a:b], known)
            start &= roll.whole
            probe = covered(np.flatnonzero(start), _SAMPLE_OF, n)
            place = np.arange(n) - np.repeat(words.starts, words.n)
            text, two = words.text_of_word(), [window_hashes(roll.values, WINDOW, f) for f in (_FACTOR_1, _FACTOR_2)]

            def of(chosen, values):
                at = np.flatnonzero(chosen)
                return _lists(pa.array(values[at].view(np.int64)), np.bincount(text[at], minlength=len(words.n)))

            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), of(probe & (place % BLOCK == 0), roll.block),
                 of(probe, roll.block), of(probe, place), of(start, two[0]), of(start, two[1]), of(start, place)],
                names=schema.names)

    return map_batches(docs, run, schema)


def _in_two(df, *keys):
    """The keys that more than one document has, and the smallest of these."""
    return (df.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            .where("first < last").drop("last"))


def covered_windows(docs):
    """Rows (doc_id, text_hash, places): starts of the windows that also start in
    a document with a smaller id; null places where that holds for all windows.
    ``docs``: doc_id, text, text_hash."""
    samples = stored(_samples(docs.where("doc_id IS NOT NULL")), "samples")

    # whole copies
    whole = samples.where("all_1 IS NOT NULL")
    copied = stored(_in_two(whole, "all_1", "all_2"), "copied")
    is_copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    marked = stored(whole.join(copied, ["all_1", "all_2"], "left").select(
        "doc_id", "text_hash", is_copy.alias("is_copy"), F.when(~is_copy, F.col("samples")).alias("samples")), "marked")

    # samples that two documents have
    each = marked.where("NOT is_copy").select("doc_id", "text_hash", F.explode("samples").alias("sample"))
    repeated = stored(_in_two(each, "sample").select("sample"), "repeated-samples")
    per_doc = each.join(repeated, "sample").groupBy("doc_id", "text_hash").agg(F.collect_set("sample").alias("repeated"))
    found = stored(_candidates(docs.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "repeated")), "candidates")

    # index, probes, hits
    index = found.select(F.explode("block").alias("hash")).distinct()
    probes = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("probe", "probe_at")).alias("p")).select(
        "doc_id", "text_hash", F.col("p.probe").alias("hash"), F.col("p.probe_at").alias("at"))
    live = stored(_in_two(probes, "hash").select("hash").join(index, "hash", "left_semi"), "hit-blocks")
    hits = probes.join(live, "hash").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("hits"))

    # extension
    windows = stored(_extended(found.join(hits, ["doc_id", "text_hash"]).select(
        "doc_id", "text_hash", "window_at", "window_1", "window_2", "hits")), "windows")
    first = stored(_in_two(windows, "w1", "w2"), "repeated-windows")
    later = windows.join(first, ["w1", "w2"]).where(F.col("first") < F.col("doc_id"))
    places = later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("places"))
    copies = marked.where("is_copy").select("doc_id", "text_hash").distinct()
    return places.union(copies.withColumn("places", F.lit(None).cast("array<bigint>")))


def _extended(found):
    """Candidate windows that hold a hit: (doc_id, text_hash, at, w1, w2)."""
    schema = "doc_id long, text_hash long, at long, w1 long, w2 long"

    def run(batch):
        out = []
        for row in range(batch.num_rows):
            at, w1, w2 = (batch.column(c)[row].values.to_numpy() for c in ("window_at", "window_1", "window_2"))
            hits = np.sort(batch.column("hits")[row].values.to_numpy())
            place = np.searchsorted(hits, at)
            near = place < len(hits)
            near[near] = hits[place[near]] < at[near] + _SAMPLE_OF
            out.append((np.full(near.sum(), row), at[near], w1[near], w2[near]))
        of, at, w1, w2 = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(of)), batch.column("text_hash").take(pa.array(of)),
             pa.array(at), pa.array(w1), pa.array(w2)], names=["doc_id", "text_hash", "at", "w1", "w2"])

    return map_batches(found, run, schema)


def remove_repeats(docs, doc_id="doc_id", text="text"):
    """Add ``n_words``, ``n_removed`` and ``kept_text``: the words not covered,
    joined by one space.

    A null text has no words and no kept text but the empty one; texts of fewer
    than ``WINDOW`` words lose nothing. Repeats within a document, or between rows
    with one id, are no repeats. A row without an id loses nothing and covers
    nothing. Columns of the added names are replaced, others stay.
    """
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in dict(added)]
    names = [f.name for f in kept]
    key = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]
    gone = covered_windows(docs.select(*key, F.col(text).alias("text")))
    gone = gone.select(F.struct("doc_id", "text_hash").alias("_of"), F.col("places").alias("_places"))
    joined = docs.select(*names, F.struct(*key).alias("_key"))
    joined = joined.join(gone, [F.col(f"_key.{c}") == F.col(f"_of.{c}") for c in ("doc_id", "text_hash")], "left")
    joined = joined.select(*names, F.col("_of").isNotNull().alias("_hit"), "_places")
    schema = T.StructType(kept + [T.StructField(*f) for f in added])

    def run(batch):
        for rows in text_slices(batch, text):
            words = Words(rows.column(text))
            starts = [np.zeros(0, np.int64)]
            for row in np.flatnonzero(rows.column("_hit").to_numpy(zero_copy_only=False)).tolist():
                a, n, places = int(words.starts[row]), int(words.n[row]), rows.column("_places")[row]
                starts.append(a + (places.values.to_numpy() if places.is_valid else np.arange(n - WINDOW + 1)))
            gone = covered(np.concatenate(starts), WINDOW, len(words.codes))
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in names]
                + [pa.array(words.n), pa.array(per_text_sum(gone, words)), words.joined(~gone)[0].cast(pa.string())],
                names=schema.names)

    return map_batches(joined, run, schema)
