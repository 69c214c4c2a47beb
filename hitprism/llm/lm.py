"""A bigram language model over a log-frequency Bloom filter.

Counts are quantised to levels, ``level = 1 + floor(log2 count)``. A bigram (or
word) of level q is in the filter with each level 1..q; a reader probes level 1,
2, ... until a probe fails and knows the count up to a factor of two. A false
positive can raise a level, nothing lowers it.

The filter is a table with one segment per shard; shards have the same number of
tokens on average, so there are more segments, of the same expected size and with the
same ``BITS`` bits per entry, for a larger corpus. It is not broadcast: a copy of all
segments would outgrow any worker. Texts are cut into words once, in slices kept as
a table. Bigrams and rarer words go to their segments as packed 32-bit hashes within
a shard: first with counts, added up over up to ``MERGED`` of them in each task, to
build the segments; then slice by slice, to be answered with levels, which go back to
the slice. Of a bigram that all texts share, a shard gets one entry for each of these.
Segments are probed ``AT_ONCE`` hashes at a time. No task or driver holds more than
one segment.

Word counts are exact at any size: the most frequent words, at most ``HEAD``, are
broadcast as hashes and counts; a document's other words join their counts.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from hitprism.llm.batches import LOWER, Words, byte_mapped, map_batches, map_partitions, mixed, per_text_sum, text_slices
from hitprism.llm.stored import stored

MODULUS, HELD_OUT = 7, 2
HEAD = 1 << 19
BITS, PROBES = 10, 4
#: Tokens per shard.
SHARD_TOKENS = 1 << 21
#: Entries added up by a task before they are sent, and hashes looked up at once.
MERGED, AT_ONCE = 1 << 21, 1 << 17
#: Entries are added up in so many steps.
SHARD_GROUPS = 8
#: Weight of the bigram's share; the rest is the word's own probability.
WEIGHT = 0.1
# small, as a Parquet writer holds at least 100 rows
_SLICE_BYTES = 3 << 19
#: Of the Arrow batches of texts or slices: both Spark and the task hold some of each.
_BATCH_BYTES = 8 << 20
_END = np.uint64(xxhash.xxh3_64_intdigest(b"", 7))


_SLICES = "slice long, doc_ids array<long>, held array<boolean>, n array<int>, words binary, codes binary"


def token_slices(docs):
    """Rows of several texts each: ids, whether held out, and token counts per text;
    the hashes of all words (8 bytes each) and each token's place there (4 bytes).
    ``slice`` + i is a number of its own for the i-th text."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in text_slices(batch, "text", _SLICE_BYTES):
                words = Words(byte_mapped(rows.column("text"), LOWER))
                unique = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.unique.to_pylist()), np.uint64, len(words.unique))
                codes = np.insert(words.codes, words.ends, len(unique)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), *(pa.array([x], kind) for x, kind in (
                        (rows.column("doc_id").to_pylist(), pa.list_(pa.int64())), (held_out(rows.column("doc_id")).tolist(), pa.list_(pa.bool_())),
                        ((words.n + 1).tolist(), pa.list_(pa.int32())), (np.append(unique, _END).tobytes(), pa.binary()), (codes.tobytes(), pa.binary())))],
                    names=["slice", "doc_ids", "held", "n", "words", "codes"])
                row += rows.num_rows

    return map_partitions(docs, run, _SLICES)


class _Tokens:
    """Tokens of a slice as 64-bit hashes: each text's words, then one end."""

    def __init__(self, rows, at=0):
        self.slice = rows.column("slice")[at].as_py()
        self.held = np.array(rows.column("held")[at].as_py(), bool)
        self.n = np.array(rows.column("n")[at].as_py(), np.int64)
        words, codes = (np.frombuffer(rows.column(c)[at].as_py(), kind) for c, kind in (("words", np.uint64), ("codes", np.int32)))
        self.values = words[codes]
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        before = np.roll(self.values, 1)
        before[self.starts] = _END
        self.pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ self.values)
        self.singles = mixed(self.values ^ np.uint64(0x5851F42D4C957F2D))
        self.before = before

    def text_of_token(self):
        return np.repeat(np.arange(len(self.n)), self.n)

    def training(self):
        return np.repeat(~self.held, self.n)


def held_out(doc_ids):
    """Of ids as an Arrow array: whether the CRC-32 of the id as text has the
    remainder that is kept from training; a null id is the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % MODULUS == HELD_OUT for i in doc_ids.to_pylist()], bool)


def word_counts(slices):
    """Rows (word, n): hash and count of each training token."""

    def run(batch):
        for at in range(batch.num_rows):
            tokens = _Tokens(batch, at)
            found, n = np.unique(tokens.values[tokens.training()], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    parts = map_batches(slices, run, "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _shard(grams, shards):
    """Shard of each bigram or word by the upper half of its hash; the lower names
    it there. Sorted hashes are sorted by shard, too."""
    return ((grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(grams, shards):
    """Of sorted hashes: the shards that occur and a slice of places for each."""
    used, first = np.unique(_shard(grams, shards), return_index=True)
    return used, [slice(a, b) for a, b in zip(first, np.append(first[1:], len(grams)))]


def _added(keys, n):
    """Distinct keys, sorted, and the sum of ``n`` for each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], np.add.reduceat(n, first, dtype=np.int64) if len(keys) else n.astype(np.int64)


def _added_by_shards(held, shards):
    """``_added`` of pairs (sorted hashes, counts) together, for the hashes of a
    ``SHARD_GROUPS``-th of the shards at a time."""
    edges = sorted({shards * i // SHARD_GROUPS for i in range(1, SHARD_GROUPS)} - {0})
    cuts = np.array([-(-(edge << 32) // shards) << 32 for edge in edges], np.uint64)
    places = [[0, *np.searchsorted(grams, cuts).tolist(), len(grams)] for grams, _ in held]
    for i in range(len(edges) + 1):
        grams, n = _added(*(np.concatenate([x[at[i]:at[i + 1]] for x, at in zip(xs, places)]) for xs in zip(*held)))
        if len(grams):
            yield grams, n


def ngram_filter(slices, shards, shared):
    """Rows (shard, top, bits): the filter's segments and their highest levels."""

    def sent(held):
        for grams, n in _added_by_shards(held, shards):
            low, n = grams.astype(np.uint32), n.astype(np.uint32)
            used, places = _by_shard(grams, shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([low[p].tobytes() for p in places], pa.binary()),
                 pa.array([n[p].tobytes() for p in places], pa.binary())], names=["shard", "low", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                tokens = _Tokens(batch, at)
                training = tokens.training()
                rare = training & ~_is_head(tokens.values, shared.value[0])
                grams, n = np.unique(np.concatenate([tokens.pairs[training], tokens.singles[rare]]), return_counts=True)
                held.append((grams, n.astype(np.uint32)))
                size += len(grams)
                if size >= MERGED:
                    yield from sent(held)
                    held, size = [], 0
        if size:
            yield from sent(held)

    def build(table):
        top, bits = _segment(*(np.concatenate([np.frombuffer(x, np.uint32) for chunk in table.column(c).chunks for x in _buffers(chunk)])
                               for c in ("low", "n")))
        return pa.table({"shard": table.column("shard")[:1], "top": pa.array([top], pa.int32()), "bits": pa.array([bits], pa.binary())})

    counted = map_partitions(slices, count, "shard int, low binary, n binary")
    return counted.groupBy("shard").applyInArrow(build, "shard int, top int, bits binary")


def _segment(low, n):
    """Highest level and bytes of the segment that holds bigrams and words (lower
    halves) with counts; bits are set for some at a time."""
    low, n = _added(low, n)
    levels = np.frexp(n)[1]  # 1 + floor(log2 count)
    size, top = max(64, int(levels.sum()) * BITS & ~7), int(levels.max())
    bits = np.zeros(size, bool)
    for i in range(0, len(low), AT_ONCE):
        some, some_levels = low[i:i + AT_ONCE], levels[i:i + AT_ONCE]
        for level in range(1, int(some_levels.max()) + 1):
            for at in _places(some[some_levels >= level], level, size):
                bits[at] = True
    return top, np.packbits(bits, bitorder="little").tobytes()


def _places(low, level, size):
    """The segment's bits for bigrams (lower halves) at a level."""
    step = mixed(low.astype(np.uint64) | np.uint64(level) << np.uint64(32))
    first, second = step & np.uint64(0xFFFFFFFF), step >> np.uint64(32) | np.uint64(1)
    for k in range(PROBES):
        yield ((first + np.uint64(k) * second) % np.uint64(size)).astype(np.int64)


def _buffers(chunk):
    """The values of a chunk of binaries, not copied."""
    return [x.as_buffer() for x in chunk]


def _levels(low, bits, top):
    """Level of each bigram or word (lower halves) in a segment, some at a time."""
    return np.concatenate([np.zeros(0, np.uint8), *(_some_levels(low[i:i + AT_ONCE], bits, top) for i in range(0, len(low), AT_ONCE))])


def _some_levels(low, bits, top):
    """Probes go on while all bits are set, to the highest level at most."""
    out, left = np.zeros(len(low), np.uint8), np.arange(len(low))
    for level in range(1, top + 1):
        there = np.ones(len(left), bool)
        for at in _places(low[left], level, 8 * len(bits)):
            there &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        left = left[there]
        out[left] = level
    return out


def _is_head(words, head):
    """Which words are among the frequent ones, whose counts are known."""
    if not len(head):
        return np.zeros(len(words), bool)
    return head[np.searchsorted(head, words).clip(max=len(head) - 1)] == words


def _grams(tokens, head):
    """The distinct bigrams and rarer words of a slice, sorted."""
    return np.unique(np.concatenate([tokens.pairs, np.unique(tokens.singles[~_is_head(tokens.values, head)])]))


def looked_up(slices, segments, shards, shared):
    """Rows (slice, shard, levels): a byte for each distinct bigram and rarer word of
    the slice in the shard, in the order of their hashes."""

    def ask(batch):
        for at in range(batch.num_rows):
            tokens = _Tokens(batch, at)
            grams = _grams(tokens, shared.value[0])
            low = grams.astype(np.uint32)
            used, places = _by_shard(grams, shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.full(len(used), tokens.slice)),
                 pa.array([low[p].tobytes() for p in places], pa.binary())], names=["shard", "slice", "low"])

    def answer(asked, segment):
        bits, top = np.zeros(1, np.uint8), 0
        if segment.num_rows:
            bits, top = np.frombuffer(segment.column("bits")[0].as_buffer(), np.uint8), segment.column("top")[0].as_py()
        parts = [_levels(np.frombuffer(x, np.uint32), bits, top).tobytes() for chunk in asked.column("low").chunks for x in _buffers(chunk)]
        return pa.table({"slice": asked.column("slice"), "shard": asked.column("shard"), "levels": pa.array(parts, pa.binary())})

    asked = map_batches(slices, ask, "shard int, slice long, low binary")
    return asked.groupBy("shard").cogroup(segments.groupBy("shard")).applyInArrow(answer, "slice long, shard int, levels binary")


def _frequent(counts):
    """The words over the lowest count that at most ``HEAD`` words have; driver
    side, as sorted hashes and counts."""
    bucket = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["b"]: r["words"] for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > HEAD:
            break
        total, least = total + sizes[b], b
    head = counts.where(bucket >= least).toArrow()
    words = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], head.column("n").to_numpy()[order]


def _scored(tokens, head, n_head, levels, total):
    """Per text: tokens, known head tokens, sum of log10(count + 1) over head
    tokens, model score, and the hashes of the other tokens. ``levels``: those of
    the slice's bigrams and words."""
    grams = _grams(tokens, head)
    unique, first, back = np.unique(tokens.values, return_index=True, return_inverse=True)
    place = np.searchsorted(head, unique).clip(max=max(len(head) - 1, 0))
    is_head = _is_head(unique, head)
    count = np.where(is_head, n_head[place] if len(head) else 0, 0)
    level = np.zeros(len(unique), np.int64)
    level[~is_head] = levels[np.searchsorted(grams, tokens.singles[first[~is_head]])]
    low = np.where(is_head, count, np.where(level > 0, 1 << np.maximum(level - 1, 0), 0))
    high = np.where(is_head, count, (1 << level) - 1)

    of_before = np.searchsorted(unique, tokens.before)
    pair_level = levels[np.searchsorted(grams, tokens.pairs)].astype(np.int64)
    pair_count = np.where(pair_level > 0, 1 << np.maximum(pair_level - 1, 0), 0)
    share = np.minimum(1.0, pair_count / np.maximum(high[of_before], 1)) * (high[of_before] > 0)
    own = (low[back] + 1) / total
    logs = np.log10(WEIGHT * share + (1 - WEIGHT) * own)

    known = is_head[back]
    other = ~known
    sizes = np.bincount(tokens.text_of_token()[other], minlength=len(tokens.n))
    return [pa.array(tokens.n), pa.array(per_text_sum(known, tokens).astype(np.int64)),
            pa.array(per_text_sum(np.where(known, np.log10(count[back] + 1.0), 0.0), tokens)),
            pa.array(per_text_sum(logs, tokens)),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                     pa.array(tokens.values[other].view(np.int64)))]


def score(docs, doc_id="doc_id", text="text"):
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score.

    The model gives a token ``WEIGHT`` times its bigram's share among what
    follows the word before it (the lower end of its level, by the upper end of
    that word's) and for the rest the unigram, so that probabilities in a
    context sum to one at most, false positives aside. A null text has the end
    token only; an empty table gives no rows. Repeated rows are trained on and
    scored as often as they occur; a null id is the empty text for the split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slices = stored(token_slices(docs), "token-slices", _BATCH_BYTES)
    counts = stored(word_counts(slices), "word-counts", _BATCH_BYTES)
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n_tokens + n_words + 1
    shards = 1 + n_tokens // SHARD_TOKENS
    shared = spark.sparkContext.broadcast(_frequent(counts))
    segments = stored(ngram_filter(slices, shards, shared), "filter", _BATCH_BYTES)
    levels = stored(looked_up(slices, segments, shards, shared), "levels", _BATCH_BYTES)

    def run(texts, answers):
        tokens, (head, n_head) = _Tokens(texts), shared.value
        found = answers.sort_by("shard").column("levels").to_pylist()
        return pa.table(
            [pa.array(tokens.slice + np.arange(len(tokens.n))), pa.array(texts.column("doc_ids")[0].as_py(), pa.int64()), pa.array(tokens.held),
             *_scored(tokens, head, n_head, np.frombuffer(b"".join(found), np.uint8), total)],
            names=["row", "doc_id", "held_out", "n_tokens", "n_head", "logs", "score", "rest"])

    schema = ("row long, doc_id long, held_out boolean, n_tokens long, n_head long, logs double, score double, "
              "rest array<long>")
    scored = stored(slices.groupBy("slice").cogroup(levels.groupBy("slice")).applyInArrow(run, schema), "scored", _BATCH_BYTES)
    rest = scored.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
    rest = rest.groupBy("row").agg(F.count("n").alias("n_rest"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rest_logs"))
    base = F.col("logs") + F.coalesce("rest_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total))
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
