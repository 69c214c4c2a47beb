"""Benchmark decontamination by winnowed fingerprints, joined as tables.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item
if it has fewer. A window's fingerprint is the smallest hash of its word k-grams
(of a shorter item, the hash of all its words), on both sides alike, so a shared
window always shares its fingerprint. Neighbouring windows mostly have one in
common: a passage is a run of such windows.

Fingerprints of documents are joined with the distinct ones of the benchmark;
passages that meet are cut into their windows, which are joined by their words.
Before anything moves, documents' fingerprints are looked up in a bit table of
``FILTER_BITS`` bits, whatever the size of the benchmark: what it lets through
by chance goes at the join. No side is collected; Spark broadcasts one only
below its threshold.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import (
    LOWER, Words, byte_mapped, full_windows, map_batches, mixed, sliding, text_slices, window_hashes,
)
from hitprism.llm.stored import stored

WINDOW, GRAM = 13, 5
CONTAMINATED_ONE_IN = 20

#: Bits of the table that sorts out fingerprints no item has; a power of two.
FILTER_BITS = 1 << 24
_BUCKET_BITS = 1 << 15  # of Spark's bitmap functions

_FACTOR = 0x9E3779B97F4A7C15 | 1

# A-Z lower-cased; what is neither digit, letter nor beyond ASCII parts words.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"

_PASSAGES = "print long, size int, start long, words string"


def _word_hashes(unique):
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique.to_pylist()), np.uint64, len(unique))


def window_prints(values, size):
    """The fingerprint of the window of ``size`` words that starts at each place."""
    if size < WINDOW:
        return mixed(window_hashes(values, size, _FACTOR) + np.uint64(size))
    return sliding(window_hashes(values, GRAM, _FACTOR), WINDOW - GRAM + 1, np.minimum)


def _passages(words, hashes, size, wanted):
    """Runs of windows of ``size`` words with one fingerprint: text, fingerprint,
    first word within the text, and words. ``wanted`` picks among fingerprints."""
    prints = window_prints(hashes, size)
    at = np.flatnonzero(full_windows(words, size))
    at = at[wanted(prints[at])]
    if not len(at):
        return
    text = words.text_of_word()[at]
    # a run goes on while neither text nor fingerprint changes
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0)
    new[1:] |= prints[at[1:]] != prints[at[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    for a, z, row in zip(at[first].tolist(), (at[last] + size).tolist(), text[first].tolist()):
        spelled = words.unique.take(pa.array(words.codes[a:z])).to_pylist()
        yield row, int(prints[a].view(np.int64)), a - int(words.starts[row]), " ".join(spelled)


def _mapped(df, kept, text, sizes_of, wanted):
    """Columns ``kept`` and the passages of each row's text, a row for each passage."""
    schema = T.StructType([df.schema[c] for c in kept] + T._parse_datatype_string(f"struct<{_PASSAGES}>").fields)

    def run(batch):
        for rows in text_slices(batch, text):
            words = Words(byte_mapped(rows.column(text), _FOLD))
            hashes = _word_hashes(words.unique)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
            for size, of_size in sizes_of(words):
                found = list(_passages(of_size, hashes, size, wanted))
                if found:
                    row, prints, starts, spelled = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(c).take(pa.array(row)) for c in kept]
                        + [pa.array(prints, pa.int64()), pa.array([size] * len(row), pa.int32()),
                           pa.array(starts, pa.int64()), pa.array(spelled, pa.string())], names=schema.names)

    return map_batches(df, run, schema)


class _OfSize:
    """The words of a batch, with only texts of ``n`` words having any."""

    def __init__(self, words, n):
        self.codes, self.unique, self.starts, self.n = words.codes, words.unique, words.starts, words.n
        self.text_of_word = words.text_of_word
        self.ends = np.where(words.n == n, words.ends, words.starts)


def _item_sizes(words):
    """An item's windows: of ``WINDOW`` words, or of all where it has fewer."""
    yield WINDOW, words
    for n in np.unique(words.n[(words.n > 0) & (words.n < WINDOW)]).tolist():
        yield n, _OfSize(words, n)


def _windows(passages):
    """The windows of passages: ``at`` (first word) and ``window`` (words)."""
    return passages.withColumn("_word", F.split("words", " ")).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("_word") - F.col("size"))).alias("_i")).select(
        *[c for c in passages.columns if c not in ("words", "start")], (F.col("start") + F.col("_i")).alias("at"),
        F.array_join(F.slice("_word", F.col("_i") + 1, F.col("size")), " ").alias("window"))


def _filter(prints):
    """The bit table of fingerprints as bytes: at most ``FILTER_BITS`` bits come here."""
    place = F.pmod("print", F.lit(FILTER_BITS)) + 1
    buckets = prints.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in buckets:
        start = (row["bucket"] - 1) * _BUCKET_BITS // 8
        table[start : start + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return table


def _text_key(text):
    """128 bits of a text, by which a document's spans come back to it."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def spans_of_texts(docs, benchmark, text="text", item_id="item_id", item_text="text"):
    """One row per distinct text with an item's window: ``key`` (``_text_key``) and
    ``spans`` (item, first word, number of words)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    every = _mapped(items, ["item"], "text", _item_sizes, lambda prints: np.ones(len(prints), bool))
    # read three times; its windows are found once
    known = stored(_windows(every).select("print", "size", "window", "item").distinct(), "benchmark-windows")
    prints = known.select("print", "size").distinct()
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most WINDOW of them
    shared = docs.sparkSession.sparkContext.broadcast(_filter(prints))

    def met(found):
        place = found & np.uint64(FILTER_BITS - 1)
        return (shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    texts = docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.col(text).alias("text"))
    passages = _mapped(texts, ["a", "b"], "text", lambda words: [(n, words) for n in sizes], met)
    # copies of a text give the same passages: one of each goes on
    hits = passages.join(prints, ["print", "size"], "left_semi").distinct()
    spans = _windows(hits).join(known.select("size", "window", "item"), ["size", "window"]).groupBy("a", "b").agg(
        F.collect_list(F.struct("item", F.col("at").alias("start"), F.col("size").cast("long").alias("n"))).alias("spans"))
    return spans.select(F.struct("a", "b").alias("key"), "spans")


def _joined(docs, found, text, added):
    """Add ``n_words``, and columns of ``found`` by each row's text; ``added`` has
    their names, and their values for a text that is not in it."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", *added)]
    # as a table its size is known: Spark sends it to the documents or, beyond its threshold, joins by key
    found = stored(found.select(F.struct("key", *added).alias("_of_text")), "benchmark-texts")
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    # the key is worked out before the join, so that a text nobody asks for is not moved
    plain = docs.select(*kept, n_words.alias("n_words"), _text_key(F.col(text)).alias("_key_of_text"))
    return plain.join(found, F.col("_key_of_text") == F.col("_of_text.key"), "left").select(
        *[F.col(f"`{c}`") for c in plain.columns[:-1]],
        *[F.coalesce(F.col(f"_of_text.{c}"), none).alias(c) for c, none in added.items()])


def matched(docs, benchmark, text="text", item_id="item_id", item_text="text"):
    """Add ``n_words`` and ``spans`` (item, first word, number of words): every
    occurrence of an item's window in a row's text.

    A null or empty text has no words, an item without words no windows, and an
    item without an id is reported under the empty id. Repeated rows are matched
    alike; columns of the added names are replaced. Without documents the result
    is empty, without items no row has spans. A very long text is held whole, alone.
    """
    none = F.array().cast("array<struct<item:string,start:bigint,n:bigint>>")
    return _joined(docs, spans_of_texts(docs, benchmark, text, item_id, item_text), text, {"spans": none})


def judged(docs, benchmark, text="text", item_id="item_id", item_text="text"):
    """Add ``n_words``, ``n_hit`` (words in an occurrence), ``items`` (ids with
    occurring windows, sorted as text) and ``contaminated``: one word in
    ``CONTAMINATED_ONE_IN`` or more is hit."""
    found = spans_of_texts(docs, benchmark, text, item_id, item_text)
    # spans in order of their start; the state is (words hit, end so far)
    n_hit = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["n"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda state, s: F.struct(
            (state["hit"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], state["end"]))).alias("hit"),
            F.greatest(state["end"], s["b"]).alias("end")),
        lambda state: state["hit"])
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    contaminated = (F.col("n_hit") > 0) & (CONTAMINATED_ONE_IN * F.col("n_hit") >= F.col("n_words"))
    plain = docs.drop(*[c for c in ("contaminated",) if c in docs.columns])
    return _joined(plain, found.select("key", n_hit.alias("n_hit"), items.alias("items")), text, {
        "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"),
    }).withColumn("contaminated", contaminated)
