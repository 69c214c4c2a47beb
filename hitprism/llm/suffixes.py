"""Removal of byte strings that occur twice, by transforms of text collections.

A window is ``WINDOW`` consecutive bytes of one text. Of the ``GRAM``-byte strings
in a window, the one with the smallest hash is its anchor; the bytes of all
neighbouring windows with one anchor are a piece of at most
``2 * WINDOW - GRAM`` bytes. Equal windows have equal anchors, at the same place,
so only pieces with one anchor need to be compared, and pieces whose anchor occurs
once are left out. Equal pieces are one.

The pieces of some anchors together are a collection of short texts. Each
collection is built by one task, column by column (``bwt``): one byte of every
piece is put in a round, from the anchor towards the piece's start. The end markers
stand for the bytes from the anchor on, which are sorted before. Transform and common
prefixes are read and written as sequences, once a round, in the task's memory, as
a collection has a bounded size. A window is repeated if a common prefix next to
its suffix reaches ``WINDOW``, or if its piece occurs twice.

The distinct pieces of one anchor may be more than a collection should have. They
are cut in two by the place of the anchor in the window, and each half is dealt by
the bytes that all its windows share, again and again where needed; at the end the
windows themselves are dealt. No step pairs texts.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import map_batches, mixed, sliding, text_slices
from hitprism.llm.bwt import column_wise, walk
from hitprism.llm.stored import stored

WINDOW, GRAM = 200, 32
#: Bytes of a collection, as far as anchors can be dealt, and most of one anchor.
COLLECTION, MOST = 4 << 20, 2 << 20
_SPAN = WINDOW - GRAM + 1
_CHUNK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15


def _gram_hashes(data):
    out, width, factor = _SPREAD[data], 1, _FACTOR
    while width < GRAM:
        out = out[:-width] * np.uint64(factor) + out[width:]
        width, factor = 2 * width, factor * factor & (1 << 64) - 1
    return mixed(out)


def anchored(data, ends):
    """Pieces of texts that stand one after the other in ``data`` and end at
    ``ends``: place of the first window, windows, place of the anchor, its hash.
    Worked on in chunks, so a long text needs no more memory than short ones."""
    found = [np.zeros((4, 0), np.int64)]
    limit = np.repeat(ends, np.diff(ends, prepend=0)) if len(ends) > 1 else None
    for first in range(0, max(len(data) - WINDOW + 1, 0), _CHUNK):
        part = data[first:first + _CHUNK + WINDOW - 1]
        hashes = _gram_hashes(part)
        n = len(part) - WINDOW + 1
        least = sliding(hashes & ~_POSITION | np.arange(len(hashes), dtype=np.uint64), _SPAN, np.minimum)[:n]
        anchor = (least & _POSITION).astype(np.int64)
        whole = np.ones(n, bool) if limit is None else first + np.arange(n) + WINDOW <= limit[first:first + n]
        fresh = np.ones(n, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
        start = np.flatnonzero(fresh & whole)
        until = np.flatnonzero(np.append(fresh[1:] | ~whole[1:], True) & whole) + 1
        found.append(np.stack([first + start, until - start, first + anchor[start], hashes[anchor[start]].view(np.int64)]))
    return np.concatenate(found, axis=1)


def _bytes(texts):
    """The bytes of an Arrow array of texts, and where each text ends."""
    sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(texts).to_pylist()], np.int64)
    joined = b"".join(t.as_buffer() for t in texts if t.is_valid)
    return np.frombuffer(joined, np.uint8), np.cumsum(sizes)


def _keys(text):
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _anchors(texts):
    """Per text: the hashes of its anchors, as often as they occur."""
    schema = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()),
                           T.StructField("anchors", T.ArrayType(T.LongType()))])

    def run(batch):
        for rows in text_slices(batch, "text"):
            data, ends = _bytes(rows.column("text"))
            start, _, _, key = anchored(data, ends)
            sizes = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(ends))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(key))
            yield pa.RecordBatch.from_arrays([rows.column("t1"), rows.column("t2"), lists], names=schema.names)

    return map_batches(texts, run, schema)


_PIECES = "t1 long, t2 long, start long, s1 long, s2 long, key long, place int, data binary"


def _pieces(texts):
    """Pieces with the anchors listed in ``repeated``: where they start, a hash of
    128 bits, their anchor and its place in them."""

    def run(batch):
        for rows in text_slices(batch, "text"):
            data, ends = _bytes(rows.column("text"))
            start, windows, anchor, key = anchored(data, ends)
            text = np.searchsorted(ends, start, side="right")
            keep = np.zeros(len(start), bool)
            bounds = np.searchsorted(text, np.arange(len(ends) + 1))
            for row in range(rows.num_rows):
                a, b = bounds[row], bounds[row + 1]
                keep[a:b] = np.isin(key[a:b], rows.column("repeated")[row].values.to_numpy())
            start, windows, anchor, key, text = (x[keep] for x in (start, windows, anchor, key, text))
            if not len(start):
                continue
            cut = [data[a:b].tobytes() for a, b in zip(start.tolist(), (start + windows + WINDOW - 1).tolist())]
            hashes = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in cut], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("t1").take(pa.array(text)), rows.column("t2").take(pa.array(text)),
                 pa.array(start - (ends - np.diff(ends, prepend=0))[text]), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()),
                 pa.array(key), pa.array((anchor - start).astype(np.int32)), pa.array(cut, pa.binary())],
                names=["t1", "t2", "start", "s1", "s2", "key", "place", "data"])

    return map_batches(texts, run, _PIECES)


def _after_anchors(data, starts, ends):
    """The order of what follows the anchors, and what each has in common with the
    one before in that order."""
    parts = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__))
    sizes = (ends - starts)[order]
    width = min(int(sizes.max()), WINDOW)
    at = np.minimum(starts[order][:, None] + np.arange(width), len(data) - 1)
    same = data[at[1:]] == data[at[:-1]]
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return order, np.append(0, np.minimum(common, np.minimum(sizes[1:], sizes[:-1])))


def repeated_windows(pieces):
    """Of a table of (data, place, many): arrays (piece, first, last) of the runs of
    windows that are repeated in the collection, all of them where ``many``."""
    data, ends = _bytes(pieces.column("data").combine_chunks())
    place, starts = pieces.column("place").to_numpy().astype(np.int64), ends - np.diff(ends, prepend=0)
    order, common = _after_anchors(data, starts + place, ends)
    transform, common = column_wise(data, starts[order], place[order], common, WINDOW)
    near = common >= WINDOW
    near[:-1] |= near[1:]
    hit = np.zeros(len(data) + 1, bool)
    for length, (who, places) in enumerate(walk(transform, len(order))):
        hit[(starts + place)[order[who]] - length] = near[places]
    hit = hit[:-1] | np.repeat(pieces.column("many").to_numpy(), ends - starts)
    hit &= np.arange(len(data)) + WINDOW <= np.repeat(ends, ends - starts)
    step = np.diff(hit.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(step > 0), np.flatnonzero(step < 0) - 1
    piece = np.searchsorted(ends, first, side="right")
    return piece, first - starts[piece], last - starts[piece]


_RUNS = "s1 long, s2 long, first int, last int"


def _collections(texts, n_bytes, size):
    """Runs of repeated windows, each collection by a task of its own."""

    def run(group):
        text, first, last = repeated_windows(group)
        text = pa.array(text)
        return pa.table([group.column("s1").take(text), group.column("s2").take(text),
                         pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["s1", "s2", "first", "last"])

    dealt = F.pmod(F.xxhash64("key"), F.lit(1 + n_bytes // size))
    return texts.select("s1", "s2", "data", "place", "many", dealt.alias("collection")).groupBy("collection").applyInArrow(run, _RUNS)


def _halves(texts):
    """Each text cut in two by the place of the anchor in the window, ``low`` to
    ``high``: rows as those of texts, with ``p1``, ``p2`` and ``base``, the text
    that a half is of and its first window there."""
    last = F.octet_length("data") - WINDOW
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")),
                     F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    cut = texts.select("*", F.explode(halves).alias("half")).select(
        F.col("s1").alias("p1"), F.col("s2").alias("p2"), "data", "many", "place", "half.low", "half.high",
        F.greatest(F.lit(0), F.col("place") - F.col("half.high")).alias("base"),
        F.least(last, F.col("place") - F.col("half.low")).alias("until")).where("base <= until")
    cut = cut.withColumns({"data": F.expr(f"substring(data, base + 1, until - base + {WINDOW})"), "place": F.col("place") - F.col("base")})
    return cut.withColumns({"key": F.xxhash64("low", "high", _core()), "s1": F.xxhash64("low", "data"), "s2": F.xxhash64("high", "data", F.lit(2))})


def _core():
    """What all windows have that hold the anchor ``low`` to ``high`` bytes after
    their start."""
    return F.expr(f"substring(data, place - low + 1, {WINDOW} - (high - low))")


def _distinct(rows):
    same = [F.first(c).alias(c) for c in ("key", "place", "low", "high", "data")]
    return rows.groupBy("s1", "s2").agg(((F.count(F.lit(1)) > 1) | F.bool_or("many")).alias("many"), *same)


def _runs(texts, size, most):
    """Rows (s1, s2, first, last): runs of repeated windows of distinct texts."""
    sizes = texts.groupBy("key").agg(F.sum(F.octet_length("data").cast("long")).alias("n"), F.count(F.lit(1)).alias("pieces"))
    sizes = stored(sizes, "anchor-sizes")
    # a piece whose anchor no other has is repeated whole or not at all
    alone = texts.join(sizes.where("pieces = 1"), "key", "left_semi").where("many").select(
        "s1", "s2", F.lit(0).alias("first"), (F.octet_length("data") - WINDOW).alias("last"))
    hot, cool = (F.col("n") > most) & (F.col("pieces") > 1), (F.col("n") <= most) & (F.col("pieces") > 1)
    n_hot, n_bytes = sizes.agg(F.count_if(hot), F.coalesce(F.sum(F.when(cool, F.col("n"))), F.lit(0))).first()
    dealt = _collections(texts.join(sizes.where(cool), "key", "left_semi"), n_bytes, size)
    runs = stored(alone.union(dealt), "repeated-runs")
    if not n_hot:
        return runs
    halves = stored(_halves(texts.join(sizes.where(hot), "key", "left_semi")), "halves")
    inner = _runs(stored(_distinct(halves), "distinct-halves"), size, most)
    back = halves.select("p1", "p2", "base", "s1", "s2").join(inner, ["s1", "s2"])
    return runs.union(back.select("p1", "p2", F.col("first") + F.col("base"), F.col("last") + F.col("base")))


def repeated_spans(texts, size=COLLECTION, most=MOST):
    """Rows (t1, t2, spans): per text with repeated windows, by the hashes of
    ``_keys``, runs of these windows as (first, last) places. ``texts``: t1, t2 and
    text, a row for each occurrence."""
    anchors = stored(_anchors(texts.where(F.octet_length("text") >= WINDOW)), "anchors")
    each = anchors.select("t1", "t2", F.explode("anchors").alias("key"))
    repeated = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated-anchors")
    per_text = each.join(repeated, "key").groupBy("t1", "t2").agg(F.collect_set("key").alias("repeated"))
    found = stored(_pieces(texts.join(per_text, ["t1", "t2"]).select("t1", "t2", "text", "repeated")), "pieces")
    distinct = stored(_distinct(found.select(
        "s1", "s2", "key", "place", F.lit(0).alias("low"), F.lit(_SPAN - 1).alias("high"), "data", F.lit(False).alias("many"))), "distinct-pieces")
    runs = _runs(distinct, size, most)
    spans = found.select("t1", "t2", "start", "s1", "s2").join(runs, ["s1", "s2"]).select(
        "t1", "t2", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("span"))
    return spans.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs, text="text", size=COLLECTION, most=MOST):
    """Add ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (binary): the text's bytes without those that a repeated window covers.

    Windows are repeated if they start anywhere else too, in the same text, another
    row or a row that repeats this one. A null text is empty; a text of fewer than
    ``WINDOW`` bytes loses nothing; an empty table gives no rows. Texts of any length
    are taken whole. Columns of the added names are replaced, all others stay.
    """
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]
    names = [c for c in docs.columns if c not in dict(added)]
    body = F.col(text).cast("string")
    texts = docs.select(*_keys(F.col(text)), body.alias("text"))
    spans = repeated_spans(texts, size, most).select(F.struct("t1", "t2").alias("of"), "spans")
    rows = docs.select(F.struct(*names).alias("row"), body.alias("text"), F.struct(*_keys(F.col(text))).alias("key"))
    joined = rows.join(spans, (F.col("key.t1") == F.col("of.t1")) & (F.col("key.t2") == F.col("of.t2")), "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"]] + [T.StructField(*f) for f in added])

    def run(batch):
        for rows in text_slices(batch, "text"):
            data, ends = _bytes(rows.column("text"))
            starts = ends - np.diff(ends, prepend=0)
            gone = np.zeros(len(data) + 1, np.int32)
            for row in np.flatnonzero(rows.column("spans").is_valid().to_numpy(zero_copy_only=False)).tolist():
                first, last = (rows.column("spans")[row].values.field(c).to_numpy() for c in ("first", "last"))
                np.add.at(gone, starts[row] + first, 1)
                np.add.at(gone, starts[row] + last + WINDOW, -1)
            gone = np.cumsum(gone[:-1]) > 0
            begins = gone.copy()
            inner = starts[starts < len(data)]
            begins[1:] &= ~gone[:-1]
            begins[inner] = gone[inner]
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
            out = [x[ends] - x[starts] for x in total]
            kept = data[~gone]
            offsets = np.concatenate([[0], np.cumsum(ends - starts - out[0])])
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array(ends - starts), pa.array(out[0]), pa.array(out[1]),
                 pa.array([kept[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=schema.names)

    return map_batches(joined, run, schema).select("row.*", *[f for f, _ in added])
