"""SimHash fingerprints and the groups of documents that they link.

Fingerprints within ``MAX_DISTANCE`` bits link. To find these pairs, the ones in
each 2-bit segment of a fingerprint are counted. Two bits' counts differ by no
more than the bits themselves, so the Manhattan distance of the count vectors
is a lower bound of the bit distance. The segments form three parts. Of a linked
pair, some two parts (of 20 to 22 segments) are within 2 together; then a grid
point within 1 of both exists, and joining on the grid points near each
fingerprint finds the pair. Bits are compared after that.

Nothing emits all pairs of a group. Equal fingerprints are one row. A grid
point near two fingerprints gives a pair as it is. At points near more, each is
first tied to the smallest one there; then points whose members are one group by
now are left out, and only pairs whose parts are not yet connected are joined.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import LOWER, Words, byte_mapped, map_batches, text_slices
from hitprism.llm.components import components
from hitprism.llm.stored import stored

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
_SLICE_BYTES = 2 << 20

#: Where the segments of each part start.
_PARTS = [range(0, 22, 2), range(22, 44, 2), range(44, 64, 2)]


def _fingerprints(texts):
    words = Words(byte_mapped(texts, LOWER))
    joined, starts, ends = words.joined()
    data = joined.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    # shingles: one at each word with enough words from it on, or the whole text
    n = np.where(words.n > 0, np.maximum(words.n - SHINGLE + 1, 1), 0)
    first = np.repeat(words.starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(first + SHINGLE, np.repeat(words.ends, n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
    return out.view(np.int64)


def with_fingerprint(docs, text="text"):
    """Add ``fingerprint`` (long): a bit is 1 if it is set in over half the
    XXH64 hashes of the text's 4-word shingles, repeats included. A text of
    fewer words is one shingle; without words, or null, it is 0."""
    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]
    schema = T.StructType(kept + [T.StructField("fingerprint", T.LongType())])

    def run(batch):
        for rows in text_slices(batch, text, _SLICE_BYTES):
            found = pa.array(_fingerprints(rows.column(text)))
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + [found], names=schema.names)

    return map_batches(docs, run, schema)


def grid_points(fingerprints):
    """Rows (point, fingerprint): for each two of the three parts, the vector of
    ones per segment as packed 2-bit counts, and its neighbours one step away.
    The part left out is zero, but for a count of 3, which no segment has, in
    its first segment; so points of different parts differ."""
    odd = F.lit(0x5555555555555555)
    one, other = F.col("fingerprint").bitwiseAND(odd), F.shiftrightunsigned("fingerprint", 1).bitwiseAND(odd)
    counts = F.shiftleft(one.bitwiseAND(other), 1).bitwiseOR(one.bitwiseXOR(other))
    # a step up is 00 to 01 or 01 to 10, a step down the same backwards
    near = """concat(array(home), flatten(transform(steps, s -> concat(
        if((shiftright(home, s) & 3L) < 2, array(home ^ shiftleft(1L, s)), array()),
        if((shiftright(home, s) & 3L) > 0, array(home ^ shiftleft(3L, s)), array())))))"""
    kinds = []
    for left_out in _PARTS:
        steps = [s for part in _PARTS if part != left_out for s in part]
        mask = sum(3 << s for s in steps)
        kinds.append(F.struct(F.lit(mask - (1 << 64) if mask >> 63 else mask).alias("mask"),
                              F.lit(3 << left_out[0]).alias("mark"), F.array(*map(F.lit, steps)).alias("steps")))
    home = F.col("counts").bitwiseAND(F.col("kind.mask")).bitwiseOR(F.col("kind.mark"))
    return (
        fingerprints.select("fingerprint", counts.alias("counts"), F.explode(F.array(*kinds)).alias("kind"))
        .select("fingerprint", "kind.steps", home.alias("home"))
        .select("fingerprint", F.explode(F.expr(near)).alias("point"))
    )


def _meetings(fingerprints):
    """The members of points that several fingerprints share, as rows (point,
    fingerprint, n, first, last); of two that meet, only the last one.

    A fingerprint becomes about 100 rows, so few of them go to a task. The
    points are shuffled once, without a map-side combine, as almost none repeats.
    """
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = grid_points(fingerprints.repartition(tasks, "fingerprint")).repartition("point")
    shared = points.groupBy("point").agg(
        F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("first"), F.max("fingerprint").alias("last")).where("n > 1")
    return points.join(shared, "point").where("n > 2 OR fingerprint = last")


def linked_fingerprints(fingerprints, max_distance=MAX_DISTANCE):
    """Rows (fingerprint, root): the smallest fingerprint of each one's group.

    ``fingerprints``: distinct values, none null, as a stored table.
    ``max_distance`` is at most 4, since two parts of a pair are within 2 then.
    """
    if not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be from 0 to 4")

    def near(a, b):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance

    met = stored(_meetings(fingerprints), "grid")
    # a point that two fingerprints share is a pair; only larger ones need their members
    pairs = met.where((F.col("n") == 2) & near("first", "last")).select(F.col("last").alias("a"), F.col("first").alias("b"))
    members = met.where("n > 2")
    stars = (
        members.where((F.col("first") != F.col("fingerprint")) & near("first", "fingerprint"))
        .groupBy(F.col("fingerprint").alias("a")).agg(F.min("first").alias("b"))
    )
    ties = stored(pairs.union(stars).distinct(), "ties")
    roots = components(ties)
    # then what joins different groups of the first round
    rooted = members.join(roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").select(
        "point", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    rooted = stored(rooted, "rooted")
    # a point whose members are one group has no more to tell
    ends = rooted.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("point")
    rooted = stored(rooted.join(ends, "point"), "open-points")
    other = rooted.select("point", F.col("fingerprint").alias("other"), F.col("root").alias("other_root"))
    rest = stored(
        rooted.join(other, "point")
        .where((F.col("root") < F.col("other_root")) & near("fingerprint", "other"))
        .select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct(), "links")
    joined = components(rest)
    first_root = F.coalesce("root", "fingerprint")
    return (
        fingerprints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", first_root.alias("first_root"))
        .join(joined.select(F.col("node").alias("first_root"), "root"), "first_root", "left")
        .select("fingerprint", F.coalesce("root", "first_root").alias("root"))
    )


def near_duplicates(docs, doc_id="doc_id", text="text", max_distance=MAX_DISTANCE):
    """One row per row of ``docs``: its id, ``fingerprint`` (long) and
    ``component_id``, the smallest id reachable over links, its own included.

    Null ids take part in linking but are never a group's id, unless a group
    has no other. Repeated rows stay, in one group. Other columns are not kept.
    """
    prints = stored(with_fingerprint(docs.select(doc_id, text), text).select(doc_id, "fingerprint"), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")), "distinct-fingerprints")
    groups = stored(linked_fingerprints(distinct.select("fingerprint"), max_distance), "fingerprint-groups")
    ids = distinct.join(groups, "fingerprint")
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(groups.join(smallest, "root").select("fingerprint", "component_id"), "named-groups")
    return prints.join(named, "fingerprint")
