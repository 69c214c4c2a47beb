"""Line dedup by windows of three lines that overlap.

A window is three consecutive lines of one text, taken as they are. Windows are
compared by a 128-bit hash over the whole table. All occurrences of a window
but its first (smallest document id, then place) are later ones, and the lines
that later occurrences cover are removed, overlapping ones once.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.shipping import ship
from hitprism.llm.stored import stored

LINES = 3


def _key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs, doc_id="doc_id", text="text"):
    """Rows (doc_id, text_hash, place, h1, h2): windows with a word in them."""
    lines = F.split(F.col("text"), "\n", -1)
    parts = [F.element_at("lines", F.col("place") + i) for i in range(1, LINES + 1)]
    window = F.array_join(F.array(*parts), "\n")
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .select("doc_id", _key(F.col("text")).alias("text_hash"), lines.alias("lines"))
        .where(F.size("lines") >= LINES)
        .select("doc_id", "text_hash", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - LINES)).alias("place"))
        .select("doc_id", "text_hash", "place", window.alias("window"))
        .where(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
        .select("doc_id", "text_hash", "place", F.xxhash64("window").alias("h1"),
                F.xxhash64(F.lit("second"), "window").alias("h2"))
    )


@F.arrow_udf(T.StringType())
def _without_lines(texts: pa.Array, places: pa.Array) -> pa.Array:
    """Texts without the lines at the given places; null where there are none."""
    out = []
    for text, gone in zip(texts, places):
        if not gone.is_valid or not text.is_valid:
            out.append(None)
            continue
        lines = np.array(text.as_py().split("\n"), object)
        out.append("\n".join(np.delete(lines, gone.values.to_numpy())))
    return pa.array(out, pa.string())


def covered_lines(docs, doc_id="doc_id", text="text"):
    """Rows (doc_id, text_hash, places): the lines to remove, numbered from 0."""
    found = stored(windows(docs, doc_id, text), "line-windows")
    place = F.struct("doc_id", "place")
    first = (
        found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    )
    later = found.join(stored(first, "repeated-windows"), ["h1", "h2"]).where(place > F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("place", F.col("place") + LINES - 1)))))
    return later.groupBy("doc_id", "text_hash").agg(covered.alias("places"))


def dedup_lines(docs, doc_id="doc_id", text="text"):
    """``docs`` with later occurrences taken out of ``text``; adds ``n_lines``
    and ``n_removed``.

    A null text stays null and has no lines, an empty one has one line; texts of
    fewer than three lines stay as they are. Null ids come before all others.
    Rows that repeat an id and a text are one document: none of them is later
    than the other, all lose the same lines. Windows of white space only never
    count as repeated. Columns of the added names are replaced.
    """
    ship(docs.sparkSession)
    added = ("n_lines", "n_removed")
    names = [c for c in docs.columns if c not in added]
    places = covered_lines(docs, doc_id, text).select(
        F.struct("doc_id", "text_hash").alias("_of"), F.col("places").alias("_places"))
    left = docs.select(*names).withColumn("_key", F.struct(F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("text_hash")))
    same = reduce(lambda a, b: a & b, [F.col(f"_key.{c}").eqNullSafe(F.col(f"_of.{c}")) for c in ("doc_id", "text_hash")])
    joined = left.join(places, same, "left")
    # only texts that lose lines go to Python
    cut = _without_lines(F.when(F.col("_places").isNotNull(), F.col(text)), F.col("_places"))
    new = F.when(F.col("_places").isNull(), F.col(text)).otherwise(cut)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1))).cast("long")
    return joined.select(
        *[new.alias(c) if c == text else F.col(c) for c in names], n_lines.alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"))
