"""Group-level values and ranks without passing a group through one task.

A window over ``partitionBy(key)`` sends all rows of a key to one task; with a
third of the rows on one key that task never ends. Here a group's value is
aggregated first (with map-side combine) and then joined back.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

# Largest number of rows of a cut list that may be broadcast.
BROADCAST_TOP = 500_000


def with_group_values(df, keys, values, keep_unkeyed=False):
    """Attach aggregates of each row's group to the row; lazy.

    Rows with a null key belong to no group: dropped, or kept with null values
    if ``keep_unkeyed``. The aggregates, one row per group, are joined back. They
    are grouped by the keys as one struct, so that a join by shuffle deals both
    sides anew and Spark can broadcast few groups, or split a hot key.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    groups = df.where(keyed).groupBy(F.struct(*keys).alias("group")).agg(*values)
    names = [c for c in groups.columns if c != "group"]
    return df.join(groups.select("group.*", *names), keys, "left" if keep_unkeyed else "inner")


def top_rows(df, n, order, rank):
    """The first ``n`` rows in order, numbered from 1.

    Spark keeps the best ``n`` of each partition and merges those; the window
    then only sees the ``n`` rows left.
    """
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def broadcast_top(best, n):
    """Broadcast a frame cut to ``n`` rows, if ``n`` is small enough for that."""
    return F.broadcast(best) if n <= BROADCAST_TOP else best


def ranked(df, order, index, start=1):
    """Number the rows of a frame that is small by construction: one row per brand,
    type, tone or the like. They meet in one task."""
    return df.withColumn(index, (F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)).cast("long"))


def numbered(df, levels, ties, index, start=1):
    """Number all rows, whatever their count, by two columns, both from the largest
    down, and then by ``ties``; lazy.

    A row's number is the rows with a larger first value, those of the same first and
    a larger second value, and its place among those with the same two. The first two
    come from counts per pair of values, added up over the values of the first column,
    which must be few (such as days), and over those of the second within it.
    """
    first, second = levels
    n, before, inner = "pair_rows", "rows_before", "rows_before_in_first"
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias(n))
    larger = Window.orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = pairs.groupBy(first).agg(F.sum(n).alias("all")).select(first, F.coalesce(F.sum("all").over(larger), F.lit(0)).alias(before))
    within = Window.partitionBy(first).orderBy(F.desc(second)).rowsBetween(Window.unboundedPreceding, -1)
    places = pairs.select(first, second, F.coalesce(F.sum(n).over(within), F.lit(0)).alias(inner)).join(firsts, first)
    place = F.row_number().over(Window.partitionBy(first, second).orderBy(*ties))
    return (
        df.withColumn(index, place).join(places, [first, second])
        .withColumn(index, (F.col(index) + F.col(before) + F.col(inner) + F.lit(start - 1)).cast("long"))
        .select(*df.columns, index)
    )
