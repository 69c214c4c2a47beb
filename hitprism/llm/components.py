"""Connected components of a graph given as a table of links."""

from pyspark.sql import functions as F

from hitprism.llm.stored import stored


def _to_smallest(links):
    """Large star: each node's larger neighbours get its smallest neighbour."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.join(least, "a").where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )


def _tie_smaller(links):
    """Small star: each node's smaller neighbours get the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()


def components(links):
    """Rows (node, root) for nodes with links: the smallest node reachable.

    ``links``: rows (a, b) of distinct non-null values, any direction. Stars are
    drawn to smaller nodes until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Each round is stored; the driver
    sees a count and a checksum only.
    """
    now = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = _state(now)
    while state[0]:
        now = stored(_tie_smaller(_to_smallest(now)), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
