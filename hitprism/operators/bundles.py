"""Offers sent together in one message."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.functions import offers
from hitprism.plans.groups import top_rows
from hitprism.schema import HIT_ID

LABEL_LENGTH = 180
SEPARATOR = " | "
ELLIPSIS = "…"

# An offer label has 3 characters at least (" - "), so 32 labels and their
# separators already exceed the length of a bundle's label.
OFFERS_SHOWN = 32


def bundle_sizes(hits, min_size=1):
    """Messages per number of rows they have."""
    sizes = (
        hits.where(F.col(HIT_ID).isNotNull())
        .groupBy(HIT_ID)
        .agg(F.count(F.lit(1)).alias("bundle_size"))
    )
    return (
        sizes.where(F.col("bundle_size") >= min_size)
        .groupBy("bundle_size")
        .agg(F.count(F.lit(1)).alias("n_hits"))
        .orderBy("bundle_size")
    )


def message_bundles(hits, min_size=2):
    """Each message's number of distinct offers, and their names as one label.

    The label is cut, so only the first offers in name order can show. Each
    task keeps those of its own rows before the shuffle; a message is never
    collected whole, however many offers it has. Pairs are grouped as one struct, so
    that they are dealt anew, once, for both uses, also where the rows are dealt by
    message already: else one task would hold all steps' tables at the same time.
    """
    label = offers.offer_label(F.col("type"), F.col("value")).alias("offer_label")
    pairs = hits.where(F.col(HIT_ID).isNotNull()).select(F.struct(HIT_ID, label).alias("pair")).distinct().select("pair.*")
    sizes = (
        pairs.groupBy(HIT_ID)
        .agg(F.count(F.lit(1)).alias("bundle_size"))
        .where(F.col("bundle_size") >= min_size)
    )
    by_name = Window.partitionBy(HIT_ID).orderBy("offer_label")
    shown = (
        pairs.withColumn("place", F.row_number().over(by_name))
        .where(F.col("place") <= OFFERS_SHOWN)
        .groupBy(HIT_ID)
        .agg(F.array_join(F.array_sort(F.collect_list("offer_label")), SEPARATOR).alias("text"))
    )
    text = F.col("text")
    cut = F.concat(F.substring(text, 1, LABEL_LENGTH), F.lit(ELLIPSIS))
    label = F.when(F.length(text) > LABEL_LENGTH, cut).otherwise(text)
    return sizes.join(shown, HIT_ID).select(HIT_ID, label.alias("bundle_label"), "bundle_size")


def _bundle_order():
    return [F.desc("bundle_size"), F.desc("n"), F.asc("bundle_label")]


def _bundle_counts(hits, min_size):
    return (
        message_bundles(hits, min_size)
        .groupBy("bundle_label", "bundle_size")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bundles(hits, min_size=2):
    """Messages per bundle, largest and then most frequent bundles first."""
    return _bundle_counts(hits, min_size).orderBy(*_bundle_order())


def bundle_tree(hits, min_size=2):
    """Messages per bundle with subtotals per bundle size."""
    bucket = F.concat(F.lit("Bundles of "), F.col("bundle_size").cast("string"))
    counts = _bundle_counts(hits, min_size).withColumn("size_bucket", bucket)
    keys = ["size_bucket", "bundle_label"]
    level = (
        F.when(F.grouping("size_bucket") == 1, F.lit("all"))
        .when(F.grouping("bundle_label") == 1, F.lit("size_bucket"))
        .otherwise(F.lit("bundle_label"))
    )
    return (
        counts.rollup(*keys)
        .agg(F.sum("n").alias("n"), level.alias("level"))
        .where(F.col("n").isNotNull())
    )


def top_bundles(hits, n=20, min_size=2):
    """The first ``n`` bundles of ``bundles``, numbered from 1."""
    counts = _bundle_counts(hits, min_size)
    return top_rows(counts, n, _bundle_order(), "rank").select(
        "rank", "bundle_label", "bundle_size", "n"
    )
