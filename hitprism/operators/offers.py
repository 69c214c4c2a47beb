"""Which offers are made: top offers, mixes, pairs, play values (row level)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.functions import offers
from hitprism.operators.counts import N_ROWS, n_rows_column
from hitprism.plans.groups import broadcast_top, top_rows
from hitprism.schema import HIT_ID

# Types that stand for "no offer", and the type whose play value
# is reported.
NO_OFFER_TYPES = ["No Promo", "No Promo - No Values"]
FREE_SPINS = "Free Spins"

SCOPES = ["overall", "per_lifecycle", "per_competitor"]


def _labelled(hits, *columns):
    label = offers.offer_label(F.col("type"), F.col("value")).alias("offer_label")
    kind = offers.type_or_default(F.col("type")).alias("type")
    return hits.select(*columns, kind, label, n_rows_column(hits))


def top_offers_no_promo(hits, n=30):
    """The offers seen most, without the rows that carry none, per competitor.

    Only the ``n`` best offers are broadcast to pick their detail rows.
    """
    rows = _labelled(hits, "competitor_name")
    rows = rows.where(~F.col("type").isin(NO_OFFER_TYPES) & F.col("competitor_name").isNotNull())
    counts = rows.groupBy("competitor_name", "offer_label").agg(F.sum(N_ROWS).alias("n"))
    stats = counts.groupBy("offer_label").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_competitors")
    )
    order = [F.desc("total"), F.desc("n_competitors"), F.asc("offer_label")]
    best = top_rows(stats, n, order, "offer_rank").select("offer_label", "offer_rank")
    return counts.join(broadcast_top(best, n), "offer_label").select(
        "offer_rank", "offer_label", "competitor_name", "n"
    )


def top_offers(hits, n=30):
    """The offers seen most, grouped by type, per competitor."""
    keys = ["type", "offer_label"]
    counts = (
        _labelled(hits, "competitor_name")
        .where(F.col("competitor_name").isNotNull())
        .groupBy(*keys, "competitor_name")
        .agg(F.sum(N_ROWS).alias("n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    best = totals.orderBy(F.desc("total"), *keys).limit(n)
    ranked = top_rows(best, n, [F.asc("type"), F.desc("total"), F.asc("offer_label")], "offer_rank")
    return counts.join(broadcast_top(ranked, n), keys).select(
        "offer_rank", "type", "offer_label", "total", "competitor_name", "n"
    )


def offer_mix(hits, scope="overall"):
    """Rows per competitor and offer with their subtotals, overall or for each
    lifecycle, or rows per offer for each competitor."""
    if scope not in SCOPES:
        raise ValueError("scope must be one of: " + " | ".join(SCOPES))
    rows = _labelled(hits, "competitor_name", "lifecycle")
    if scope == "per_lifecycle":
        part, path = F.col("lifecycle"), ["competitor_name", "offer_label"]
    elif scope == "per_competitor":
        part, path = F.col("competitor_name"), ["offer_label"]
    else:
        part, path = F.lit("overall"), ["competitor_name", "offer_label"]
    rows = rows.withColumn("scope_value", part).where(F.col("scope_value").isNotNull())

    # count first, so that only the few counted rows are expanded to subtotals
    keys = ["scope_value", *path]
    counts = rows.groupBy(*keys).agg(F.sum(N_ROWS).alias("n"))
    key_columns = [F.col(k) for k in keys]
    sets = [key_columns[: 1 + depth] for depth in range(len(path), -1, -1)]
    depth = sum((F.lit(1) - F.grouping(p).cast("int") for p in path), F.lit(0))
    level = F.element_at(F.array(F.lit("all"), *[F.lit(p) for p in path]), depth + 1)
    mix = counts.groupingSets(sets, *keys).agg(F.sum("n").alias("n"), level.alias("level"))
    if scope == "per_competitor":
        mix = mix.withColumn("competitor_name", F.col("scope_value"))
    return mix.select("scope_value", "competitor_name", "offer_label", "n", "level")


def offer_pairs(hits, n=20):
    """How often two of the ``n`` most common offers are in one message; with
    itself, an offer is in as many messages as hold it.

    Messages are first reduced to their set of top offers, then equal sets are
    counted. Pairs are formed once per distinct set, never per message.
    """
    rows = _labelled(hits, HIT_ID)
    totals = rows.groupBy("offer_label").agg(F.count(F.lit(1)).alias("total"))
    best = top_rows(totals, n, [F.desc("total"), F.asc("offer_label")], "place")
    best = best.select("offer_label", "place")
    sets = (
        rows.where(F.col(HIT_ID).isNotNull())
        .join(broadcast_top(best, n), "offer_label")
        .groupBy(HIT_ID)
        .agg(F.array_sort(F.collect_set("place")).alias("offers"))
        .groupBy("offers")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    pairs = (
        sets.select("messages", "offers", F.explode("offers").alias("a"))
        .select("messages", "a", F.explode("offers").alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("messages").alias("n"))
    )
    first = best.select(F.col("offer_label").alias("offer_a"), F.col("place").alias("a"))
    second = best.select(F.col("offer_label").alias("offer_b"), F.col("place").alias("b"))
    return (
        pairs.join(broadcast_top(first, n), "a")
        .join(broadcast_top(second, n), "b")
        .select("offer_a", "offer_b", "n")
    )


def play_value_modes(hits):
    """The most frequent play value of each Free Spins offer per competitor;
    one row for each of several equally frequent ones."""
    keys = ["competitor_name", "promotion_type", "value"]
    counts = (
        hits.where(F.col("promotion_type") == FREE_SPINS)
        .dropna(subset=[*keys, "play_value"])
        .groupBy(*keys, "play_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))
    return (
        counts.withColumn("place", place)
        .where((F.col("place") == 1) & (F.col("play_value") != ""))
        .select(*keys, "play_value", "n")
    )


def play_value(hits):
    """``play_value_modes`` with the modes of an offer joined by ``, ``."""
    keys = ["competitor_name", "promotion_type", "value"]
    modes = F.array_join(F.array_sort(F.collect_list("play_value")), ", ")
    return play_value_modes(hits).groupBy(*keys).agg(modes.alias("modes")).orderBy(*keys)
