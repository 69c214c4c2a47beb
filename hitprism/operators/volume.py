"""How much each competitor sends: counts, velocity, cross-tabs."""

from pyspark.sql import functions as F

from hitprism.functions import numbers, times
from hitprism.operators.counts import n_rows
from hitprism.operators.messages import messages
from hitprism.plans.groups import numbered
from hitprism.schema import HIT_ID

TOTAL_NAME = "TOTAL"
TOTAL_COUNTRY = "ALL"
CHANNELS = ["email", "sms", "calls"]


def _no_nulls(df, *columns):
    return df.dropna(subset=list(columns))


def _count(df, *keys):
    """Rows per key combination; rows with a null key do not count."""
    return _no_nulls(df, *keys).groupBy(*keys).agg(n_rows(df).alias("n"))


def competitor_table(hits, deduped=False):
    """Messages per competitor and country, and their grand total."""
    pair = ["competitor_name", "country"]
    counts = _count(messages(hits, *pair, deduped=deduped), *pair)
    # the same counted shuffle serves both parts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(TOTAL_NAME).alias(pair[0]), F.lit(TOTAL_COUNTRY).alias(pair[1]), "n"
    )
    return (
        counts.withColumn("is_total", F.lit(False))
        .unionByName(total.withColumn("is_total", F.lit(True)))
        .orderBy("is_total", F.desc("n"), *pair)
    )


def competitor_volume(hits, deduped=False):
    """Messages per competitor, most first."""
    counts = _count(messages(hits, "competitor_name", deduped=deduped), "competitor_name")
    return counts.orderBy(F.desc("n"), "competitor_name")


def _velocity(hits, days, deduped):
    keys = ["competitor_name", "tracking_id", "lifecycle"]
    sent = times.parse_lenient(F.col("local_created_at"))
    first, last = F.col("first"), F.col("last")
    period = (F.datediff(last, first) + 1).cast("long")
    weekly = numbers.round_half_even(F.col("volume") * 7 / F.lit(float(max(days, 1))), 2)
    return (
        messages(hits, *keys, "local_created_at", deduped=deduped)
        .withColumn("sent", sent)
        .where(F.col("sent").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(HIT_ID).alias("volume"),
            F.min("sent").alias("first"),
            F.max("sent").alias("last"),
        )
        .select(
            "competitor_name",
            "tracking_id",
            "volume",
            F.date_format(first, times.SHORT_DATE).alias("min_date_str"),
            F.date_format(last, times.SHORT_DATE).alias("max_date_str"),
            period.alias("active_period"),
            "lifecycle",
            weekly.alias("weekly_velocity"),
        )
    )


def _velocity_ties():
    return [F.asc_nulls_last(c) for c in ("competitor_name", "tracking_id", "lifecycle")]


def velocity(hits, days=30, deduped=False):
    """Volume, active dates and weekly velocity per account and lifecycle."""
    return _velocity(hits, days, deduped).orderBy(
        F.asc_nulls_last("competitor_name"), F.desc("active_period"), *_velocity_ties()[1:]
    )


# Fixed value: what the whole time looked at is called.
_SINCE_CREATION = "Since Creation -"


def _labelled(table, period):
    name = {"all_time": _SINCE_CREATION, None: "", "": ""}.get(period, str(period).capitalize())
    days = F.format_string("%s %d days", F.lit(name), "active_period")
    return table.withColumns(
        {
            "weekly_velocity": F.coalesce("weekly_velocity", F.lit(0.0)),
            "period": F.coalesce(F.when(F.col("active_period").isNotNull(), F.trim(days)), F.lit(name)),
        }
    )


def velocity_labelled(hits, period="first", days=30, deduped=False):
    """``velocity`` with a text for the period looked at, fastest first."""
    table = _labelled(_velocity(hits, days, deduped), period)
    return table.orderBy(F.desc("weekly_velocity"), *_velocity_ties())


def velocity_share(hits, days=30, deduped=False):
    """Share of each account in the velocity of all; accounts without any are
    left out. Lifecycles of an account add up to one slice."""
    money = "decimal(28,2)"  # velocities have 2 decimals: exact in any order
    account = F.coalesce(F.col("tracking_id").cast("string"), F.lit(""))
    name = F.concat(account, F.lit(" — "), F.coalesce("competitor_name", F.lit("")))
    slices = (
        _velocity(hits, days, deduped)
        .where(F.col("weekly_velocity") > 0)
        .groupBy(name.alias("slice_name"))
        .agg(F.sum(F.col("weekly_velocity").cast(money)).alias("v"))
    )
    whole = slices.agg(F.sum("v").cast("double").alias("whole")).scalar()
    own = F.col("v").cast("double")
    return slices.select("slice_name", own.alias("weekly_velocity"), (own / whole).alias("share"))


def frequency_table(hits, days=30, deduped=False):
    """``velocity``, longest active and then fastest first, numbered from 0."""
    levels = ["active_period", "weekly_velocity"]
    return numbered(_velocity(hits, days, deduped), levels, _velocity_ties(), "idx", start=0)


def cross_tab(hits, deduped=False):
    """Messages per competitor, vertical, lifecycle and channel."""
    keys = ["competitor_name", "vertical", "lifecycle", "channel"]
    return _count(messages(hits, *keys, deduped=deduped), *keys)


def hits_over_time(hits):
    """Rows per day of ``created_at``."""
    return _count(hits.withColumn("date", F.to_date("created_at")), "date")


def channel_mix(hits):
    """Rows per competitor and channel, whatever channels there are, with the
    competitor's total and the channel's percentage of it."""
    per_channel = _count(_no_nulls(hits, "competitor_name"), "competitor_name", "channel")
    totals = per_channel.groupBy("competitor_name").agg(F.sum("n").alias("total"))
    return per_channel.join(totals, "competitor_name").withColumn("pct", F.col("n") / F.col("total") * 100)


def channel_mix_wide(hits, channels=CHANNELS):
    """``channel_mix`` with a column per given channel and one for all others."""
    is_named = F.coalesce(F.col("channel").isin(channels), F.lit(False))
    named = [F.count_if(F.col("channel") == c).alias(c) for c in channels]
    mix = _no_nulls(hits, "competitor_name").groupBy("competitor_name").agg(
        *named, F.count_if(~is_named).alias("other"), F.count(F.lit(1)).alias("total"))
    return mix.withColumns({f"{c}_pct": F.col(c) / F.col("total") * 100 for c in [*channels, "other"]})


def promo_type_counts(hits):
    return _count(hits, "promotion_types")


def promo_by_category(hits):
    return _count(hits, "promotion_types", "category")


def classification_counts(hits):
    return _count(hits, "classification")


def channel_type_counts(hits):
    return _count(hits, "channel_type")
