"""Messages along each competitor's own timeline, and right after sign-up."""

from pyspark.sql import functions as F

from hitprism.functions import holidays, offers, times
from hitprism.operators.filters import first_hours
from hitprism.operators.messages import messages
from hitprism.operators.prepare import with_holiday_label, with_message_kind
from hitprism.plans.groups import with_group_values
from hitprism.schema import HIT_ID

DEFAULT_EMAIL_TYPE = "Informational"


def _with_day_offset(rows):
    """Days since the competitor's first message. The first date is one row per
    competitor, so the table itself is not shuffled."""
    first = F.to_date(F.min("created_at")).alias("first_date")
    offset = F.datediff(F.to_date("created_at"), "first_date").cast("long")
    return (
        with_group_values(rows, ["competitor_name"], [first], keep_unkeyed=True)
        .withColumn("day_offset", offset)
        .withColumn("day_label", F.concat(F.lit("Day "), F.col("day_offset").cast("string")))
        .drop("first_date")
    )


_TIMELINE = ["competitor_name", "created_at", "day_offset", "day_label", "type", "subject"]


def timeline(hits):
    """Every row with its day on the competitor's timeline and its kind."""
    rows = hits.select("competitor_name", "created_at", "email_type", "type", "subject")
    return with_message_kind(_with_day_offset(rows)).select(*_TIMELINE)


def holiday_timeline(hits):
    """``timeline`` with holidays: label, and marker of seasonal messages."""
    rows = hits.select(
        HIT_ID,
        "competitor_name",
        times.parse_lenient(F.col("created_at")).alias("created_at"),
        "email_type",
        "type",
        "subject",
        "holiday",
        *[c for c in ("translated_content", "holiday_label") if c in hits.columns],
    )
    # label first: it lets the message text go before rows move
    rows = with_message_kind(with_holiday_label(rows).drop("translated_content"))
    holiday = F.col("holiday")
    seasonal = holiday.isin(holidays.SEASONS)
    marker = (
        F.when(holiday == holidays.CHRISTMAS, F.lit(holidays.CHRISTMAS_MARKER))
        .when(holiday == holidays.BLACK_FRIDAY, F.lit(holidays.BLACK_FRIDAY_MARKER))
        .otherwise(F.lit(""))
    )
    return _with_day_offset(rows).select(
        *_TIMELINE,
        "holiday",
        F.when(seasonal, holiday).otherwise(F.col("type")).alias("color_label"),
        marker.alias("marker"),
    )


def _first48(rows, *keys):
    early = first_hours(rows, 48).where(F.col("competitor_name").isNotNull())
    return early.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_SENT = ["competitor_name", "local_created_at", "tracking_start_at"]


def first48_volume(hits, deduped=False):
    """Messages in the first 48 hours per competitor."""
    return _first48(messages(hits, *_SENT, deduped=deduped), "competitor_name")


def first48_email_types(hits, deduped=False):
    """Messages in the first 48 hours per competitor and email type."""
    rows = messages(hits, *_SENT, "email_type", deduped=deduped)
    rows = rows.withColumn("email_type", F.coalesce("email_type", F.lit(DEFAULT_EMAIL_TYPE)))
    return _first48(rows, "competitor_name", "email_type")


def first48_promo_types(hits, deduped=False, order=None):
    """Messages in the first 48 hours per competitor and offer type.

    The offers of a message differ, so its first row decides: ``order``, else
    the load order.
    """
    rows = messages(hits, *_SENT, "type", deduped=deduped, order=order)
    rows = rows.withColumn("type", offers.type_or_default(F.col("type")))
    return _first48(rows, "competitor_name", "type")
