"""Seasonal campaigns: Black Friday and Christmas (row level)."""

from pyspark.sql import functions as F

from hitprism.functions import holidays, offers, times
from hitprism.operators.prepare import with_holiday_label, with_holiday_type, with_offer_text
from hitprism.schema import HIT_ID, ROW_ORDER


def _seasonal(hits):
    return with_holiday_type(hits).where(
        F.col("competitor_name").isNotNull() & F.col("holiday_type").isNotNull()
    )


def seasonal_first(hits):
    """The first message of each competitor for each season.

    Messages of the same moment: the first by load order if the table has it,
    else by id and offer.
    """
    names = {
        "local_created_at": "first_date",
        "subject": "first_subject",
        "offer_text": "first_offer",
        "play_value": "first_wager",
        "deposit_requirement": "first_requirements",
    }
    ties = [ROW_ORDER] if ROW_ORDER in hits.columns else [HIT_ID, *list(names)[1:]]
    row = F.struct("local_created_at", *ties, F.struct(*names).alias("row"))
    first = (
        _seasonal(with_offer_text(hits))
        .where(F.col("local_created_at").isNotNull())
        .groupBy("competitor_name", "holiday_type")
        .agg(F.min(row)["row"].alias("first"))
    )
    shown = [F.col("first")[c].alias(name) for c, name in names.items()]
    return first.select("competitor_name", "holiday_type", *shown)


def seasonal_activity(hits):
    """Distinct messages per competitor and season; 0 where a competitor that
    takes part in one season sits out the other."""
    counts = (
        _seasonal(hits)
        .select("competitor_name", "holiday_type", HIT_ID)
        .distinct()
        .groupBy("competitor_name")
        .agg(*[_of_season(s).alias(s) for s in holidays.SEASONS])
    )
    return counts.unpivot(
        "competitor_name", [f"`{s}`" for s in holidays.SEASONS], "holiday_type", "n"
    )


def _of_season(season):
    return F.count(F.when(F.col("holiday_type") == season, F.col(HIT_ID)))


def holiday_promos(hits, competitor=None):
    """One row per seasonal message with its offers, wagers and requirements."""
    by_load = ROW_ORDER in hits.columns
    order = F.col(ROW_ORDER) if by_load else F.struct("local_created_at", "subject")
    with_subject = F.when(F.col("subject").isNotNull(), order)

    def joined(column):
        return F.array_join(F.array_sort(F.collect_set(column)), ", ")

    offer = F.nullif(offers.value_or_default(F.col("value")), F.lit(""))
    rows = with_holiday_label(hits).where(F.col("holiday").isin(holidays.SEASONS))
    if competitor is not None:
        rows = rows.where(F.col("competitor_name") == competitor)
    keys = ["competitor_name", HIT_ID, "holiday"]
    return (
        rows.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            F.min("local_created_at").alias("first_at"),
            F.min_by("subject", with_subject).alias("subject"),
            joined(offer).alias("offer"),
            joined("play_value").alias("wager"),
            joined("deposit_requirement").alias("requirements"),
        )
        .orderBy("competitor_name", "first_at", HIT_ID)
        .select(
            *keys,
            F.date_format("first_at", times.LONG_DATE).alias("date"),
            "subject",
            "offer",
            "wager",
            "requirements",
        )
    )
