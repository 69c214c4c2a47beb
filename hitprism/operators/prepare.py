"""Columns that several reports share, added to the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.functions import holidays, offers, text
from hitprism.plans.texts import once, with_text_value
from hitprism.schema import HIT_ID, ROW_ORDER

# Length of a joined subject list, and the subjects that can matter for it:
# distinct texts joined by "; " take 3 characters each, but for one empty text.
SUBJECTS_LENGTH = 2000
SUBJECTS_NEEDED = 700


def prepare_offers(df):
    """Fill type and value; add offer_label, numeric_value, date and month."""
    local = F.col("local_created_at")
    return df.withColumns(
        {
            "offer_label": offers.offer_label(F.col("type"), F.col("value")),
            "numeric_value": offers.first_number(F.col("value")),
            "type": offers.type_or_default(F.col("type")),
            "value": offers.value_or_default(F.col("value")),
            "date": F.to_date(local),
            "month": F.date_format(local, "yyyy-MM"),
        }
    )


def with_message_kind(df):
    """Replace type: none becomes ``No Promo``, then the kind of message."""
    filled = offers.type_or_default(F.col("type"))
    return df.withColumn("type", offers.message_kind(F.col("email_type"), filled))


def with_normal_type(df):
    return df.withColumn("type", offers.normal_type(F.col("type")))


def with_sender_domain(df, unicode_words=True):
    return df.withColumn("from_domain", text.sender_domain(F.col("from"), unicode_words))


def with_offer_text(df):
    cols = [F.col(c) for c in ("type", "value", "play_value")]
    return df.withColumn("offer_text", offers.offer_text(*cols))


def _with_season(df, column, rule, needs_text):
    """Apply a holiday rule. Texts are looked at only where the holiday column does
    not decide, and each distinct one once; what joins it to the subject, in each row."""
    holiday, text = F.col("holiday"), F.col("translated_content")
    # first what needs the text of each row, so that it goes before rows are joined
    edge = F.when(needs_text(holiday), F.lower(holidays.joined_edge(F.col("subject"), text)))
    edged = df.select("*", once(edge, "edge")).withColumn("edge_marks", holidays.season_marks(F.col("edge")))
    marked = with_text_value(edged, "translated_content", "text_marks", holidays.season_marks, needs_text(holiday), F.lower)

    def marks(name):
        return F.coalesce(F.col("text_marks")[name], F.lit(False)) | F.coalesce(F.col("edge_marks")[name], F.lit(False))

    return marked.withColumn(column, rule(holiday, marks)).drop("text_marks", "edge_marks", "edge")


def with_holiday_type(df):
    """Add the season. A ``holiday_type`` the rows have already is taken as it
    is, so that several reports can share one search of the texts."""
    if "holiday_type" in df.columns:
        return df
    return _with_season(df, "holiday_type", holidays.holiday_type, holidays.type_needs_text)


def with_holiday_label(df):
    """Replace holiday by its normal label, or by ``holiday_label`` where the
    rows have that already."""
    if "holiday_label" in df.columns:
        return df.withColumn("holiday", F.col("holiday_label")).drop("holiday_label")
    return _with_season(df, "holiday", holidays.holiday_label, holidays.label_needs_text)


def with_seasons(df):
    """Add ``holiday_type`` and ``holiday_label``, for reports to share."""
    typed = with_holiday_type(df)
    labels = with_holiday_label(typed.withColumn("given_holiday", F.col("holiday")))
    return labels.withColumnRenamed("holiday", "holiday_label").withColumnRenamed("given_holiday", "holiday")


def subject_rollup(df):
    """Instances and joined distinct subjects per competitor and offer.

    Subjects are joined in the order they are first seen, if the rows know their load
    order, else in name order, and cut at 2000 characters; so only the first few
    hundred of a group can show. Each task keeps those of its own rows before the
    shuffle, and no group is collected whole.
    """
    loaded = [ROW_ORDER] if ROW_ORDER in df.columns else []
    keys = ["competitor_name", "offer_label"]
    rows = df.select(
        *keys[:1],
        offers.offer_label(F.col("type"), F.col("value")).alias("offer_label"),
        "subject",
        HIT_ID,
        *loaded,
    )
    # null subjects form one group of their own, so that no row is lost
    seen = F.min(ROW_ORDER) if loaded else F.lit(0)
    counts = rows.groupBy(*keys, "subject").agg(F.count(HIT_ID).alias("n"), seen.alias("seen"))
    instances = counts.groupBy(*keys).agg(F.sum("n").alias("instances"))
    in_order = Window.partitionBy(*keys).orderBy("seen", "subject")
    joined = (
        counts.where(F.col("subject").isNotNull())
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= SUBJECTS_NEEDED)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("seen", "subject")))["subject"].alias("list"))
        .select(
            *keys,
            F.substring(F.array_join("list", "; "), 1, SUBJECTS_LENGTH).alias("subjects"),
        )
    )
    same = [instances[k].eqNullSafe(joined[k]) for k in keys]
    return instances.join(joined, same, "left").select(
        *[instances[k] for k in keys],
        "instances",
        F.coalesce("subjects", F.lit("")).alias("subjects"),
    )
