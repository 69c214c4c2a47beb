"""What messages look like: subjects, kinds, tone, emoji."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.functions import numbers, offers, text
from hitprism.operators.messages import first_rows, messages
from hitprism.plans.groups import ranked
from hitprism.plans.shared import shared_table
from hitprism.plans.texts import TEXT_KEYS, text_keys, text_values, with_text_value
from hitprism.schema import HIT_ID

TOP_EMOJI = 5

# The email types that the promotion report looks at.
PROMO_EMAIL_TYPES = ["Welcome", "Informational", "System", "Transactional", "Promotional"]

# What the content reports need of a message's texts. Taken before messages
# are formed, so that the texts themselves are never shuffled.
_FEATURES = ["subject_chars", "subject_emoji", "content_emoji"]


def with_emoji(hits):
    """Add the emoji of subject and content; contents are searched once each."""
    found = with_text_value(hits, "content", "content_emoji", text.emoji_only)
    return found.withColumn("subject_emoji", text.emoji_only(F.col("subject")))


def with_text_features(hits):
    """Add the length of the subject and the emoji of subject and content."""
    if all(c in hits.columns for c in _FEATURES):
        return hits
    return with_emoji(hits).withColumn("subject_chars", F.length(text.strip(F.col("subject"))).cast("long"))


def _with_subject_chars(hits):
    if "subject_chars" in hits.columns:
        return hits
    return hits.withColumn("subject_chars", F.length(text.strip(F.col("subject"))).cast("long"))


def _length_band(chars):
    """Colour of an average subject length: green is best, red is worst."""
    return (
        F.when((chars < 24) | (chars > 42), F.lit("red"))
        .when((chars < 30) | (chars > 36), F.lit("yellow"))
        .otherwise(F.lit("green"))
    )


def subject_length(hits, deduped=False):
    """Average subject length per competitor, longest first, and its band."""
    mean = numbers.round_half_even(F.avg("subject_chars"), 2)
    return (
        messages(_with_subject_chars(hits), "competitor_name", "subject_chars", deduped=deduped)
        .dropna(subset=["competitor_name", "subject_chars"])
        .groupBy("competitor_name")
        .agg(mean.alias("avg_subject_length"))
        .withColumn("band", _length_band(F.col("avg_subject_length")))
        .orderBy(F.desc("avg_subject_length"), "competitor_name")
    )


def _shares(rows, column):
    """Count of each value per competitor and its percentage there."""
    keys = ["competitor_name", column]
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(HIT_ID).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("competitor_name"))
    return counts.withColumn("pct", numbers.percent(F.col("n"), whole, 1))


def _ranked_shares(rows, column):
    """``_shares`` with the place of each value by the sum of its percentages."""
    shares = _shares(rows, column)
    sums = shares.groupBy(column).agg(F.sum(F.col("pct").cast("decimal(28,1)")).alias("s"))
    ranks = ranked(sums, [F.desc("s"), F.asc(column)], "column_rank").drop("s")
    return shares.join(ranks, column).select("competitor_name", column, "n", "pct", "column_rank")


def content_types(hits, deduped=False):
    """Share of each email type per competitor."""
    rows = messages(hits, "competitor_name", "email_type", deduped=deduped)
    return _shares(rows, "email_type")


def promo_types(hits):
    """Share of each promotion type in a competitor's rows."""
    kind = offers.normal_type(offers.type_or_default(F.col("type")))
    rows = hits.where(F.col("email_type").isin(PROMO_EMAIL_TYPES)).select(
        HIT_ID, "competitor_name", offers.message_kind(F.col("email_type"), kind).alias("type")
    )
    return _ranked_shares(rows, "type")


def tonality(hits, deduped=False):
    """Share of each tone of voice per competitor."""
    rows = messages(hits, "competitor_name", "tone_of_voice", deduped=deduped)
    return _ranked_shares(rows, "tone_of_voice")


def _emoji_messages(hits):
    """Brand and emoji of each message. Messages are formed with the hashes of their
    contents, and only the contents that these then have are searched."""
    known = F.col("content").isNotNull()
    keyed = hits.withColumns({**text_keys("content", known), "subject_emoji": text.emoji_only(F.col("subject"))})
    firsts = shared_table(first_rows(keyed, "competitor_name", "subject_emoji", *TEXT_KEYS), "first-rows")
    found = text_values(hits, "content", "content_emoji", text.emoji_only, firsts)
    return firsts.join(found, TEXT_KEYS, "left").drop(*TEXT_KEYS)


def emoji_usage(hits, deduped=False):
    """Messages per competitor, how many use emoji, and the emoji used most."""
    columns = ["competitor_name", "subject_emoji", "content_emoji"]
    if deduped or all(c in hits.columns for c in _FEATURES):
        rows = messages(with_text_features(hits), *columns, deduped=deduped)
    else:
        rows = _emoji_messages(hits)
    rows = rows.where(F.col("competitor_name").isNotNull())

    def using(column):
        used = F.count_if(F.length(column) > 0)
        return numbers.percent(used, F.count(column), 2)

    totals = rows.groupBy("competitor_name").agg(
        F.count(F.lit(1)).alias("total"),
        using("subject_emoji").alias("subject_pct"),
        using("content_emoji").alias("content_pct"),
    )
    emoji = F.concat(*[F.coalesce(c, F.lit("")) for c in columns[1:]])
    most_used = Window.partitionBy("competitor_name").orderBy(F.desc("n"), "emoji")
    shown = F.concat("emoji", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    in_order = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))
    top = (
        rows.select("competitor_name", emoji.alias("emoji"))
        .where(F.length("emoji") > 0)
        .select("competitor_name", F.explode(text.emoji_list(F.col("emoji"))).alias("emoji"))
        .groupBy("competitor_name", "emoji")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("place", F.row_number().over(most_used))
        .where(F.col("place") <= TOP_EMOJI)
        .groupBy("competitor_name")
        .agg(F.array_join(in_order["shown"], ", ").alias("top_emojis"))
    )
    return totals.join(top, "competitor_name", "left").withColumn(
        "top_emojis", F.coalesce("top_emojis", F.lit(""))
    )
