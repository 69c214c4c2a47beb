"""Every operator as a named query over the star schema tables.

A query is ``(spark, folder) -> DataFrame``. Names are the operator ids of
"""

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.functions import holidays
from hitprism.functions import offers as offer_columns
from hitprism.functions import text, times
from hitprism.operators import (
    bundles,
    clock,
    content,
    counts,
    filters,
    holiday,
    offers,
    prepare,
    sender,
    summary,
    timeline,
    volume,
)
from hitprism.operators.messages import first_rows
from hitprism.operators.wide import cross_tab_label, widen
from hitprism.plans.shared import shared_folder
from hitprism.schema import HIT_ID
from hitprism.sources.hits import parse_times, read_hits, read_rejects, write_report
from hitprism.sources.star import address_ranges, hits_from_star, ip_dim, networks

# The tables' orders date from 1995 to 2001.
YEAR = 1998
FIRST_DAY, LAST_DAY = dt.date(1996, 3, 1), dt.date(1999, 6, 30)
COMPETITOR = "NATION_7"
# What a user chose, filter by filter.
CHOSEN = {"vertical": ["Casino", "Sports"], "lifecycle": ["BUILDING", "MACHINERY"], "category": ["1-URGENT", "5-LOW"], "channel": ["email"]}
# Rows of a compressed CSV file, which one task reads.
CSV_ROWS = 250_000
# Columns of the wide cross-tab, known from the tables' values.
CROSS_COLUMNS = [
    f"{vertical} | {lifecycle} | {channel}"
    for vertical in ("Casino", "Sports", "Poker")
    for lifecycle in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    for channel in ("email", "sms", "calls", "push")
]


def digested(df):
    """Whole message texts as digests, which keeps a large result small."""
    return df.withColumns(
        {c: F.md5(c) for c in ("content", "translated_content") if c in df.columns}
    )


def _type_order(*columns):
    """Order by columns, nulls last."""
    order = []
    for i, c in enumerate(columns):
        order += [F.col(c).isNull().alias(f"no_{i}"), F.col(c)]
    return order


def _as_text(hits, broken):
    """created_at as text; where ``broken``, a text that is no timestamp."""
    created = F.col("created_at").cast("string")
    bad = F.concat(F.lit("no time "), F.col("category"))
    is_bad = F.coalesce(F.col("play_value") == "", F.lit(False)) & F.lit(broken)
    return hits.select(HIT_ID, "play_value", F.when(is_bad, bad).otherwise(created).alias("created_at"))


def _stored_report(hits):
    spark = hits.sparkSession
    path = f"{shared_folder(spark)}/reports/competitor_volume-{uuid.uuid4().hex}"
    write_report(volume.competitor_volume(hits), path)
    return spark.read.parquet(path)


def _rejects(hits):
    """Hits as CSV, some of them with an id that is no number: clean and rejected rows
    per channel, and the rows kept with nulls."""
    spark = hits.sparkSession
    path = f"{shared_folder(spark)}/reports/hits-{uuid.uuid4().hex}"
    bad = F.when(F.col("category") == "1-URGENT", F.lit("none")).otherwise(F.col("tracking_id").cast("string"))
    plain = hits.withColumns({"content": F.lit("x"), "translated_content": F.lit("x"), "tracking_id": bad})
    plain.write.options(header="true", compression="gzip", maxRecordsPerFile=CSV_ROWS).csv(path)
    clean, lenient = (read_hits(spark, path, "csv", bad=b) for b in ("drop", "null"))
    rejects = read_rejects(spark, path, "csv")
    counted = [clean.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("clean")),
               lenient.where("tracking_id IS NULL").groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("null")),
               rejects.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("channel"), "n", F.lit("rejected").alias("kind"))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _domains(hits):
    return prepare.with_sender_domain(hits, unicode_words=False).select(HIT_ID, "from", "from_domain")


def _emoji(hits):
    found = content.with_emoji(hits)
    return found.select(
        HIT_ID,
        *[f(F.col(f"{c}_emoji")).alias(f"{c}_{name}")
          for c in ("subject", "content")
          for name, f in (("emoji", lambda e: e), ("has_emoji", text.any_emoji))],
    )


def _calendar_parts(hits):
    ts = F.col("local_created_at")
    return hits.select(
        HIT_ID,
        times.weekday_name(times.weekday_number(ts)).alias("day_of_week"),
        times.hour_of_day(ts).alias("hour"),
        F.day(ts).cast("long").alias("day"),
        F.month(ts).cast("long").alias("month"),
    )


def _some_v6(hits):
    """Hits whose IPv4 senders are IPv6 ones for every third account."""
    parts = F.split("from_ip", r"\.")
    v6 = F.concat(F.lit("2001:DB8::"), parts[2], F.lit(":0:0:"), parts[3])
    return hits.withColumn("from_ip", F.when(F.col("tracking_id") % 3 == 0, v6).otherwise(F.col("from_ip")))


def _nullable(df, column):
    """A whole number that may be null, as double: the one form in which all
    engines hand it out alike."""
    return df.withColumn(column, F.col(column).cast("double"))


def _kind(hits):
    rows = hits.select(HIT_ID, "email_type", F.col("type").alias("given_type"), "type")
    return prepare.with_message_kind(rows)


def _normal_type(hits):
    rows = hits.select(HIT_ID, offer_columns.type_or_default(F.col("type")).alias("given_type"))
    return prepare.with_normal_type(rows.withColumn("type", F.col("given_type")))


OPERATORS = {
    # sources and sinks
    "S1": lambda h: digested(h),
    "S2": lambda h: parse_times(_as_text(h, False), ["created_at"], strict=True),
    "S3": lambda h: parse_times(_as_text(h, True), ["created_at"], strict=False),
    "S1_rejects": _rejects,
    "S4": _stored_report,
    # filters and periods
    "F1": lambda h: digested(
        filters.filter_in(
            h, {"country": ["ASIA", "EUROPE"], "channel": ["email", "sms"], "vertical": []}
        )
    ),
    "F1_long": lambda h: digested(filters.filter_in(h, {"tracking_id": [str(i) for i in range(1, 1201)]})),
    "F2": lambda h: digested(filters.filter_dates(h, FIRST_DAY, LAST_DAY)),
    "F3": lambda h: filters.filter_options(h, "competitor_name"),
    "F3_accounts": lambda h: filters.filter_options(h, "tracking_id"),
    "F3_cascade": lambda h: filters.filter_cascade(h, CHOSEN),
    "F4": filters.date_bounds,
    "F5": lambda h: digested(filters.filter_year(h, YEAR)),
    "P1": lambda h: digested(filters.first_n_days(h, 365)),
    "P2": lambda h: digested(filters.last_n_days(h, 365)),
    "P3": lambda h: digested(filters.first_hours(h, 48)),
    # shared columns
    "D1": lambda h: first_rows(
        h, order=_type_order("type", "value", "play_value", "deposit_requirement"), shown=digested
    ),
    "D2": lambda h: digested(prepare.prepare_offers(h)),
    "D3": _kind,
    "D4": _normal_type,
    "D5": _domains,
    "D6a": lambda h: prepare.with_holiday_type(h).select(HIT_ID, "holiday", "holiday_type"),
    "D6b": lambda h: prepare.with_holiday_label(h).select(HIT_ID, "holiday"),
    "D7": lambda h: prepare.with_offer_text(h).select(HIT_ID, "type", "value", "play_value", "offer_text"),
    "D8": _emoji,
    "D9": _calendar_parts,
    "D10": prepare.subject_rollup,
    # volume
    "R1": volume.competitor_table,
    "R2": volume.competitor_volume,
    "R3": volume.velocity,
    "R4": volume.velocity_labelled,
    "R4_all_time": lambda h: volume.velocity_labelled(h, "all_time", 7),
    "R5": volume.velocity_share,
    "R6": volume.frequency_table,
    "R7": volume.cross_tab,
    "R7_wide": lambda h: widen(
        volume.cross_tab(h), "competitor_name", cross_tab_label(), "n", CROSS_COLUMNS
    ),
    "R8": volume.hits_over_time,
    "R9": volume.channel_mix,
    "R9_wide": volume.channel_mix_wide,
    "R10": volume.promo_type_counts,
    "R11": volume.promo_by_category,
    "R12": volume.classification_counts,
    "R13": volume.channel_type_counts,
    "R8_R53_counts": lambda h: counts.row_counts(h).withColumns({c: F.to_date(c) for c in ("created_at", "local_created_at")}),
    # time of day and calendar
    "R14": clock.hour_heatmap,
    "R14_wide": lambda h: widen(clock.hour_heatmap(h), "day_of_week", "hour", "n", list(range(24))),
    "R15": clock.opportunities,
    "R16": clock.hour_heatmap_excluding,
    "R17": lambda h: clock.calendar(h, YEAR),
    "R18": lambda h: clock.calendar_by_competitor(h, YEAR),
    "R18_by_channel": lambda h: clock.calendar_by_competitor(h, YEAR, column="channel"),
    "R19": clock.top_times,
    "R19_rows": clock.message_times,
    "R20": clock.time_distribution,
    # senders
    "R21": lambda h: sender.domain_summary(h, unicode_words=False),
    "R22": lambda h: sender.domain_matrix(h, unicode_words=False),
    "R22_wide": lambda h: widen(
        sender.domain_matrix(h, unicode_words=False), "from_domain", "competitor_name", "n"
    ),
    "R23": sender.ip_summary,
    "R24": sender.ip_matrix,
    "R24_wide": lambda h: widen(sender.ip_matrix(h), "from_ip", "competitor_name", "n"),
    "R25": sender.ips_vs_high_volume,
    "R26": lambda h: sender.provider_matrix(h, ip_dim(h)),
    "R26_wide": lambda h: widen(
        sender.provider_matrix(h, ip_dim(h)), "competitor_name", "provider", "n_ips"
    ),
    "R26_cidr": lambda h: sender.provider_matrix_by_network(h, networks(h)),
    "R26_ranges": lambda h: sender.provider_matrix_by_range(_some_v6(h), address_ranges(h)),
    "R27": lambda h: sender.provider_list(h, ip_dim(h)),
    # content
    "R28": content.subject_length,
    "R29": content.content_types,
    "R29_wide": lambda h: widen(content.content_types(h), "competitor_name", "email_type", "pct"),
    "R30": content.promo_types,
    "R30_wide": lambda h: widen(content.promo_types(h), "competitor_name", "type", "pct"),
    "R31": content.tonality,
    "R31_wide": lambda h: widen(content.tonality(h), "competitor_name", "tone_of_voice", "pct"),
    "R32": content.emoji_usage,
    "R33": lambda h: _nullable(timeline.timeline(h), "day_offset"),
    "R34": timeline.first48_volume,
    "R35": timeline.first48_email_types,
    "R36": timeline.first48_promo_types,
    # offers and bundles
    "R37": offers.top_offers_no_promo,
    "R38": offers.top_offers,
    "R39": offers.offer_mix,
    "R39_per_lifecycle": lambda h: offers.offer_mix(h, "per_lifecycle"),
    "R39_per_competitor": lambda h: offers.offer_mix(h, "per_competitor"),
    "R40": offers.offer_pairs,
    "R41": bundles.bundle_sizes,
    "R42": bundles.bundles,
    "R42_per_hit": bundles.message_bundles,
    "R43": bundles.bundle_tree,
    "R44": bundles.top_bundles,
    "R45": offers.play_value,
    "R45_modes": offers.play_value_modes,
    # holidays
    "R46": holiday.seasonal_first,
    "R47": holiday.seasonal_activity,
    "R47_wide": lambda h: widen(
        holiday.seasonal_activity(h), "competitor_name", "holiday_type", "n", holidays.SEASONS
    ),
    "R48": holiday.holiday_promos,
    "R48_competitor": lambda h: holiday.holiday_promos(h, COMPETITOR),
    "R49": lambda h: _nullable(timeline.holiday_timeline(h), "day_offset"),
    # summary
    "R50": summary.totals,
    "R51": summary.vertical_totals,
    "R52": summary.leaders,
    "R53": summary.single_classification,
    "R54": summary.summary_lines,
}


def dates_as_text(df):
    """Dates as text, the one form in which all engines hand them out alike."""
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in days})


def _query(operator):
    return lambda spark, folder: dates_as_text(operator(hits_from_star(spark, folder)))


def queries():
    return {name: _query(operator) for name, operator in OPERATORS.items()}
