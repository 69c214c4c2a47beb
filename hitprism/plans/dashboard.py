"""All reports of one selection, over shared parents."""

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

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
from hitprism.plans.shared import shared_table
from hitprism.sources.hits import write_report

# Name of the list of a set of reports.
MANIFEST = "reports.json"

# What the message-level reports read; message texts only as derived features.
MESSAGE_COLUMNS = [
    "competitor_name",
    "tracking_id",
    "country",
    "vertical",
    "lifecycle",
    "channel",
    "email_type",
    "tone_of_voice",
    "type",
    "from",
    "to",
    "from_ip",
    "created_at",
    "local_created_at",
    "tracking_start_at",
    "subject_chars",
    "subject_emoji",
    "content_emoji",
]


@dataclass(frozen=True)
class Selection:
    """What part of the table the reports look at. With both or neither of the
    account periods given, neither applies."""

    chosen: dict = field(default_factory=dict)
    first_day: dt.date | None = None
    last_day: dt.date | None = None
    first_days: int | None = None
    last_days: int | None = None

    @property
    def has_period(self):
        return (self.first_days is None) != (self.last_days is None)


def select_hits(hits, selection):
    """Filter, then date range, then account period."""
    rows = filters.filter_in(hits, selection.chosen)
    if selection.first_day and selection.last_day:
        rows = filters.filter_dates(rows, selection.first_day, selection.last_day)
    if selection.has_period and selection.first_days is not None:
        return filters.first_n_days(rows, selection.first_days).drop("days_since")
    if selection.has_period:
        return filters.last_n_days(rows, selection.last_days).drop("days_since")
    return rows


def reports(hits, selection=None, year=2025, ip_dim=None, more=False, share=True):
    """The reports by name, as frames.

    With ``share`` the selected rows are written once to the shared folder, what
    is looked for in long texts as columns instead of the texts, and so are the
    deduplicated messages, and the rows counted once for all reports that only count
    rows; all reports read these tables. ``more`` adds the reports that are not part
    of the standard set.
    """
    selection = selection or Selection()
    rows = select_hits(hits, selection)
    if share:
        rows = content.with_text_features(rows)
        if more:
            rows = prepare.with_seasons(rows)
        rows = shared_table(rows.drop("content", "translated_content"), "rows")
    msgs = first_rows(content.with_text_features(rows), *MESSAGE_COLUMNS)
    if share:
        msgs = shared_table(msgs, "messages")

    # the reports that only count rows share one scan
    counted = shared_table(counts.row_counts(rows), "counts") if share else None

    def counts_of(name):
        return counts.part(counted, name) if share else rows

    named = {
        "competitor_table": volume.competitor_table(msgs, deduped=True),
        "competitor_volume": volume.competitor_volume(msgs, deduped=True),
        "velocity": volume.velocity_labelled(msgs, deduped=True),
        "velocity_share": volume.velocity_share(msgs, deduped=True),
        "frequency_table": volume.frequency_table(msgs, deduped=True),
        "cross_tab": volume.cross_tab(msgs, deduped=True),
        "top_times": clock.top_times(rows),
        "time_distribution": clock.time_distribution(rows),
        "hour_heatmap": clock.hour_heatmap(msgs, deduped=True),
        "opportunities": clock.opportunities(msgs, deduped=True),
        "calendar": clock.calendar(msgs, year, deduped=True),
        "calendar_by_competitor": clock.calendar_by_competitor(msgs, year, deduped=True),
        "domain_matrix": sender.domain_matrix(msgs, deduped=True),
        "ip_matrix": sender.ip_matrix(msgs, deduped=True),
        "ips_vs_high_volume": sender.ips_vs_high_volume(msgs, deduped=True),
        "subject_length": content.subject_length(msgs, deduped=True),
        "emoji_usage": content.emoji_usage(msgs, deduped=True),
        "content_types": content.content_types(msgs, deduped=True),
        "promo_types": content.promo_types(rows),
        "tonality": content.tonality(msgs, deduped=True),
        "timeline": timeline.timeline(rows),
        "top_offers_no_promo": offers.top_offers_no_promo(counts_of("offer")),
        "top_offers": offers.top_offers(counts_of("offer")),
        "offer_mix": offers.offer_mix(counts_of("offer")),
        "bundle_sizes": bundles.bundle_sizes(rows),
        "offer_pairs": offers.offer_pairs(rows),
        "channel_mix": volume.channel_mix(counts_of("channel")),
        "hits_over_time": volume.hits_over_time(counts_of("created_day")),
        "summary": summary.summary_lines(rows, counts_of if share else None),
    }
    if ip_dim is not None:
        named["provider_matrix"] = sender.provider_matrix(rows, ip_dim)
    if more:
        named |= {
            "hour_heatmap_excluding": clock.hour_heatmap_excluding(msgs, deduped=True),
            "first48_volume": timeline.first48_volume(msgs, deduped=True),
            "first48_email_types": timeline.first48_email_types(msgs, deduped=True),
            "first48_promo_types": timeline.first48_promo_types(msgs, deduped=True),
            "domain_summary": sender.domain_summary(msgs, deduped=True),
            "ip_summary": sender.ip_summary(msgs, deduped=True),
            "play_value": offers.play_value(rows),
            "bundle_tree": bundles.bundle_tree(rows),
            "top_bundles": bundles.top_bundles(rows),
            "seasonal_first": holiday.seasonal_first(rows),
            "seasonal_activity": holiday.seasonal_activity(rows),
            "holiday_promos": holiday.holiday_promos(rows),
            "holiday_timeline": timeline.holiday_timeline(rows),
            "promo_type_counts": volume.promo_type_counts(counts_of("promotion")),
            "promo_by_category": volume.promo_by_category(counts_of("promotion")),
            "classification_counts": volume.classification_counts(counts_of("classification")),
            "channel_type_counts": volume.channel_type_counts(counts_of("channel_type")),
        }
        if ip_dim is not None:
            named["provider_list"] = sender.provider_list(rows, ip_dim)
    return named


def write_reports(named, folder, fmt="parquet"):
    """One folder per report, and a table of their names, rows and columns written
    after the last one: a set of reports without it is not whole."""
    for name, report in named.items():
        write_report(report, f"{folder}/{name}", fmt)
    spark = next(iter(named.values())).sparkSession if named else SparkSession.active()
    listed = [(name, report.columns) for name, report in named.items()]
    spark.createDataFrame(listed, "report string, columns array<string>").coalesce(1).write.json(f"{folder}/{MANIFEST}")


def read_reports(spark, folder, fmt="parquet"):
    """The reports of a whole set, by name; fails if their list is not there yet."""
    listed = spark.read.schema("report string, columns array<string>").json(f"{folder}/{MANIFEST}").collect()
    return {r["report"]: spark.read.format(fmt).load(f"{folder}/{r['report']}") for r in listed}
