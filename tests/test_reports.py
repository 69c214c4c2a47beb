"""Reports on hand-made tables: ties, nulls, empty input, edges."""

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from hitprism.operators import (
    bundles,
    clock,
    content,
    holiday,
    offers,
    prepare,
    sender,
    summary,
    timeline,
    volume,
)
from hitprism.operators.wide import widen
from hitprism.plans.catalog import OPERATORS
from hitprism.schema import HITS


def test_empty_input_gives_empty_reports_with_a_schema(spark):
    empty = spark.createDataFrame([], HITS)
    for name in ("R2", "R3", "R6", "R9", "R17", "R20", "R25", "R30", "R32", "R33", "R37", "R39",
                 "R40", "R42", "R43", "R45", "R46", "R47", "R48", "R52", "D1", "D10", "P1"):
        got = OPERATORS[name](empty)
        assert got.columns and got.count() == 0, name
    assert rows(volume.competitor_table(empty), "competitor_name", "n") == [("TOTAL", 0)]
    assert clock.hour_heatmap(empty).agg(F.sum("n"), F.count("n")).first() == (0, 168)


def test_total_counts_messages_with_both_keys(hits):
    h = hits(
        {"tracking_hit_id": 1, "competitor_name": "A", "country": "X"},
        {"tracking_hit_id": 1, "competitor_name": "A", "country": "X"},
        {"tracking_hit_id": 2, "competitor_name": "B", "country": "X"},
        {"tracking_hit_id": 3, "competitor_name": "B", "country": None},
        {"tracking_hit_id": 4, "competitor_name": None, "country": "X"},
    )
    got = [tuple(r) for r in volume.competitor_table(h).collect()]
    assert got == [("A", "X", 1, False), ("B", "X", 1, False), ("TOTAL", "ALL", 2, True)]
    assert [tuple(r) for r in volume.competitor_volume(h).collect()] == [("B", 2), ("A", 1)]


def test_velocity_keeps_null_keys_and_counts_days_by_date(hits):
    h = hits(
        {"tracking_hit_id": 1, "competitor_name": "A", "tracking_id": 7,
         "local_created_at": at("2024-01-01 23:59")},
        {"tracking_hit_id": 2, "competitor_name": "A", "tracking_id": 7,
         "local_created_at": at("2024-01-03 00:00")},
        {"tracking_hit_id": 3, "competitor_name": "A", "tracking_id": 7},
        {"tracking_hit_id": 4, "local_created_at": at("2024-01-01")},
    )
    got = rows(volume.velocity(h, 30), "competitor_name", "volume", "min_date_str",
               "max_date_str", "active_period", "lifecycle", "weekly_velocity")
    assert got == [(None, 1, "01-Jan-2024", "01-Jan-2024", 1, None, 0.23),
                   ("A", 2, "01-Jan-2024", "03-Jan-2024", 3, None, 0.47)]
    assert rows(volume.velocity_labelled(h, "FIRST"), "period") == [("First 1 days",), ("First 3 days",)]
    assert rows(volume.velocity_labelled(h, "all_time"), "period")[0] == ("Since Creation - 1 days",)
    assert rows(volume.velocity_labelled(h, None), "period")[0] == ("1 days",)
    assert rows(volume.frequency_table(h), "idx", "active_period") == [(0, 3), (1, 1)]
    shares = volume.velocity_share(h)
    assert rows(shares, "slice_name") == [(" — ",), ("7 — A",)]
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(1)


def heat(hits, *cells):
    """One message per (hour, count) on Monday 2024-01-01."""
    made, i = [], 0
    for hour, n in cells:
        for _ in range(n):
            i += 1
            made.append({"tracking_hit_id": i, "competitor_name": "A" if i % 2 else None,
                         "local_created_at": at(f"2024-01-01 {hour:02d}:30")})
    return hits(*made)


def test_opportunities_at_the_edges_and_on_flat_days(hits):
    got = rows(clock.opportunities(heat(hits, (0, 5))), "day_no", "opp1", "opp2")
    assert got[0] == (0, -1, 3)
    assert got[1:] == [(d, 16, 20) for d in range(1, 7)]
    assert rows(clock.opportunities(heat(hits, (4, 2), (9, 2))), "opp1", "opp2")[0] == (8, 12)


def test_excluding_a_competitor_keeps_the_unnamed(hits):
    h = heat(hits, (4, 3))
    got = clock.hour_heatmap_excluding(h)
    assert got.count() == 2 * 168
    busy = got.where("n > 0")
    assert rows(busy, "excluded_competitor", "day_of_week", "hour", "n") == [
        (None, "Monday", 4, 3), ("A", "Monday", 4, 1)]


def test_calendar_fills_active_months(hits):
    h = hits(
        {"tracking_hit_id": 1, "competitor_name": "A", "local_created_at": at("2024-02-29 10:00")},
        {"tracking_hit_id": 2, "competitor_name": "B", "local_created_at": at("2024-02-29 11:00")},
        {"tracking_hit_id": 3, "local_created_at": at("2024-02-29 12:00")},
        {"tracking_hit_id": 4, "competitor_name": "A", "local_created_at": at("2023-01-01")},
    )
    got = clock.calendar(h, 2024)
    assert got.count() == 29
    assert rows(got.where("n > 0"), "month", "week_row", "weekday_col", "n") == [(2, 4, 3, 3)]
    assert rows(got.where("date = '2024-02-01'"), "week_row", "weekday_col") == [(0, 3)]
    assert rows(clock.calendar_by_competitor(h, 2024), "competitor_name", "n", "day_total", "share") == [
        ("A", 1, 2, 0.5), ("B", 1, 2, 0.5)]


def test_times_of_day(hits):
    h = hits(
        {"tracking_id": 1, "competitor_name": "A", "local_created_at": at("2024-01-01 00:00:01")},
        {"tracking_id": 1, "competitor_name": "A", "local_created_at": at("2024-05-01 00:00:04")},
        {"tracking_id": 2, "competitor_name": "B", "local_created_at": at("2024-01-01 10:00")},
        {"competitor_name": "B", "local_created_at": at("2024-01-01 11:00")},
        {"competitor_name": "B"},
    )
    got = [tuple(r) for r in clock.top_times(h).collect()]
    assert got == [(2, "B", "10:00:00", "10:00:00", 3), (1, "A", "00:00:02", "00:00:02", 2)]
    boxes = rows(clock.time_distribution(h), "label", "n", "min", "median", "max")
    assert boxes == [("1. A", 2, 1 / 60, 2.5 / 60, 4 / 60), ("2. B", 2, 600.0, 630.0, 660.0)]


def test_ips_without_an_address_can_count_as_high_volume(hits):
    h = hits(*[{"tracking_hit_id": i, "competitor_name": "A"} for i in range(20)],
             {"tracking_hit_id": 99, "competitor_name": "A", "from_ip": "1.1.1.1"},
             {"tracking_hit_id": 100, "competitor_name": "B"})
    assert rows(sender.ips_vs_high_volume(h), "*") == [("A", 1, 1, 0)]
    with pytest.raises(ValueError, match="from_ip"):
        sender.ip_matrix(h.drop("from_ip"))


def test_providers(hits, spark):
    h = hits({"competitor_name": "A", "from_ip": "1"}, {"competitor_name": "A", "from_ip": "1"},
             {"competitor_name": "A", "from_ip": "2"}, {"competitor_name": "A"}, {"from_ip": "1"})
    dim = spark.createDataFrame([("1", "Org"), ("3", "Other")], "from_ip string, org string")
    assert rows(sender.provider_matrix(h, dim), "*") == [("A", "Org", 1), ("A", "Unknown", 1)]
    assert rows(sender.provider_list(h, dim), "*") == [("A", "Org; Unknown")]


def test_share_rounds_halves_to_even(hits):
    h = hits(*[{"tracking_hit_id": i, "competitor_name": "A", "email_type": "x" if i else "y",
                "tone_of_voice": "t"} for i in range(16)])
    assert rows(content.content_types(h), "email_type", "n", "pct") == [("x", 15, 93.8), ("y", 1, 6.2)]
    assert rows(content.tonality(h), "*") == [("A", "t", 16, 100.0, 1)]


@pytest.mark.parametrize("length, band", [
    (23, "red"), (24, "yellow"), (30, "green"), (36, "green"), (37, "yellow"), (42, "yellow"), (43, "red"),
])
def test_subject_bands(hits, length, band):
    h = hits({"tracking_hit_id": 1, "competitor_name": "A", "subject": " " + "x" * length + "\t"})
    assert rows(content.subject_length(h), "*") == [("A", float(length), band)]


def test_emoji_ties_go_by_code_point(hits):
    h = hits(
        {"tracking_hit_id": 1, "competitor_name": "A", "subject": "🔥🎄 🦃", "content": "🔥 ❤️⛄ x 🎅"},
        {"tracking_hit_id": 1, "competitor_name": "A", "subject": "🔥🎄 🦃", "content": "🔥 ❤️⛄ x 🎅"},
        {"tracking_hit_id": 2, "competitor_name": "A", "subject": "none"},
        {"tracking_hit_id": 3, "competitor_name": "A", "subject": "none"},
        {"tracking_hit_id": 4, "competitor_name": "B"},
    )
    assert rows(content.emoji_usage(h), "*") == [
        ("A", 4 - 1, 33.33, 100.0, "🔥 (2), ⛄ (1), ❤ (1), 🎄 (1), 🎅 (1)"), ("B", 1, 0.0, 0.0, "")]


def test_timeline_without_a_competitor_has_no_day(hits):
    h = hits(
        {"competitor_name": "A", "created_at": at("2024-01-01 23:00"), "type": "T"},
        {"competitor_name": "A", "created_at": at("2024-01-02 01:00"), "email_type": "System",
         "holiday": "advent"},
        {"created_at": at("2024-01-02 01:00")},
    )
    assert rows(timeline.timeline(h), "competitor_name", "day_offset", "day_label", "type") == [
        (None, None, None, "No Promo"), ("A", 0, "Day 0", "T"), ("A", 1, "Day 1", "System Message")]
    assert rows(timeline.holiday_timeline(h), "day_offset", "color_label", "marker") == [
        (None, "No Promo", ""), (0, "T", ""), (1, "Christmas", "🎄")]


def test_top_offers_break_ties_by_coverage_then_name(hits):
    h = hits(
        *[{"competitor_name": c, "type": "T", "value": v}
          for c, v in [("A", "1"), ("A", "1"), ("A", "2"), ("B", "2"), ("A", "0"), ("A", "0")]],
        {"competitor_name": "A"}, {"competitor_name": "A", "type": "No Promo", "value": "x"},
        {"type": "T", "value": "1"},
    )
    got = rows(offers.top_offers_no_promo(h, 2), "offer_rank", "offer_label", "competitor_name", "n")
    assert got == [(1, "T - 2", "A", 1), (1, "T - 2", "B", 1), (2, "T - 0", "A", 2)]
    got = rows(offers.top_offers(h, 4), "offer_rank", "type", "offer_label", "total", "n")
    assert got[:2] == [(1, "No Promo", "No Promo - No Value", 1, 1), (2, "T", "T - 0", 2, 2)]


def test_offer_mix_scopes(hits):
    h = hits({"competitor_name": "A", "lifecycle": "L", "type": "T", "value": "1"},
             {"competitor_name": None, "type": "T", "value": "1"})
    got = rows(offers.offer_mix(h), "level", "competitor_name", "offer_label", "n")
    assert got == [("all", None, None, 2), ("competitor_name", None, None, 1),
                   ("competitor_name", "A", None, 1), ("offer_label", None, "T - 1", 1),
                   ("offer_label", "A", "T - 1", 1)]
    assert offers.offer_mix(h, "per_lifecycle").count() == 3
    assert rows(offers.offer_mix(h, "per_competitor"), "competitor_name", "offer_label", "n") == [
        ("A", None, 1), ("A", "T - 1", 1)]
    with pytest.raises(ValueError, match="scope"):
        offers.offer_mix(h, "per_country")


def test_pairs_equal_brute_force(star_hits):
    held = {}
    for r in star_hits.select("tracking_hit_id", "type", "value").collect():
        label = f"{r.type or 'No Promo'} - {r.value or 'No Value'}"
        held.setdefault(r.tracking_hit_id, []).append(label)
    counts = {}
    for labels in held.values():
        for label in labels:
            counts[label] = counts.get(label, 0) + 1
    top = sorted(counts, key=lambda k: (-counts[k], k))[:20]
    expected = {}
    for labels in held.values():
        for a in set(labels) & set(top):
            for b in set(labels) & set(top):
                expected[a, b] = expected.get((a, b), 0) + 1
    got = {(r.offer_a, r.offer_b): r.n for r in offers.offer_pairs(star_hits).collect()}
    assert got == expected


def test_huge_message_is_not_collected_but_labelled_whole(hits):
    big = [{"tracking_hit_id": 1, "type": "", "value": f"{i:03d}" if i else ""} for i in range(500)]
    h = hits(*big, *big, {"tracking_hit_id": 2, "type": "A", "value": "1"}, {"type": "B"})
    whole = " | ".join(sorted(f" - {i:03d}" if i else " - " for i in range(500)))
    assert rows(bundles.message_bundles(h), "*") == [(1, whole[:180] + "…", 500)]
    assert rows(bundles.message_bundles(h, 1), "*")[1] == (2, "A - 1", 1)
    assert rows(bundles.bundle_sizes(h), "*") == [(1, 1), (1000, 1)]
    assert rows(bundles.bundle_sizes(h, 2), "*") == [(1000, 1)]


def test_bundle_sizes_add_up(star_hits):
    total = bundles.bundle_sizes(star_hits).agg(F.sum(F.expr("bundle_size * n_hits"))).first()[0]
    assert total == star_hits.count()


def test_play_value_returns_all_tied_modes(hits):
    base = {"competitor_name": "A", "promotion_type": "Free Spins"}
    h = hits(*[{**base, "value": v, "play_value": p} for v, p in [
        ("1", "b"), ("1", "a"), ("1", "b"), ("1", "a"), ("1", "c"), ("2", ""), ("2", ""), ("2", "z"),
        ("3", None)]], {**base, "promotion_type": "Cashback", "value": "9", "play_value": "p"})
    assert rows(offers.play_value(h), "value", "modes") == [("1", "a, b")]


def test_seasons(hits):
    base = {"competitor_name": "A", "holiday": "Black Friday"}
    h = hits(
        {**base, "tracking_hit_id": 2, "local_created_at": at("2024-11-02"), "subject": "late"},
        {**base, "tracking_hit_id": 1, "local_created_at": at("2024-11-01"), "subject": None,
         "type": "T", "value": "9", "play_value": ""},
        {**base, "tracking_hit_id": 1, "local_created_at": at("2024-11-03"), "subject": "s",
         "value": "1", "play_value": "p", "deposit_requirement": "r"},
        {**base, "tracking_hit_id": 3},
        {"tracking_hit_id": 4, "subject": "xmas", "local_created_at": at("2024-12-01")},
    )
    first = rows(holiday.seasonal_first(h), "competitor_name", "holiday_type", "first_date",
                 "first_subject", "first_offer")
    assert first == [("A", "Black Friday", at("2024-11-01"), None, "T: 9")]
    assert rows(holiday.seasonal_activity(h), "*") == [("A", "Black Friday", 3), ("A", "Christmas", 0)]
    promos = rows(holiday.holiday_promos(h, "A"), "tracking_hit_id", "date", "subject", "offer",
                  "wager", "requirements")
    assert promos[0] == (1, "01-November-2024", "s", "1, 9", ", p", "r")
    assert promos[2] == (3, None, None, "No Value", "", "")
    assert holiday.holiday_promos(h, "B").count() == 0


def test_summary_lines(hits):
    h = hits(
        {"competitor_name": "B", "vertical": "V", "promotion_types": "p", "category": "c",
         "classification": "k", "local_created_at": at("2024-01-01")},
        {"competitor_name": "A", "vertical": "V", "promotion_types": "p", "category": "d",
         "classification": "k", "local_created_at": at("2024-01-02")},
        {"classification": "k", "vertical": "U"},
    )
    text = [r.text for r in summary.summary_lines(h).where("section = 'summary'").orderBy("line_no").collect()]
    assert text == [
        "Total messages tracked: **3**", "Total number of competitors: **2**",
        "Competitors: **A, B**",
        "Total number of U competitors: **0**", "U Competitors: ****", "Total messages in U: **1**",
        "Total number of V competitors: **2**", "V Competitors: **A, B**", "Total messages in V: **2**",
        "Most common promotion type: **p** (2 times)", "Peak activity day: **2024-01-01** with 1 messages",
        "Most common content category: **c**", "All messages are classified as: **k**"]
    assert summary.summary_lines(h).where("section = 'recommendation'").count() == 4
    mixed = h.withColumn("classification", F.col("category"))
    assert rows(summary.single_classification(mixed), "*") == [(False, None)]


def test_wide_forms_fill_absent_cells(spark):
    tall = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, c string, n int")
    assert rows(widen(tall, "k", "c", "n"), "k", "x", "y") == [("a", 1, 0), ("b", 0, 2)]
    assert widen(tall, "k", "c", "n", ["x", "y", "z"]).columns == ["k", "x", "y", "z"]


def test_shares_of_a_competitor_sum_to_a_hundred(star_hits):
    for report in (content.content_types, content.tonality, content.promo_types):
        sums = report(star_hits).groupBy("competitor_name").agg(F.sum("pct").alias("s"))
        assert sums.where(F.abs(F.col("s") - 100) > 0.5).count() == 0


def test_heatmap_counts_every_message(star_hits):
    total = clock.hour_heatmap(star_hits).agg(F.sum("n")).first()[0]
    assert total == star_hits.select("tracking_hit_id").distinct().count()


def test_wide_form_over_the_limit_points_to_the_tall_one(spark):
    tall = spark.range(4).selectExpr("'a' AS k", "concat('c', id) AS c", "1 AS n")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="tall"):
            widen(tall, "k", "c", "n")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_longest_network_wins(spark, hits):
    sent = hits(*[{"tracking_hit_id": i, "competitor_name": "A", "from_ip": ip}
                  for i, ip in enumerate(["10.1.2.3", "10.1.9.9", "11.0.0.1", "fe80::1", "10.1.2.3", None])])
    blocks = spark.createDataFrame([("10.0.0.0", 8, "wide"), ("10.1.2.0", 24, "narrow"), ("10.1.2.0", 24, "other")],
                                   "network string, prefix int, org string")
    got = sender.provider_matrix_by_network(sent, blocks)
    assert rows(got, "provider", "n_ips") == [("Unknown", 2), ("narrow", 1), ("wide", 1)]


def test_seasons_can_be_shared(hits):
    given = hits(
        {"tracking_hit_id": 1, "holiday": "Advent", "subject": "black friday"},
        {"tracking_hit_id": 2, "holiday": "Anniversary", "translated_content": "merry xmas"},
        {"tracking_hit_id": 3, "subject": "cyber monday"}, {"tracking_hit_id": 4, "subject": "snow ❄"},
        {"tracking_hit_id": 5})
    shared = prepare.with_seasons(given)
    columns = ["tracking_hit_id", "holiday_type", "holiday_label"]
    assert rows(shared, *columns) == [
        (1, "Christmas", "Christmas"), (2, "Christmas", "Anniversary"), (3, "Black Friday", "Black Friday"),
        (4, "Christmas", ""), (5, None, "")]
    assert rows(prepare.with_holiday_label(shared), "tracking_hit_id", "holiday") == rows(
        prepare.with_holiday_label(given), "tracking_hit_id", "holiday")
