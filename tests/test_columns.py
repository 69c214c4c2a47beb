import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from hitprism.functions import holidays, numbers, text, times
from hitprism.operators import prepare
from hitprism.operators.messages import first_rows
from hitprism.sources.hits import parse_times, read_hits


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize("x, digits, expected", [
    (6.25, 1, 6.2), (6.35, 1, 6.4), (0.125, 2, 0.12), (0.575, 2, 0.57), (-2.5, 0, -2.0),
])
def test_rounding_goes_to_even_like_numpy(spark, x, digits, expected):
    assert one(spark, numbers.round_half_even(F.lit(x), digits)) == expected


@pytest.mark.parametrize("start, end, days", [
    ("2024-01-01 02:00:00", "2024-01-01 00:00:00", -1),
    ("2024-01-01 00:00:00.5", "2024-01-01 00:00:00", -1),
    ("2024-01-01", "2024-01-02 23:59:59.999999", 1),
    ("2024-01-01", "2024-01-01", 0),
])
def test_whole_days_round_down(spark, start, end, days):
    a, b = (F.lit(at(t)).cast("timestamp_ntz") for t in (start, end))
    assert one(spark, times.whole_days(a, b)) == days


def test_clock_text(spark):
    assert one(spark, times.clock_text(F.lit(3661))) == "01:01:01"
    assert one(spark, times.clock_text(F.lit(86399))) == "23:59:59"
    assert one(spark, times.clock_text(F.lit(None).cast("long"))) is None


@pytest.mark.parametrize("sender, domain", [
    (" News <A.B-c@Mail.Example.COM> ", "mail.example.com"),
    ("a@b.c", "b.c"), ("two <x@one.org>, y@two.org", "one.org"),
    ("no address", None), (None, None), ("ü@münchen.de", "münchen.de"),
])
def test_sender_domain(spark, sender, domain):
    assert one(spark, text.sender_domain(F.lit(sender).cast("string"))) == domain


@pytest.mark.parametrize("given, emoji", [
    ("sale 🔥🔥 now 🎄", "🔥🔥🎄"), ("plain, ünïcode 漢字 – 1#*", ""), ("", ""), (None, None),
    ("👩‍👧 ❤️ © ™", "👩👧❤©™"), ("🇩🇪", ""), ("👍🏽", "👍🏽"),
])
def test_emoji_one_code_point_at_a_time(spark, given, emoji):
    col = F.lit(given).cast("string")
    assert one(spark, text.emoji_only(col)) == emoji
    assert one(spark, text.has_emoji(col)) == bool(emoji)
    assert one(spark, text.emoji_list(text.emoji_only(col))) == (list(emoji) if emoji is not None else None)


def test_strip_cuts_all_white_space(spark):
    assert one(spark, text.strip(F.lit("\t  a b  \n\x1f"))) == "a b"


def test_first_row_of_a_message_wins(hits):
    h = hits(
        {"tracking_hit_id": 1, "type": None, "value": "x"},
        {"tracking_hit_id": 1, "type": "B", "value": "y"},
        {"tracking_hit_id": 1, "type": "A", "value": "z"},
        {"tracking_hit_id": None, "type": "N"},
        {"tracking_hit_id": None, "type": "M"},
    )
    by_type = first_rows(h, "type", "value", order=[F.col("type").isNull().alias("none"), "type"])
    assert rows(by_type, "*") == [(None, "M", None), (1, "A", "z")]
    place = {"x": 3, "y": 1, "z": 2}
    loaded = h.withColumn("row_order", F.create_map(*[F.lit(v) for kv in place.items() for v in kv])[F.col("value")])
    assert rows(first_rows(loaded, "type", "value").where("tracking_hit_id = 1"), "*") == [(1, "B", "y")]
    assert rows(first_rows(h), "tracking_hit_id") == [(None,), (1,)]


def test_offer_columns(hits):
    h = hits(
        {"type": "Free Spins", "value": "50 FS", "local_created_at": at("2024-03-05 01:00")},
        {"type": None, "value": None},
        {"type": "X", "value": "up to 12.50 or 3"},
    )
    got = rows(prepare.prepare_offers(h), "offer_label", "numeric_value", "month")
    assert got == [("Free Spins - 50 FS", 50.0, "2024-03"), ("No Promo - No Value", None, None),
                   ("X - up to 12.50 or 3", 12.5, None)]


def test_message_kind_and_names(hits):
    h = hits(
        {"email_type": "Promotional"}, {"email_type": "System"}, {"email_type": "Newsletter"},
        {"email_type": None}, {"email_type": "Promotional", "type": "Cashback"},
    )
    got = rows(prepare.with_message_kind(h), "email_type", "type")
    assert got == [(None, "No Promo"), ("Newsletter", "No Promo"), ("Promotional", "Branding"),
                   ("Promotional", "Cashback"), ("System", "System Message")]
    names = hits({"type": "FREE CHIP now"}, {"type": "free chips"}, {"type": "tournament entry"})
    assert rows(prepare.with_normal_type(names), "type") == [
        ("Free Chips now",), ("Tournament",), ("free chips",)]


def test_offer_text_treats_null_as_empty(hits):
    h = hits({"type": "A", "value": "1"}, {"type": "A", "value": "", "play_value": "p"},
             {"type": "A"}, {"value": "v"}, {"type": ""})
    assert rows(prepare.with_offer_text(h), "offer_text") == [
        (None,), ("A",), ("A: 1",), ("A: p",), ("v",)]


CASES = [
    # holiday, subject, translated, type, label
    ("Black Week", None, None, "Black Friday", "Black Friday"),
    ("BLACK friday deals", "merry xmas", None, "Black Friday", "Black Friday"),
    ("Advent", None, None, "Christmas", "Christmas"),
    ("Holiday Season", None, None, "Christmas", "Christmas"),
    ("Anniversary", "Black Friday", None, "Black Friday", "Anniversary"),
    (None, "CYBER MONDAY", None, "Black Friday", "Black Friday"),
    (None, "blackfriday", None, None, "Black Friday"),
    (None, None, "happy Thanksgiving and xmas", "Black Friday", "Black Friday"),
    (None, "🎄", None, "Christmas", ""),
    (None, "🦃", None, "Black Friday", ""),
    (None, "🦃", "🎅", "Christmas", ""),
    (" ", "xmas", None, "Christmas", " "),
    ("", "xmas", None, "Christmas", "Christmas"),
    (None, None, None, None, ""),
]


@pytest.mark.parametrize("holiday, subject, translated, type_, label", CASES)
def test_holiday_rules(hits, holiday, subject, translated, type_, label):
    h = hits({"holiday": holiday, "subject": subject, "translated_content": translated})
    assert rows(prepare.with_holiday_type(h), "holiday_type") == [(type_,)]
    assert rows(prepare.with_holiday_label(h), "holiday") == [(label,)]


def test_every_season_word_holds_a_hint():
    words = [*holidays.BLACK_FRIDAY_WORDS, holidays.BLACK_FRIDAY_JOINED, *holidays.CHRISTMAS_WORDS]
    assert all(any(hint in word for hint in holidays.HINTS) for word in words)


def test_subjects_are_joined_in_order_and_cut(hits):
    many = [{"tracking_hit_id": i, "competitor_name": "C", "type": "T", "value": "V",
             "subject": f"s{i % 900:03d}"} for i in range(1800)]
    h = hits(*many, {"tracking_hit_id": None, "competitor_name": "C", "type": "T", "value": "V",
                     "subject": "s000"},
             {"tracking_hit_id": 1, "competitor_name": None})
    got = rows(prepare.subject_rollup(h), "competitor_name", "offer_label", "instances", "subjects")
    whole = "; ".join(f"s{i:03d}" for i in range(900))
    assert got == [(None, "No Promo - No Value", 1, ""), ("C", "T - V", 1800, whole[:2000])]


def test_subjects_in_order_of_first_sight(spark, hits, tmp_path):
    import random

    rng = random.Random(3)
    table = [{"tracking_hit_id": i, "competitor_name": rng.choice("AB"), "type": "T", "value": rng.choice("12"),
              "subject": rng.choice([None, "", *[f"subject {rng.randint(0, 600)}" for _ in range(20)]])} for i in range(2000)]
    hits(*table).coalesce(1).write.parquet(str(tmp_path / "h"))
    want = {}
    for r in table:
        group = want.setdefault((r["competitor_name"], f"T - {r['value']}"), [])
        if r["subject"] is not None and r["subject"] not in group:
            group.append(r["subject"])
    got = prepare.subject_rollup(read_hits(spark, str(tmp_path / "h"), keep_row_order=True))
    assert rows(got, "competitor_name", "offer_label", "subjects") == sorted((*k, "; ".join(v)[:2000]) for k, v in want.items())
    assert max(len("; ".join(v)) for v in want.values()) > 2000


def test_short_subjects_need_the_most_of_them(hits):
    letters = sorted({chr(c) for c in range(0x21, 0x21 + 900)})
    h = hits(*[{"tracking_hit_id": i, "competitor_name": "C", "subject": s}
               for i, s in enumerate(["", *letters])])
    assert rows(prepare.subject_rollup(h), "subjects") == [("; ".join(["", *letters])[:2000],)]


def test_times_strict_and_lenient(spark):
    frame = spark.createDataFrame([("2024-01-01 10:00:00",), ("soon",), (None,)], "created_at string")
    lenient = parse_times(frame, strict=False)
    assert rows(lenient, "created_at") == [(None,), (None,), (at("2024-01-01 10:00"),)]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="not a timestamp: soon"):
            parse_times(frame).collect()
    spark.conf.unset("spark.sql.ansi.enabled")
    assert parse_times(frame.where("created_at <> 'soon'")).count() == 1
