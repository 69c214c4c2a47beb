"""First rows that agree, account periods without wide exchanges, texts searched once."""

import itertools

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from hitprism.functions import holidays, text
from hitprism.operators import content, filters, messages, prepare, volume
from hitprism.operators.messages import first_rows
from hitprism.plans import catalog, texts
from hitprism.schema import HIT_ID

TEXTS = ["subject", "content", "translated_content"]


def test_rows_that_differ_in_texts_only_give_one_row(hits):
    values = list(itertools.product("abc", repeat=3))
    table = hits(*[{"tracking_hit_id": h, "competitor_name": "A", **dict(zip(TEXTS, v))} for h in (1, 2) for v in values])
    whole = {r.tracking_hit_id: r for r in first_rows(table).collect()}
    for n in (1, 2):
        for asked in itertools.permutations([*TEXTS, "competitor_name"], n):
            for r in first_rows(table, *asked).collect():
                assert tuple(r)[1:] == tuple(whole[r.tracking_hit_id][c] for c in asked)
    by_length = content.subject_length(table).first()
    assert by_length.avg_subject_length == 1.0


def test_rows_that_differ_in_one_column_give_one_row(hits):
    table = hits(*[{"tracking_hit_id": 1, "country": c, "value": v, "subject": s} for c in "xyz" for v in ("1", None) for s in "pq"])
    whole = first_rows(table).first()
    for asked in (["country"], ["value"], ["value", "country"], ["subject"], ["subject", "value"]):
        assert tuple(first_rows(table, *asked).first())[1:] == tuple(whole[c] for c in asked)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_account_periods_move_no_texts(spark, hits):
    table = hits(*[{"tracking_hit_id": i, "tracking_id": i % 3 or None, "content": "long", "created_at": at(f"2025-01-{i + 1:02}"),
                    "local_created_at": at(f"2025-01-{i + 1:02}")} for i in range(20)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for period in (filters.first_n_days, filters.last_n_days):
            narrowed = period(table, 5)
            exchanges = [line for line in _plan(narrowed).splitlines() if "Exchange" in line and "Broadcast" not in line]
            assert not exchanges
            assert narrowed.columns == [*table.columns, "days_since"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_accounts_are_joined_by_shuffle(hits, monkeypatch):
    table = hits(*[{"tracking_hit_id": i, "tracking_id": i % 4 or None, "local_created_at": at(f"2025-01-{i + 1:02}")} for i in range(20)])
    few = rows(filters.first_n_days(table, 6), "tracking_hit_id", "days_since")
    monkeypatch.setattr(filters, "MOST_ACCOUNTS", 1)
    assert rows(filters.first_n_days(table, 6), "tracking_hit_id", "days_since") == few


@pytest.mark.parametrize("most", [texts.MOST_TEXTS, 2])
def test_text_values_equal_the_rule_on_each_row(hits, monkeypatch, most):
    monkeypatch.setattr(texts, "MOST_TEXTS", most)
    bodies = [None, "", "plain", "Merry XMAS", "Merry XMAS", "\U0001F525 hot", "cyber Monday", "❄", "Friday", "day of rest"]
    table = hits(*[{"tracking_hit_id": i % 7 or None, "subject": s, "translated_content": b, "content": b, "holiday": h}
                   for i, (b, s, h) in enumerate(itertools.product(bodies, [None, "Black", "x"], [None, "Advent", "Easter"]))])
    found = texts.with_text_value(table, "content", "upper_text", F.upper, F.col("holiday").isNull())
    assert rows(found, "content", "holiday", "upper_text") == rows(
        table.withColumn("upper_text", F.when(F.col("holiday").isNull(), F.upper("content"))), "content", "holiday", "upper_text")

    whole = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("translated_content", F.lit("")))
    marked = table.withColumn("marks", holidays.season_marks(F.lower(whole)))
    for name, make, rule in (("holiday_type", prepare.with_holiday_type, holidays.holiday_type), ("holiday", prepare.with_holiday_label, holidays.holiday_label)):
        want = marked.withColumn("want", rule(F.col("holiday"), lambda m: F.col("marks")[m]))
        assert rows(make(table), "subject", "translated_content", name) == rows(want, "subject", "translated_content", "want")
    assert ("Black", "Friday", "Black Friday") in rows(prepare.with_holiday_type(table), "subject", "translated_content", "holiday_type")


def test_counts_are_grouped_without_texts(star_hits):
    plan = _plan(volume.competitor_volume(star_hits))
    assert "content" not in plan.split("Exchange")[-1]


def _below_aggregates(df):
    """Columns that reach each aggregate of the plan."""
    nodes, found = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Aggregate":
            found.append({below[0].output().apply(i).name() for i in range(below[0].output().size())})
        nodes += below
    return found


def test_first_rows_show_digests_without_moving_texts(hits, monkeypatch):
    stored = []
    monkeypatch.setattr(messages, "shared_table", lambda df, name: stored.append(df) or df)
    values = list(itertools.product([1, 2, 3, None], ["1", None], ["a", "b"], ["x", "y", None], ["p", None]))
    table = hits(*[{"tracking_hit_id": h, "value": v, "country": c, "content": t if h != 3 else "same", "translated_content": u if h != 3 else None,
                    "from": f} for h, v, c, t, u in values for f in ("m", "n")])
    for order in (["value"], [F.col("value").isNull().alias("no"), "value"], ["country", "value"], None):
        whole = catalog.digested(first_rows(table, order=order))
        assert rows(first_rows(table, order=order, shown=catalog.digested), "*") == rows(whole, "*")
        asked = ["country", "translated_content", "value", "from"]
        assert rows(first_rows(table, *asked, order=order, shown=catalog.digested), "*") == rows(
            catalog.digested(first_rows(table, *asked, order=order)), "*")
    stored.clear()
    catalog.OPERATORS["D1"](table)
    assert stored and all(not {"content", "translated_content"} & names for df in stored for names in _below_aggregates(df))


def test_empty_table_has_no_first_rows(hits):
    assert rows(first_rows(hits(), order=["value"], shown=catalog.digested), "*") == []


def test_emoji_usage_sorts_no_texts(hits):
    table = hits(*[{"tracking_hit_id": i // 2, "competitor_name": "A", "subject": f"s{i}", "content": f"text {i} \U0001F525"} for i in range(6)])
    below = _below_aggregates(content.emoji_usage(table))
    assert below and all(not {"subject", "content", "translated_content"} & names for names in below)


def test_emoji_are_looked_for_once_in_each_text(hits):
    bodies = [None, "", "plain", "hot \U0001F525", "hot \U0001F525", "ö", "\U0001F384\U0001F525"]
    table = hits(*[{"tracking_hit_id": i, "subject": s, "content": b} for i, (b, s) in enumerate(itertools.product(bodies, [None, "x", "\U0001F384 x"]))])
    want = table.select(HIT_ID, *[f(F.col(c)).alias(f"{c}_{n}") for c in ("subject", "content")
                                  for n, f in (("emoji", text.emoji_only), ("has_emoji", text.has_emoji))])
    found = catalog.OPERATORS["D8"](table)
    assert found.schema == want.schema and rows(found, "*") == rows(want, "*")
    assert "regexp_replace(content" not in _plan(found)


@pytest.mark.parametrize("most", ["MOST_TEXTS", "MOST_BYTES", None])
def test_values_of_texts_come_to_the_rows(spark, hits, monkeypatch, most):
    table = hits(*[{"tracking_hit_id": i // 2 or None, "competitor_name": "A", "subject": "s", "content": b, "translated_content": b}
                   for i, b in enumerate([None, "", "hot \U0001F525", "hot \U0001F525", "plain", "\U0001F384\U0001F525"] * 2)])
    want = rows(table.withColumn("found", text.emoji_only(F.col("content"))), "content", "found")
    if most:
        monkeypatch.setattr(texts, most, 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = texts.with_text_value(table, "content", "found", text.emoji_only)
        assert not [line for line in _plan(found).splitlines() if "Exchange" in line and "Broadcast" not in line]
        assert rows(found, "content", "found") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [texts.MOST_TEXTS, 1])
def test_emoji_usage_finds_what_first_rows_have(hits, monkeypatch, most):
    bodies = [None, "", "plain", "hot \U0001F525", "hot \U0001F525", "\U0001F384\U0001F525", "ö"]
    table = hits(*[{"tracking_hit_id": i // 3 or None, "competitor_name": "AB"[i % 2], "subject": s, "content": b, "value": str(i % 5)}
                   for i, (b, s) in enumerate(itertools.product(bodies, [None, "x", "\U0001F384 x"]))])
    first = first_rows(content.with_text_features(table), "competitor_name", "subject_emoji", "content_emoji")
    want = rows(content.emoji_usage(first.withColumn("subject_chars", F.lit(1)), deduped=True), "*")
    monkeypatch.setattr(texts, "MOST_TEXTS", most)
    steps = []
    for module in (texts, content):
        monkeypatch.setattr(module, "shared_table", lambda df, name: steps.append(df) or df)
    found = content.emoji_usage(table)
    assert rows(found, "*") == want
    assert steps and all(not {"content", "subject", "translated_content"} & names for df in [*steps, found] for names in _below_aggregates(df))
