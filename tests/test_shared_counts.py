"""Counted rows and the cascade of filters against the plain way."""

import pytest
from conftest import rows

from hitprism.operators import counts, filters, offers, summary, volume
from hitprism.plans.dashboard import read_reports, write_reports
from hitprism.plans.shared import shared_table
from hitprism.schema import FILTER_COLUMNS

REPORTS = {
    "created_day": [volume.hits_over_time],
    "promotion": [volume.promo_type_counts, volume.promo_by_category],
    "classification": [volume.classification_counts, summary.single_classification],
    "channel_type": [volume.channel_type_counts],
    "channel": [volume.channel_mix, summary.totals, summary.vertical_totals],
    "offer": [offers.top_offers_no_promo, offers.top_offers, offers.offer_mix, lambda h: offers.offer_mix(h, "per_lifecycle"),
              lambda h: offers.offer_mix(h, "per_competitor")],
}


@pytest.fixture(scope="module")
def counted(star_hits):
    return shared_table(counts.row_counts(star_hits), "counts")


@pytest.mark.parametrize("name", list(REPORTS))
def test_reports_of_counted_rows_equal_those_of_rows(star_hits, counted, name):
    for report in REPORTS[name]:
        own, shared = report(star_hits), report(counts.part(counted, name))
        assert own.schema.simpleString() == shared.schema.simpleString()
        assert rows(shared, *own.columns) == rows(own, *own.columns)


def test_summary_of_counted_rows(star_hits, counted):
    own = [tuple(r) for r in summary.summary_lines(star_hits).collect()]
    assert [tuple(r) for r in summary.summary_lines(None, lambda name: counts.part(counted, name)).collect()] == own


def test_one_scan_counts_all(star_hits):
    plan = counts.row_counts(star_hits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_no_rows(hits):
    assert counts.row_counts(hits()).count() == 0


@pytest.mark.parametrize("chosen", [
    {}, {"vertical": ["Casino"], "channel": ["email", "sms"]}, {"competitor_name": ["none such"]},
    {"tracking_id": [1, 2, 3], "country": []}, {"vertical": ["Poker"], "lifecycle": ["BUILDING"], "category": ["1-URGENT"], "country": ["ASIA"]}])
def test_cascade_equals_filtering_step_by_step(star_hits, chosen):
    left, want = star_hits, []
    for i, c in enumerate(FILTER_COLUMNS):
        want += [(i, c, str(r[0])) for r in left.select(c).dropna().distinct().collect()]
        left = filters.filter_in(left, {c: chosen.get(c)})
    assert rows(filters.filter_cascade(star_hits, chosen), "position", "column", "value") == sorted(want)


def test_cascade_edges(hits):
    table = hits({"vertical": None, "competitor_name": "A"}, {"vertical": "x", "competitor_name": None, "tracking_id": 5})
    got = filters.filter_cascade(table.drop("country"), {"vertical": ["x"]})
    assert rows(got, "position", "column", "value") == [(0, "vertical", "x"), (6, "tracking_id", "5")]
    assert filters.filter_cascade(hits(), {}).count() == 0
    with pytest.raises(ValueError):
        filters.filter_cascade(table, {"subject": ["x"]})


def test_a_set_of_reports_is_whole_once_it_is_listed(spark, hits, tmp_path):
    named = {"days": volume.hits_over_time(hits()), "mix": volume.channel_mix(hits({"competitor_name": "A", "channel": "sms"}))}
    write_reports(named, str(tmp_path / "all"))
    back = read_reports(spark, str(tmp_path / "all"))
    assert {n: f.columns for n, f in back.items()} == {n: f.columns for n, f in named.items()}
    assert rows(back["mix"], "competitor_name", "n") == [("A", 1)]
    write_reports({}, str(tmp_path / "none"))
    assert read_reports(spark, str(tmp_path / "none")) == {}
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        read_reports(spark, str(tmp_path / "broken"))
