import datetime as dt

import pytest
from conftest import at, rows

from hitprism.operators import filters


def test_filters_add_up_and_empty_lists_keep_all(hits):
    h = hits(
        {"tracking_hit_id": 1, "country": "A", "channel": "email"},
        {"tracking_hit_id": 2, "country": "A", "channel": "sms"},
        {"tracking_hit_id": 3, "country": None, "channel": "email"},
    )
    got = filters.filter_in(h, {"country": ["A"], "channel": ["email"], "vertical": []})
    assert rows(got, "tracking_hit_id") == [(1,)]
    assert filters.filter_in(h.drop("country"), {"country": ["A"]}).count() == 3
    with pytest.raises(ValueError, match="cannot filter"):
        filters.filter_in(h, {"subject": ["x"]})


def test_long_lists_are_joined(hits):
    h = hits(*[{"tracking_hit_id": i, "tracking_id": i} for i in range(5)], {"tracking_hit_id": 9})
    got = filters.filter_in(h, {"tracking_id": list(range(2, 5000))})
    assert rows(got, "tracking_hit_id") == [(2,), (3,), (4,)]


def test_dates_include_both_days_and_reach_the_scan(hits, tmp_path, spark):
    h = hits(
        {"tracking_hit_id": 1, "local_created_at": at("2024-01-31 23:59:59")},
        {"tracking_hit_id": 2, "local_created_at": at("2024-02-01 00:00:00")},
        {"tracking_hit_id": 3, "local_created_at": at("2024-02-03 23:59:59.999999")},
        {"tracking_hit_id": 4, "local_created_at": at("2024-02-04 00:00:00")},
        {"tracking_hit_id": 5},
    )
    h.write.parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    got = filters.filter_dates(stored, dt.date(2024, 2, 1), dt.date(2024, 2, 3))
    assert rows(got, "tracking_hit_id") == [(2,), (3,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(local_created_at), GreaterThanOrEqual(local_created_at" in plan
    assert filters.filter_year(stored, 2024).count() == 4


def test_first_days_use_local_time_and_last_days_created(hits):
    h = hits(
        {"tracking_hit_id": 1, "tracking_id": 1, "local_created_at": at("2024-01-01 12:00"),
         "created_at": at("2024-01-01 12:00")},
        {"tracking_hit_id": 2, "tracking_id": 1, "local_created_at": at("2024-01-03 11:59"),
         "created_at": at("2024-01-03 12:00")},
        {"tracking_hit_id": 3, "tracking_id": 1, "local_created_at": at("2024-01-03 12:00"),
         "created_at": at("2024-01-03 12:01")},
        {"tracking_hit_id": 4, "local_created_at": at("2024-01-01"), "created_at": at("2024-01-01")},
        {"tracking_hit_id": 5, "tracking_id": 1, "created_at": at("2024-01-03")},
    )
    assert rows(filters.first_n_days(h, 2), "tracking_hit_id", "days_since") == [(1, 0), (2, 1)]
    assert rows(filters.last_n_days(h, 1), "tracking_hit_id", "days_since") == [
        (2, 0), (3, 0), (5, 0)
    ]
    assert rows(filters.last_n_days(h, 3), "tracking_hit_id") == [(1,), (2,), (3,), (5,)]
    everything = filters.first_n_days(h, 10**6)
    assert rows(everything, "tracking_hit_id") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError, match="at least 1"):
        filters.first_n_days(h, 0)


def test_first_hours_keep_rows_before_sign_up(hits):
    start = at("2024-01-02")
    h = hits(
        {"tracking_hit_id": 1, "tracking_start_at": start, "local_created_at": at("2024-01-01 22:00")},
        {"tracking_hit_id": 2, "tracking_start_at": start, "local_created_at": at("2024-01-04 00:00")},
        {"tracking_hit_id": 3, "tracking_start_at": start,
         "local_created_at": at("2024-01-04 00:00:00.000001")},
    )
    assert rows(filters.first_hours(h), "tracking_hit_id", "hours_since") == [(1, -2.0), (2, 48.0)]


def test_options_and_bounds(hits):
    h = hits(
        {"tracking_id": 9, "country": "B", "local_created_at": at("2024-01-02")},
        {"tracking_id": 3, "country": None, "local_created_at": at("2024-01-01")},
        {"tracking_id": 9, "country": "B"},
    )
    assert [r.value for r in filters.filter_options(h, "tracking_id").collect()] == [3, 9]
    assert rows(filters.filter_options(h, "country"), "value") == [("B",)]
    assert rows(filters.date_bounds(h), "*") == [(at("2024-01-01"), at("2024-01-02"))]


def test_list_length_does_not_change_the_result(hits):
    h = hits(*[{"tracking_hit_id": i, "tracking_id": i} for i in range(5)])
    for n in (3, 1500):
        chosen = [None, *[str(i) for i in range(1, n)]]
        got = filters.filter_in(h, {"tracking_id": chosen})
        assert rows(got, "tracking_id") == [(i,) for i in range(1, min(n, 5))]
        with pytest.raises(ValueError):
            filters.filter_in(h, {"tracking_id": [*chosen, "x"]})
