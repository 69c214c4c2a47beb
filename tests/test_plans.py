import pytest
from conftest import rows
from pyspark.sql import functions as F

from hitprism.operators import bundles
from hitprism.operators.clock import time_distribution
from hitprism.operators.content import promo_types, tonality
from hitprism.operators.volume import frequency_table
from hitprism.plans import shared
from hitprism.plans.groups import numbered, ranked, top_rows, with_group_values


@pytest.fixture
def skewed(spark):
    """One key holds a third of the rows; some rows have no key."""
    n = 3000
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None))
    return spark.range(n).select("id", key.otherwise(F.col("id")).cast("long").alias("k"))


@pytest.mark.parametrize("keep", [True, False])
def test_group_values_equal_a_window(skewed, keep):
    got = with_group_values(
        skewed, ["k"], [F.min("id").alias("low"), F.max("id").alias("high")],
        keep_unkeyed=keep,
    )
    lows = {}
    for r in skewed.collect():
        if r.k is not None:
            lo, hi = lows.get(r.k, (r.id, r.id))
            lows[r.k] = min(lo, r.id), max(hi, r.id)
    expected = sorted(
        (r.id, r.k, *lows.get(r.k, (None, None)))
        for r in skewed.collect() if keep or r.k is not None
    )
    assert sorted(tuple(r) for r in got.select("id", "k", "low", "high").collect()) == expected


def test_group_values_join_deals_both_sides_anew(spark, skewed):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = with_group_values(skewed, ["k"], [F.min("id").alias("low")])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Window" not in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning(k") == 2


def test_numbered_counts_across_partitions(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    frame = frame.selectExpr("v div 100 as a", "v % 100 div 40 as b", "v")
    got = numbered(frame, ["a", "b"], [F.desc("v")], "i", start=0)
    assert rows(got, "v", "i") == [(v, 999 - v) for v in range(1000)]
    assert rows(ranked(frame, [F.asc("v")], "i"), "v", "i") == [(v, v + 1) for v in range(1000)]


def test_numbered_of_nothing(spark):
    nothing = spark.range(0).selectExpr("id", "id as a", "id as b")
    assert numbered(nothing, ["a", "b"], [F.asc("id")], "i").collect() == []


def test_building_numbered_reports_starts_no_job(spark, star_hits):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for report in (frequency_table, time_distribution, promo_types, tonality):
            report(star_hits)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_top_rows(spark):
    got = top_rows(spark.range(100), 3, [F.desc("id")], "place")
    assert rows(got, "place", "id") == [(1, 99), (2, 98), (3, 97)]
    assert top_rows(spark.range(2), 5, [F.asc("id")], "place").count() == 2


def test_shared_folder_is_the_one_the_session_names(spark, checkpoint_dir):
    assert shared.shared_folder(spark) == str(checkpoint_dir)
    table = shared.shared_table(spark.range(5), "five")
    assert table.count() == 5
    assert any(p.name.startswith("five-") for p in (checkpoint_dir / "tables").iterdir())


def test_bundles_deal_offers_anew_once(hits):
    table = hits(*[{"tracking_hit_id": i % 5 or None, "type": f"t{i % 3}", "value": None} for i in range(30)]).repartition(4, "tracking_hit_id")
    made = bundles.message_bundles(table)
    assert rows(made, "tracking_hit_id", "bundle_size", "bundle_label") == [
        (i, 3, "t0 - No Value | t1 - No Value | t2 - No Value") for i in range(1, 5)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair" in plan
