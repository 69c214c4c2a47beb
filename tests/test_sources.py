import datetime as dt

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from hitprism.operators.messages import first_rows
from hitprism.operators.volume import competitor_volume
from hitprism.plans import catalog
from hitprism.plans.dashboard import Selection, reports, select_hits, write_reports
from hitprism.schema import HITS
from hitprism.sources.hits import read_hits, read_rejects, write_report
from hitprism.sources.star import ip_dim


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats_read_back_the_same(spark, star_hits, tmp_path, fmt):
    sample = star_hits.drop("content", "translated_content").withColumns(
        {"content": F.lit("a, b"), "translated_content": F.lit("x")}
    ).select(star_hits.columns)
    if fmt == "csv":  # where empty and null texts are not told apart
        sample = sample.withColumn("play_value", F.nullif(F.col("play_value"), F.lit("")))
    path = str(tmp_path / fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    keep_space = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    sample.write.options(**options, **keep_space).format(fmt).save(path)
    again = read_hits(spark, path, fmt)
    assert again.schema == HITS
    assert again.exceptAll(sample).count() == 0 and again.count() == sample.count()


def test_bad_values_fail_the_load(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"tracking_hit_id": "seven"}\n')
    with pytest.raises(Exception, match="MALFORMED|seven"):
        read_hits(spark, str(tmp_path / "h.json"), "json").collect()
    with pytest.raises(ValueError, match="format"):
        read_hits(spark, "x", "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_bad_lines_no_longer_end_the_load(spark, hits, tmp_path, fmt):
    path = str(tmp_path / fmt)
    good = [{"tracking_hit_id": i, "competitor_name": f"c{i}", "created_at": at("2025-01-02")} for i in range(5)]
    options = {"header": "true"} if fmt == "csv" else {}
    hits(*good).coalesce(1).write.options(**options).format(fmt).save(path)
    part = next((tmp_path / fmt).glob("part-*"))
    (tmp_path / fmt / f".{part.name}.crc").unlink()
    names = HITS.names
    if fmt == "csv":
        cells = {"tracking_hit_id": "seven", "competitor_name": "bad id"}, {"tracking_hit_id": "8", "competitor_name": "bad time", "created_at": "no time"}
        lines = [",".join(c.get(n, "") for n in names) for c in cells] + ["9,short"]
    else:
        lines = ['{"tracking_hit_id": "seven", "competitor_name": "bad id"}', '{"tracking_hit_id": 8, "created_at": "no time", "competitor_name": "bad time"}', "{"]
    part.write_text(part.read_text() + "\n".join(lines) + "\n")
    with pytest.raises(Exception):
        read_hits(spark, path, fmt).collect()
    clean = read_hits(spark, path, fmt, bad="drop")
    assert clean.schema == HITS and rows(clean, "tracking_hit_id") == [(i,) for i in range(5)] and clean.count() == 5
    assert sorted(r.line for r in read_rejects(spark, path, fmt).collect()) == sorted(lines)
    assert read_rejects(spark, path, fmt).count() == 3
    lenient = rows(read_hits(spark, path, fmt, bad="null").where("created_at IS NULL"), "tracking_hit_id", "competitor_name")
    assert (None, "bad id") in lenient and (8, "bad time") in lenient and len(lenient) == 3
    ordered = read_hits(spark, path, fmt, bad="drop", keep_row_order=True)
    assert ordered.count() == 5 and ordered.columns[-1] == "row_order"
    with pytest.raises(ValueError):
        read_hits(spark, path, fmt, bad="skip")
    with pytest.raises(ValueError):
        read_rejects(spark, path, "parquet")


def test_load_order_decides_the_first_row(spark, hits, tmp_path):
    order = ["c", "a", "b"]
    hits(*[{"tracking_hit_id": 1, "value": v} for v in order]).coalesce(1).write.parquet(str(tmp_path / "h"))
    loaded = read_hits(spark, str(tmp_path / "h"), keep_row_order=True)
    assert rows(first_rows(loaded, "value"), "value") == [("c",)]
    assert rows(first_rows(loaded.where("value <> 'c'"), "value"), "value") == [("a",)]


def test_filters_reach_the_scan_with_load_order_kept(spark, star_hits, tmp_path):
    star_hits.limit(10).write.parquet(str(tmp_path / "h"))
    loaded = read_hits(spark, str(tmp_path / "h"), keep_row_order=True)
    plan = loaded.where("channel = 'email'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(channel,email)" in plan


def test_all_reports_take_the_same_row_of_a_message(hits):
    h = hits({"tracking_hit_id": 1, "competitor_name": None, "vertical": "X", "type": None},
             {"tracking_hit_id": 1, "competitor_name": "A", "vertical": "X", "type": "Cashback"})
    for columns in (["competitor_name"], ["competitor_name", "vertical"], ["type"]):
        first = first_rows(h, *columns).first()
        assert first[1] == ("Cashback" if columns == ["type"] else "A")


def test_small_report_is_one_file(spark, star_hits, tmp_path):
    for fmt in ("parquet", "csv"):
        write_report(competitor_volume(star_hits), str(tmp_path / fmt), fmt, ordered=fmt == "parquet")
        files = [p for p in (tmp_path / fmt).iterdir() if p.name.startswith("part-")]
        assert len(files) == 1
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 25


def test_selection(hits):
    h = hits(*[{"tracking_hit_id": i, "tracking_id": 1, "country": "X", "created_at": t,
                "local_created_at": t}
               for i, t in enumerate([at("2024-01-01"), at("2024-01-05"), at("2024-01-09")])])

    def ids(**kw):
        return rows(select_hits(h, Selection(**kw)), "tracking_hit_id")

    assert ids() == [(0,), (1,), (2,)]
    assert ids(first_days=5) == [(0,), (1,)]
    assert ids(last_days=5) == [(1,), (2,)]
    assert ids(first_days=5, last_days=5) == [(0,), (1,), (2,)]
    assert ids(first_day=dt.date(2024, 1, 2), last_day=dt.date(2024, 1, 9), first_days=1) == [(1,)]
    assert ids(chosen={"country": ["Y"]}) == []


def test_dashboard_equals_the_single_reports(spark, star_hits, tmp_path):
    selection = Selection({"channel": ["email"]}, first_days=2000)
    dim = ip_dim(star_hits)
    shared = reports(star_hits, selection, 1998, dim, more=True)
    lazy = reports(star_hits, selection, 1998, dim, more=True, share=False)
    assert len(shared) == len(lazy) == 48
    for name in ("competitor_table", "velocity", "calendar", "emoji_usage", "subject_length",
                 "promo_types", "holiday_promos", "offer_pairs", "summary"):
        a, b = (sorted(map(repr, r[name].collect())) for r in (shared, lazy))
        assert a == b and a, name
    few = {n: shared[n] for n in ("competitor_volume", "timeline")}
    write_reports(few, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "timeline")).count() == lazy["timeline"].count()


def test_rejects_query_compresses_its_lines(hits, checkpoint_dir, monkeypatch):
    monkeypatch.setattr(catalog, "CSV_ROWS", 10)
    table = hits(*[{"tracking_hit_id": i, "tracking_id": i, "channel": "sms", "category": "1-URGENT" if i % 4 == 0 else "5-LOW"} for i in range(40)])
    before = set(checkpoint_dir.glob("reports/hits-*"))
    found = catalog.OPERATORS["S1_rejects"](table.coalesce(1))
    assert rows(found, "kind", "channel", "n") == [("clean", "sms", 30), ("null", "sms", 10), ("rejected", None, 10)]
    (folder,) = set(checkpoint_dir.glob("reports/hits-*")) - before
    assert len(list(folder.glob("part-*"))) == len(list(folder.glob("part-*.csv.gz"))) == 4
