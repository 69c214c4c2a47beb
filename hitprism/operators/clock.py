"""When messages are sent: weekday by hour, calendars, times of day."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.functions import times
from hitprism.operators.filters import filter_year
from hitprism.operators.messages import messages
from hitprism.plans.groups import ranked, with_group_values
from hitprism.schema import HIT_ID

DAYS = range(7)
HOURS = range(24)
# A window of this many hours counts as one busy stretch; the last start looked
# at leaves room for the quiet hours after it.
BUSY_HOURS = 3
LAST_START = 17


def _zero_cells(rows, *columns):
    """A zero count for all 168 cells, once per row."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(len(DAYS) * len(HOURS) - 1)))
    return rows.select(*columns, cell.alias("cell")).select(
        *columns,
        F.floor(F.col("cell") / len(HOURS)).cast("long").alias("day_no"),
        (F.col("cell") % len(HOURS)).cast("long").alias("hour"),
        F.lit(0).cast("long").alias("n"),
    )


def _cells(hits, deduped, *extra):
    sent = F.col("local_created_at")
    return (
        messages(hits, *extra, "local_created_at", deduped=deduped)
        .where(sent.isNotNull())
        .select(
            *extra,
            times.weekday_number(sent).alias("day_no"),
            times.hour_of_day(sent).alias("hour"),
        )
        .groupBy(*extra, "day_no", "hour")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _filled(cells):
    """Counts of all 168 cells, zero where nothing was sent."""
    empty = _zero_cells(cells.sparkSession.range(1))
    return cells.unionByName(empty).groupBy("day_no", "hour").agg(F.sum("n").alias("n"))


def hour_heatmap(hits, deduped=False):
    """Messages per weekday and hour, all 168 cells."""
    return _filled(_cells(hits, deduped)).select(
        times.weekday_name(F.col("day_no")).alias("day_of_week"), "hour", "n"
    )


def opportunities(hits, deduped=False):
    """Per weekday the hours just before and after the busiest three hours.

    Of equally busy stretches the last one counts. The hour before a stretch
    that starts at midnight is -1.
    """
    stretch = Window.partitionBy("day_no").orderBy("hour").rowsBetween(0, BUSY_HOURS - 1)
    busiest = F.max(F.struct("total", "hour"))["hour"]
    return (
        _filled(_cells(hits, deduped))
        .withColumn("total", F.sum("n").over(stretch))
        .where(F.col("hour") <= LAST_START)
        .groupBy("day_no")
        .agg(busiest.alias("start"))
        .select(
            "day_no",
            times.weekday_name(F.col("day_no")).alias("day_of_week"),
            (F.col("start") - 1).alias("opp1"),
            (F.col("start") + BUSY_HOURS).alias("opp2"),
        )
        .orderBy("day_no")
    )


def hour_heatmap_excluding(hits, deduped=False):
    """The heatmap for all (null), and without each competitor in turn.

    One pass: a competitor's exclusion is the whole minus its own counts. The
    whole has 168 rows by construction, so it is safe to broadcast.
    """
    own = _cells(hits, deduped, "competitor_name")
    whole = _filled(own.select("day_no", "hour", "n"))
    named = own.where(F.col("competitor_name").isNotNull())
    empty = _zero_cells(named.select("competitor_name").distinct(), "competitor_name")
    dense = (
        named.unionByName(empty)
        .groupBy("competitor_name", "day_no", "hour")
        .agg(F.sum("n").alias("own"))
    )
    without = dense.join(F.broadcast(whole), ["day_no", "hour"]).select(
        F.col("competitor_name").alias("excluded_competitor"),
        "day_no",
        "hour",
        (F.col("n") - F.col("own")).alias("n"),
    )
    everyone = whole.withColumn("excluded_competitor", F.lit(None).cast("string"))
    return without.unionByName(everyone).select(
        "excluded_competitor",
        times.weekday_name(F.col("day_no")).alias("day_of_week"),
        "hour",
        "n",
    )


def calendar(hits, year=2025, deduped=False):
    """Messages per day of the year's active months, placed on a month sheet
    of week rows and Monday-first weekday columns."""
    sent = messages(hits, "local_created_at", deduped=deduped)
    counts = (
        filter_year(sent, year)
        .groupBy(F.to_date("local_created_at").alias("date"))
        .agg(F.count(HIT_ID).alias("n"))
    )
    month = F.trunc("date", "month")
    empty = (
        counts.select(month.alias("month_start"))
        .distinct()
        .select(F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("date"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    days = counts.unionByName(empty).groupBy("date").agg(F.sum("n").alias("n"))
    cell = F.weekday(month) + F.day("date") - 1
    return days.select(
        "date",
        F.month("date").cast("long").alias("month"),
        F.floor(cell / 7).cast("long").alias("week_row"),
        (cell % 7).cast("long").alias("weekday_col"),
        "n",
    ).orderBy("date")


def calendar_by_competitor(hits, year=2025, deduped=False, column="competitor_name"):
    """Messages per day and competitor, with the competitor's share of the day;
    or per day and value of another ``column``."""
    sent = messages(hits, column, "local_created_at", deduped=deduped)
    counts = (
        filter_year(sent, year)
        .where(F.col(column).isNotNull())
        .groupBy(F.to_date("local_created_at").alias("date"), column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy("date"))
    return counts.withColumn("day_total", whole).withColumn("share", F.col("n") / F.col("day_total"))


def message_times(hits):
    """Time of day of every row, as text and as minutes since midnight."""
    second = times.second_of_day(times.parse_lenient(F.col("local_created_at")))
    return hits.select(
        "competitor_name",
        "tracking_id",
        times.clock_text(second).alias("time"),
        (second / F.lit(60.0)).alias("minutes"),
    )


def top_times(hits):
    """Median and mean time of day per account, busiest competitors first.

    A day has 86,400 seconds, so the exact median's state stays that small
    however many rows an account has.
    """
    second = times.second_of_day(times.parse_lenient(F.col("local_created_at")))
    keys = ["tracking_id", "competitor_name"]
    accounts = (
        hits.select(*keys, second.alias("second"))
        .where(F.col("competitor_name").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.floor(F.median("second")).alias("median"),
            F.floor(F.avg("second")).alias("mean"),
        )
    )
    brand = F.sum("rows").alias("competitor_rows")
    return (
        with_group_values(accounts, ["competitor_name"], [brand])
        .where(F.col("tracking_id").isNotNull())
        .select(
            *keys,
            times.clock_text(F.col("median")).alias("median_time"),
            times.clock_text(F.col("mean")).alias("mean_time"),
            "competitor_rows",
        )
        .orderBy(F.desc("competitor_rows"), "competitor_name", "tracking_id")
    )


def time_distribution(hits):
    """Box numbers of the minute of day per competitor, most rows first."""
    second = times.second_of_day(times.parse_lenient(F.col("local_created_at")))
    quarters = F.percentile("second", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    boxes = (
        hits.select("competitor_name", second.alias("second"))
        .dropna()
        .groupBy("competitor_name")
        .agg(F.count(F.lit(1)).alias("n"), quarters.alias("q"))
    )
    boxes = ranked(boxes, [F.desc("n"), F.asc("competitor_name")], "rank")
    names = ["min", "q1", "median", "q3", "max"]
    return boxes.select(
        "rank",
        F.concat(F.col("rank").cast("string"), F.lit(". "), "competitor_name").alias("label"),
        "competitor_name",
        "n",
        *[(F.col("q")[i] / 60).alias(name) for i, name in enumerate(names)],
    )
