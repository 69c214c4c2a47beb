"""Timestamp expressions. All timestamps are naive (TIMESTAMP_NTZ)."""

from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

# The days of the week, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SHORT_DATE = "dd-MMM-yyyy"
LONG_DATE = "dd-MMMM-yyyy"


def parse_lenient(col):
    """Text or date to timestamp; null where it does not parse."""
    return col.try_cast("timestamp_ntz")


def parse_strict(col):
    """Text or date to timestamp; the query fails on a value that does not parse.

    Independent of the session's ANSI setting.
    """
    parsed = col.try_cast("timestamp_ntz")
    bad = col.isNotNull() & parsed.isNull()
    message = F.concat(F.lit("not a timestamp: "), col.cast("string"))
    return F.when(bad, F.raise_error(message).cast("timestamp_ntz")).otherwise(parsed)


def micros_between(start, end):
    return F.timestamp_diff("MICROSECOND", start, end)


def whole_days(start, end):
    """Whole days from start to end, rounded down also below zero."""
    return F.floor(micros_between(start, end) / F.lit(MICROS_PER_DAY)).cast("long")


def hours(start, end):
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def weekday_number(ts):
    """Monday 0 to Sunday 6."""
    return F.weekday(ts).cast("long")


def weekday_name(number):
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (number + 1).cast("int"))


def hour_of_day(ts):
    return F.hour(ts).cast("long")


def second_of_day(ts):
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def clock_text(seconds):
    """Seconds since midnight as HH:MM:SS."""
    return F.when(
        seconds.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(seconds / 3600).cast("long"),
            F.floor(seconds % 3600 / 60).cast("long"),
            (seconds % 60).cast("long"),
        ),
    )
