"""Narrowing the table: chosen values, dates, account periods."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.functions import times
from hitprism.plans.groups import with_group_values
from hitprism.plans.shared import shared_table
from hitprism.schema import FILTER_COLUMNS, require

# Longer value lists are joined instead of spelled out in the plan.
IN_LIST_MAX = 1000


def filter_in(df, chosen):
    """Keep rows whose columns are in the chosen lists; all lists must hold.

    An empty list, or a column the table lacks, does not filter.
    """
    unknown = set(chosen) - set(FILTER_COLUMNS)
    if unknown:
        raise ValueError(f"cannot filter by {sorted(unknown)}")
    for column, values in chosen.items():
        values = list(values or [])
        if not values or column not in df.columns:
            continue
        values = _typed(values, df.schema[column].dataType)
        if len(values) <= IN_LIST_MAX:
            df = df.where(F.col(column).isin(values))
        else:
            listed = df.sparkSession.createDataFrame(
                [(v,) for v in values], df.select(column).schema
            )
            df = df.join(listed, column, "left_semi")
    return df


def _typed(values, kind):
    """The values in the column's type, nulls (which match nothing) left out;
    the same list, or the same error, whatever its length."""
    make = int if isinstance(kind, T.IntegralType) else str if isinstance(kind, T.StringType) else None
    if make is None:
        raise ValueError(f"cannot filter a column of type {kind.simpleString()} by a list")
    return [make(v) for v in values if v is not None]


def _midnight(day):
    return F.lit(dt.datetime.combine(day, dt.time())).cast("timestamp_ntz")


def filter_dates(df, first, last, column="local_created_at"):
    """Keep rows dated from ``first`` to ``last``, both days included.

    A half-open range on the timestamp itself, so that it reaches the scan.
    """
    after = last + dt.timedelta(days=1)
    return df.where((F.col(column) >= _midnight(first)) & (F.col(column) < _midnight(after)))


def filter_year(df, year, column="local_created_at"):
    return filter_dates(df, dt.date(year, 1, 1), dt.date(year, 12, 31), column)


def filter_options(df, column):
    """The values a user can choose from; accounts come sorted."""
    options = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return options.orderBy("value") if column == "tracking_id" else options


def filter_cascade(df, chosen):
    """The values left to choose from at each filter, as rows (position, column,
    value): those of the rows that fit all choices before it.

    ``chosen`` maps columns to the values taken, in the order of ``FILTER_COLUMNS``; an
    empty list does not narrow. Values are text, nulls are no choice. One scan: rows
    are reduced to the distinct combinations of the filter columns, each of which
    knows the first filter that it fails and counts for all filters up to that one.
    """
    unknown = set(chosen) - set(FILTER_COLUMNS)
    if unknown:
        raise ValueError(f"cannot filter by {sorted(unknown)}")
    columns = [c for c in FILTER_COLUMNS if c in df.columns]
    fails = F.lit(len(columns))
    for place, column in reversed(list(enumerate(columns))):
        values = list(chosen.get(column) or [])
        if values:
            fits = _fits(df, column, values)
            fails = F.when(fits, fails).otherwise(F.lit(place))
    combinations = df.select(*columns).distinct()
    offered = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                        for i, c in enumerate(columns)])
    return (
        combinations.select(F.explode(F.slice(offered, F.lit(1), F.least(fails + 1, F.lit(len(columns))))).alias("offer"))
        .select("offer.*").where(F.col("value").isNotNull()).distinct()
    )


def _fits(df, column, values):
    """Whether a column is in a list; false for null."""
    return F.coalesce(F.col(column).isin(_typed(values, df.schema[column].dataType)), F.lit(False))


def date_bounds(df):
    ts = F.col("local_created_at")
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def _positive(n):
    if n < 1:
        raise ValueError("the number of days must be at least 1")


# So many accounts may be sent to all tasks, as two numbers each.
MOST_ACCOUNTS = 2_000_000


def _with_account_value(df, value):
    """Attach an aggregate of each account to its rows; rows without one drop out.

    The accounts are aggregated from two narrow columns into a table of their own. As
    long as there are few enough they are broadcast, so that whole rows, texts and all,
    never meet an exchange; more accounts are joined by shuffle.
    """
    accounts = df.where(F.col("tracking_id").isNotNull()).groupBy("tracking_id").agg(value)
    accounts = shared_table(accounts, "accounts")
    if accounts.count() <= MOST_ACCOUNTS:
        return df.join(F.broadcast(accounts), "tracking_id").select(*df.columns, accounts.columns[-1])
    return with_group_values(df, ["tracking_id"], [value])


def first_n_days(df, n):
    """Rows within the first ``n`` days of their account, with ``days_since``
    its first message by local time. Rows without an account drop out."""
    _positive(n)
    require(df, "tracking_id", "local_created_at")
    first = F.min("local_created_at").alias("first_at")
    days = times.whole_days(F.col("first_at"), F.col("local_created_at"))
    rows = _with_account_value(df, first).withColumn("days_since", days)
    return rows.where(F.col("days_since") <= n - 1).drop("first_at")


def last_n_days(df, n):
    """Rows within the last ``n`` days of their account, with ``days_since``
    counted back from its latest message by ``created_at``."""
    _positive(n)
    require(df, "tracking_id", "created_at")
    last = F.max("created_at").alias("last_at")
    days = times.whole_days(F.col("created_at"), F.col("last_at"))
    rows = _with_account_value(df, last).withColumn("days_since", days)
    return rows.where(F.col("days_since") < n).drop("last_at")


def first_hours(df, n=48):
    """Rows sent up to ``n`` hours after sign-up, with ``hours_since``; rows
    dated before the sign-up count too."""
    require(df, "tracking_start_at", "local_created_at")
    since = times.hours(F.col("tracking_start_at"), F.col("local_created_at"))
    return df.withColumn("hours_since", since).where(F.col("hours_since") <= n)
