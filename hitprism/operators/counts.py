"""Rows counted once for all reports that only count rows.

``row_counts`` makes one pass over the rows for several sets of columns. Its part
for a set has those columns, once per combination, and the number of rows behind it in
``N_ROWS``; reports add that up instead of counting (``n_rows``), so they give the same
result for the rows and for the counted rows.
"""

from pyspark.sql import functions as F

N_ROWS = "n_rows"

# Sets of columns, by name; days stand for moments.
SETS = {
    "created_day": ["created_at"],
    "local_day": ["local_created_at"],
    "promotion": ["promotion_types", "category"],
    "classification": ["classification"],
    "channel_type": ["channel_type"],
    "channel": ["vertical", "competitor_name", "channel"],
    "offer": ["competitor_name", "lifecycle", "type", "value"],
}
_DAYS = ["created_at", "local_created_at"]


def n_rows(df):
    """The number of rows, as an aggregate over rows or counted rows."""
    return F.sum(N_ROWS) if N_ROWS in df.columns else F.count(F.lit(1))


def n_rows_column(df):
    """The rows behind each row: 1, or what was counted."""
    return F.col(N_ROWS) if N_ROWS in df.columns else F.lit(1).cast("long").alias(N_ROWS)


def row_counts(hits):
    """Rows (part, all columns of the sets, n_rows): one grouping-sets pass; columns
    that are not in a part's set are null."""
    columns = list(dict.fromkeys(c for names in SETS.values() for c in names))
    rows = hits.select(*[F.to_date(c).cast("timestamp_ntz").alias(c) if c in _DAYS else F.col(c) for c in columns])
    own = F.coalesce(*[F.when(F.grouping_id() == _grouping(columns, names), F.lit(part)) for part, names in SETS.items()])
    return rows.groupingSets([[F.col(c) for c in names] for names in SETS.values()], *columns).agg(
        F.count(F.lit(1)).alias(N_ROWS), own.alias("part"))


def _grouping(columns, names):
    """The grouping id of a set: a bit per column, 1 if it is left out."""
    return sum((c not in names) << i for i, c in enumerate(reversed(columns)))


def part(counted, name):
    """The counted rows of one set."""
    return counted.where(F.col("part") == name).select(*SETS[name], N_ROWS)
