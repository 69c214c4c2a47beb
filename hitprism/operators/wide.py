"""Wide forms: one column per value, as a report table shows them."""

from pyspark.sql import functions as F


def widen(tall, rows, column, value, columns=None, fill=0):
    """Pivot a tall report; absent cells become ``fill``.

    ``column`` may be a name or an expression. Naming the ``columns`` saves
    Spark the query that looks them up. Above Spark's limit of pivot columns
    (``spark.sql.pivotMaxValues``) this fails; keep the tall form there.
    """
    label = F.col(column) if isinstance(column, str) else column
    keys = [rows] if isinstance(rows, str) else list(rows)
    cells = tall.select(*keys, label.alias("pivot_column"), F.col(value).alias("cell"))
    if columns is None:
        columns = _values(cells)
    wide = cells.groupBy(*keys).pivot("pivot_column", columns).agg(F.first("cell"))
    return wide.fillna(fill)


def _values(cells):
    most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = cells.select("pivot_column").distinct().orderBy("pivot_column").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} columns: use the tall form, or name the columns")
    return [r[0] for r in found]


def cross_tab_label():
    """Heading of a cross-tab column."""
    return F.concat_ws(" | ", "vertical", "lifecycle", "channel")
