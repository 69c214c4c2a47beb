"""The short summary: totals, leaders, and the advice drawn from them (row level)."""

from functools import reduce
from string import Formatter

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.operators.counts import N_ROWS, n_rows, n_rows_column

SUMMARY, ADVICE = "summary", "recommendation"

# The sentences, whole; each {column} is filled in.
SENTENCES = {
    "rows": ["Total messages tracked: **{value}**"],
    "competitors": ["Total number of competitors: **{value}**"],
    "names": ["Competitors: **{value}**"],
    "vertical": [
        "Total number of {vertical} competitors: **{competitors}**",
        "{vertical} Competitors: **{names}**",
        "Total messages in {vertical}: **{n}**",
    ],
    "promotion": ["Most common promotion type: **{value}** ({n} times)"],
    "day": ["Peak activity day: **{value}** with {n} messages"],
    "category": ["Most common content category: **{value}**"],
    "single": ["All messages are classified as: **{classification}**"],
}
ADVICE_SENTENCES = {
    "promotion": ["Consider emphasizing `{value}` in your upcoming campaigns based on volume."],
    "day": ["Evaluate the content and timing on {value} to understand what drove high engagement."],
    "category": ["Ensure variety in content strategy if one category like `{value}` dominates."],
    "single": ["Review classification criteria to ensure it's capturing message diversity."],
}


def _names():
    return F.array_join(F.array_sort(F.collect_list("competitor_name")), ", ")


def totals(hits):
    """Number of rows, number and names of competitors."""
    per_name = hits.groupBy("competitor_name").agg(n_rows(hits).alias("n"))
    one = per_name.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("competitor_name").alias("competitors"),
        _names().alias("names"),
    )
    text = [F.col(c).cast("string").alias(c) for c in one.columns]
    return one.select(*text).unpivot([], ["rows", "competitors", "names"], "metric", "value")


def vertical_totals(hits):
    """Per vertical: number and names of competitors, number of rows."""
    per_name = (
        hits.where(F.col("vertical").isNotNull())
        .groupBy("vertical", "competitor_name")
        .agg(n_rows(hits).alias("n"))
    )
    return per_name.groupBy("vertical").agg(
        F.count("competitor_name").alias("competitors"),
        _names().alias("names"),
        F.sum("n").alias("n"),
    )


_LEADERS = {"promotion_types": "promotion", "date": "day", "category": "category"}


def leaders(hits):
    """Most common promotion type, busiest local day, most common category.

    All three in one pass; of equally common values the first in name order.
    """
    rows = hits.select(
        "promotion_types", "category", F.to_date("local_created_at").cast("string").alias("date"), n_rows_column(hits)
    )
    sets = [[F.col(c)] for c in _LEADERS]
    metric = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(m)) for c, m in _LEADERS.items()])
    first = Window.partitionBy("metric").orderBy(F.desc("n"), "value")
    return (
        rows.groupingSets(sets, *_LEADERS)
        .agg(F.sum(N_ROWS).alias("n"), metric.alias("metric"))
        .select("metric", F.coalesce(*_LEADERS).alias("value"), "n")
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") == 1)
        .drop("place")
    )


def single_classification(hits):
    """Whether all rows share one classification, and which."""
    column = F.col("classification")
    low, high = F.min(column), F.max(column)
    all_set = F.count(column) == F.count(F.lit(1))
    single = F.coalesce((low == high) & all_set, F.lit(False))
    return hits.agg(single.alias("is_single"), F.when(single, low).alias("classification"))


def _filled(sentence):
    """The sentence as an expression over the columns it names."""
    parts = []
    for text, column, _, _ in Formatter().parse(sentence):
        parts += [F.lit(text), *([F.col(column).cast("string")] if column else [])]
    return F.concat(*parts)


def _lines(df, section, block, sentences, key=None):
    """One row per sentence and row, with keys that put the lines in order."""
    return df.select(
        F.lit(section).alias("section"),
        F.lit(block).alias("block"),
        (F.lit("") if key is None else F.col(key)).alias("key"),
        F.posexplode(F.array(*map(_filled, sentences))).alias("pos", "text"),
    )


def summary_lines(hits, counted=None):
    """Summary and advice as text lines, numbered from 1 in each section. ``counted``:
    a function from the name of a set of columns to its counted rows, if there are."""
    brands = classes = days = hits
    if counted:
        brands, classes = counted("channel"), counted("classification")
        days = counted("promotion").unionByName(counted("local_day"), allowMissingColumns=True)
    total, lead = totals(brands), leaders(days)
    frames = {m: total.where(F.col("metric") == m) for m in ("rows", "competitors", "names")}
    frames |= {m: lead.where(F.col("metric") == m) for m in _LEADERS.values()}
    frames |= {"vertical": vertical_totals(brands), "single": single_classification(classes).where("is_single")}
    parts = [
        _lines(frames[about], section, block, sentences, "vertical" if about == "vertical" else None)
        for section, table in ((SUMMARY, SENTENCES), (ADVICE, ADVICE_SENTENCES))
        for block, (about, sentences) in enumerate(table.items(), 1)
    ]
    lines = reduce(lambda a, b: a.unionByName(b), parts)
    in_order = Window.partitionBy("section").orderBy("block", "key", "pos")
    return lines.select(
        "section", F.row_number().over(in_order).cast("long").alias("line_no"), "text"
    ).orderBy(F.desc("section"), "line_no")
