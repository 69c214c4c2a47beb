"""Reading the hits table and writing reports."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.functions import times
from hitprism.schema import HITS, ROW_ORDER, TIME_COLUMNS

FORMATS = ["parquet", "orc", "csv", "json"]
TEXT_FORMATS = ["csv", "json"]


# What to do with a value, or a line, that does not fit the schema.
BAD = ["fail", "null", "drop"]
CORRUPT = "corrupt_line"


def _read_text(spark, path, fmt, options):
    """Rows of a text format, with the whole line where it did not fit the schema."""
    own = {"header": "true", "enforceSchema": "false"} if fmt == "csv" else {}
    schema = T.StructType([*HITS.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**own, **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def _parsed_whole():
    """Always true, but of all columns: Spark would not parse those it has no use for,
    and bad values there would not be met."""
    return F.xxhash64(*HITS.names) >= F.lit(-(1 << 63))


def read_rejects(spark, path, fmt, **options):
    """The lines of a text format that do not fit the schema, as rows (file, line)."""
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"only {TEXT_FORMATS} can have such lines")
    rows = _read_text(spark, path, fmt, options).where(F.col(CORRUPT).isNotNull() & _parsed_whole())
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("line"))


def read_hits(spark, path, fmt="parquet", keep_row_order=False, bad="fail", **options):
    """Read the hits table with its declared schema; nothing is inferred.

    ``keep_row_order`` adds each row's place in the source (file and row; for other
    formats than parquet file, split and place in it), which then decides what the first row of a
    message is. Text formats fail on values that do not fit the schema; or, by ``bad``,
    take such a value as null and keep what else the line has, or drop the line (see
    ``read_rejects``).
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if bad not in BAD:
        raise ValueError(f"bad must be one of {BAD}")
    if fmt == "csv":
        options = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false", **options}
    if fmt == "json":
        options = {"mode": "FAILFAST", **options}
    if bad == "fail" or fmt not in TEXT_FORMATS:
        hits = spark.read.format(fmt).schema(HITS).options(**options).load(path)
    else:
        hits = _read_text(spark, path, fmt, options)
        if bad == "drop":
            hits = hits.where(F.col(CORRUPT).isNull() & _parsed_whole())
    if keep_row_order:
        file = F.col("_metadata.file_path").alias("file")
        if fmt == "parquet":  # filters still reach the scan
            place = F.struct(file, F.col("_metadata.row_index").alias("row"))
        else:
            place = F.struct(
                file, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
            )
        hits = hits.withColumn(ROW_ORDER, place)
    return hits.drop(CORRUPT)


def parse_times(df, columns=None, strict=True):
    """Make timestamps of text columns. Strict: a bad value fails the query;
    lenient: it becomes null."""
    parse = times.parse_strict if strict else times.parse_lenient
    present = [c for c in columns or TIME_COLUMNS if c in df.columns]
    return df.withColumns({c: parse(F.col(c)) for c in present})


def write_report(report, path, fmt="parquet", ordered=True, mode="errorifexists"):
    """Write a report, one folder each.

    AQE merges small partitions, so small reports end up in one file and big
    ones in files of even size. A report whose order does not matter may be
    rebalanced, which also splits partitions that are too big.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    frame = report if ordered else report.hint("rebalance")
    writer = frame.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
