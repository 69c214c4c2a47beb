"""From rows (offers) to messages: one row per tracking_hit_id."""

from pyspark.sql import functions as F

from hitprism.plans.shared import shared_table
from hitprism.plans.texts import TEXT_KEYS
from hitprism.schema import HIT_ID, HITS, ROW_ORDER, require


_OFFER = ["type", "value", "play_value", "deposit_requirement"]
# The long texts, and what reports derive from them.
_TEXTS = ["subject", "content", "translated_content"]
# Those that no exchange or sort should carry.
_LONG = ["content", "translated_content"]
_DERIVED = {"subject_chars": "subject", "subject_emoji": "subject", "content_emoji": "content", **dict.fromkeys(TEXT_KEYS, "content")}


def _row_keys(df, columns):
    """An order of rows by their values: the offer's columns, nulls last, then a hash of
    all other columns but the texts; then a hash of each text in turn, up to the last
    that ``columns`` need. Rows that tie are alike in all that is asked for, so reports
    agree on the row whatever they read."""
    keys = []
    for c in _OFFER:
        if c in df.columns:
            keys += [F.col(c).isNull().alias(f"no_{c}"), F.col(c)]
    plain = [c for c in HITS.names if c in df.columns and c not in (HIT_ID, *_OFFER, *_TEXTS)]
    texts = [c for c in _TEXTS if c in df.columns]
    read = {_DERIVED.get(c, c) for c in columns}
    unknown = read - set(HITS.names)
    needed = max((i + 1 for i, c in enumerate(texts) if c in read or unknown), default=0)
    groups = [plain, *[[c] for c in texts[:needed]]]
    return keys + [F.xxhash64(*g).alias(f"key_{i}") for i, g in enumerate(groups) if g]


def _first(rows, columns, sort_key):
    """The smallest row of each message by a key, then by the columns' values. Keys and
    columns are worked out below the sort, so that it carries nothing else."""
    keyed = rows.select(HIT_ID, sort_key.alias("k"), F.struct(*columns).alias("row"))
    return keyed.groupBy(HIT_ID).agg(F.min(F.struct("k", "row")).alias("first")).select(HIT_ID, "first.row.*")


def first_rows(df, *columns, order=None, shown=None):
    """The first row of each message, as ``tracking_hit_id`` plus ``columns``.

    Order: the given columns, else the load order if the table carries it (cheapest,
    as no other column is read), else the rows' own values (``_row_keys``). The order
    never depends on which ``columns`` a report asks for, so all reports of a table
    agree on the row. One aggregation with map-side combine.

    ``shown`` (DataFrame to DataFrame, same columns) is what becomes of the long texts
    in the result, such as digests. Rows are ordered as without it, but only hashes and
    what is shown are sorted and shuffled; whole texts are where they alone decide.
    """
    columns = [c for c in columns or df.columns if c not in (HIT_ID, ROW_ORDER)]
    require(df, HIT_ID, *columns)
    if not columns:
        return df.select(HIT_ID).distinct()
    if order is None:
        order = [ROW_ORDER] if ROW_ORDER in df.columns else _row_keys(df, columns)
    sort_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]) if order else F.lit(0)
    if shown is None or not any(c in columns for c in _LONG):
        first = _first(df, columns, sort_key)
        return first if shown is None else shown(first)
    return _first_shown(df, columns, sort_key, shown)


def _first_shown(df, columns, sort_key, shown):
    """``first_rows`` with long texts replaced. Texts are compared by hash: where no row
    that ties in the key has a larger hash than the row found, all rows that tie up to
    the texts have its texts; other messages are done again with whole texts."""
    at = min(columns.index(c) for c in _LONG if c in columns)
    before, rest = columns[:at], columns[at:]
    texts = [c for c in rest if c in _LONG]
    hashes = [F.xxhash64(*texts), F.xxhash64(F.lit("second"), *texts)]
    keyed = shown(df.select(HIT_ID, *columns, sort_key.alias("_key"),
                            F.struct(*[h.alias(f"h{i}") for i, h in enumerate(hashes)]).alias("_texts")))
    keyed = keyed.select(HIT_ID, "_key", F.struct(*before).alias("_before"), "_texts", F.struct(*rest).alias("_rest"))
    turned, turned_back = [F.struct(*[F.bitwise_not(f"{c}.h{i}").alias(f"h{i}") for i in range(len(hashes))])
                           for c in ("_texts", "first._texts")]
    firsts = shared_table(
        keyed.groupBy(HIT_ID).agg(F.min(F.struct("_key", "_before", "_texts", "_rest")).alias("first"),
                                  F.min(F.struct("_key", turned.alias("turned")))["turned"].alias("turned"))
        .select(HIT_ID, *[F.col("first._before")[c].alias(c) for c in before], "first._rest.*",
                (F.col("turned") == turned_back).alias("_decided")),
        "first-rows")
    done = firsts.where("_decided").select(HIT_ID, *columns)
    open_ids = firsts.where("NOT _decided").select(F.col(HIT_ID).alias("_open"))
    if open_ids.isEmpty():
        return done
    again = df.join(open_ids, F.col(HIT_ID).eqNullSafe(F.col("_open")), "left_semi")
    return done.unionByName(shown(_first(again, columns, sort_key)))


def messages(hits, *columns, deduped=False, order=None):
    """Input of a message-level report: ``hits`` itself when already deduped."""
    if deduped:
        require(hits, HIT_ID, *columns)
        return hits.select(HIT_ID, *columns)
    return first_rows(hits, *columns, order=order)
