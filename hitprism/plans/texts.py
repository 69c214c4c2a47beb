"""Expressions over long texts, worked out once for each distinct text."""

from pyspark.sql import functions as F

from hitprism.plans.shared import shared_table
from hitprism.schema import HIT_ID

# So many distinct texts may be looked up by hash, 24 bytes each, if what the rule
# gives for all of them has so many bytes at most.
MOST_TEXTS, MOST_BYTES = 1_000_000, 64 << 20

#: Columns of the 128-bit hash of a text.
TEXT_KEYS = ["text_key_1", "text_key_2"]
_HIT, _TEXT = "text_hit", "text_once"


def once(value, name):
    """A column to select that is worked out once for each row: ``explode`` of one value
    keeps Spark from putting its expression into all that use it."""
    return F.explode(F.array(value)).alias(name)


def text_keys(column, known):
    """The hash of a text, by column name; null where it is not known."""
    text = F.col(column)
    return {k: F.when(known, h) for k, h in zip(TEXT_KEYS, [F.xxhash64(text), F.xxhash64(F.lit("second"), text)])}


def _carriers(keyed):
    """One message for each distinct text, by the text's hash."""
    # in the order of their hashes: the first messages stand together
    return shared_table(keyed.groupBy(*TEXT_KEYS).agg(F.min_by(HIT_ID, F.xxhash64(HIT_ID)).alias(_HIT)), "texts")


def _texts_of(own, carriers):
    """The rows of ``own`` that hold the carriers' texts."""
    same = [own[k] == carriers[k] for k in TEXT_KEYS] + [own[HIT_ID].eqNullSafe(carriers[_HIT])]
    return own.join(F.broadcast(carriers), same, "left_semi")


def text_values(df, column, name, rule, firsts):
    """Rows of a text's hash and ``rule`` of it, for the texts that the messages
    ``firsts`` have (``HIT_ID`` and ``TEXT_KEYS`` of ``column``). No text meets an
    exchange; beyond ``MOST_TEXTS`` the rule is applied to each row of ``df``."""
    own = df.where(F.col(column).isNotNull()).select(HIT_ID, column).withColumns(text_keys(column, F.col(column).isNotNull()))
    carriers = _carriers(firsts.where(F.col(TEXT_KEYS[0]).isNotNull()))
    found = own if carriers.count() > MOST_TEXTS else _texts_of(own, carriers)
    return found.select(*TEXT_KEYS, once(F.col(column), _TEXT)).select(*TEXT_KEYS, rule(F.col(_TEXT)).alias(name)).distinct()


def with_text_value(df, column, name, rule, where=None, first=lambda text: text):
    """Add ``rule`` of a text column, for the rows where a condition holds; ``first`` is
    worked out before it, once for each text.

    Texts recur: as the offers of a message, and in campaigns. Each one's 128-bit
    hash is counted first, together with one message that carries it; only there is
    the rule applied, and its values are joined to all rows by hash. No text meets
    an exchange: hashes and values are broadcast. Where more texts than ``MOST_TEXTS``
    differ, or their values have more than ``MOST_BYTES``, the rule is applied to each
    row.
    """
    text = F.col(column)
    known = text.isNotNull() if where is None else text.isNotNull() & where
    own = df.where(known).select(HIT_ID, column).withColumns(text_keys(column, text.isNotNull()))
    carriers = _carriers(own)
    if carriers.count() <= MOST_TEXTS:
        found = _texts_of(own, carriers).select(*TEXT_KEYS, once(first(text), _TEXT))
        values = shared_table(found.select(*TEXT_KEYS, rule(F.col(_TEXT)).alias(name)).distinct(), "text-values")
        size = F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0))
        if values.agg(size.alias("size")).first()["size"] <= MOST_BYTES:
            keyed = df.withColumns(text_keys(column, known))
            return keyed.join(F.broadcast(values), TEXT_KEYS, "left").select(*df.columns, name)
    whole = df.select("*", once(F.when(known, first(text)), _TEXT))
    return whole.withColumn(name, F.when(known, rule(F.col(_TEXT)))).drop(_TEXT)
