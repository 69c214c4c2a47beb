"""The ``hits`` table: one row per offer carried by a tracked message.

``tracking_hit_id`` names the message and repeats once per offer, so every
operator works either on rows (offers) or on messages (one row per id).
"""

from pyspark.sql import types as T

HIT_ID = "tracking_hit_id"

# Optional column added on load: where the row stood in its source file.
# When present, "first row of a message" means the lowest value of it.
ROW_ORDER = "row_order"

LONG_COLUMNS = ["tracking_hit_id", "tracking_id"]

TEXT_COLUMNS = [
    "competitor_name",
    "country",
    "vertical",
    "lifecycle",
    "channel",
    "channel_type",
    "category",
    "classification",
    "email_type",
    "tone_of_voice",
    "type",
    "promotion_type",
    "promotion_types",
    "value",
    "play_value",
    "deposit_requirement",
    "subject",
    "content",
    "translated_content",
    "holiday",
    "from",
    "to",
    "from_ip",
]

TIME_COLUMNS = ["created_at", "local_created_at", "tracking_start_at"]

HITS = T.StructType(
    [T.StructField(c, T.LongType()) for c in LONG_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField(c, T.TimestampNTZType()) for c in TIME_COLUMNS]
)

# Columns a user may narrow the table by.
FILTER_COLUMNS = [
    "vertical",
    "competitor_name",
    "lifecycle",
    "category",
    "promotion_types",
    "channel",
    "country",
    "tracking_id",
]


def require(df, *columns):
    """Fail with a clear message when a report's column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the hits table lacks the columns {missing}")
