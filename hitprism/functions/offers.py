"""Offer expressions."""

from pyspark.sql import functions as F

# Names that reports must carry as they are.
NO_PROMO = "No Promo"
NO_VALUE = "No Value"
BRANDING = "Branding"
SYSTEM_MESSAGE = "System Message"
PROMOTIONAL = "Promotional"
SERVICE_EMAIL_TYPES = ["Welcome", "Informational", "System", "Transactional"]
OFFER_NAMES = [
    # pattern (whole words, any case), name to use
    (r"(?i)\bfree chip\b", "Free Chips"),
    (r"(?i)\bTournament Entry\b", "Tournament"),
]


def type_or_default(type_):
    return F.coalesce(type_, F.lit(NO_PROMO))


def value_or_default(value):
    return F.coalesce(value, F.lit(NO_VALUE))


def offer_label(type_, value):
    return F.concat(type_or_default(type_), F.lit(" - "), value_or_default(value))


def first_number(text):
    """First number in a text as double, null if there is none."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def normal_type(type_):
    for pattern, name in OFFER_NAMES:
        type_ = F.regexp_replace(type_, pattern, name)
    return type_


def message_kind(email_type, type_):
    """Name a message that carries no offer after the kind of email it is."""
    no_offer = type_ == NO_PROMO
    return (
        F.when(no_offer & (email_type == PROMOTIONAL), F.lit(BRANDING))
        .when(no_offer & email_type.isin(SERVICE_EMAIL_TYPES), F.lit(SYSTEM_MESSAGE))
        .otherwise(type_)
    )


def offer_text(type_, value, play_value):
    """``type: value`` with play_value as stand-in; null when nothing is known."""
    kind = F.nullif(type_, F.lit(""))
    amount = F.coalesce(F.nullif(value, F.lit("")), F.nullif(play_value, F.lit("")))
    return F.coalesce(F.concat(kind, F.lit(": "), amount), amount, kind)
