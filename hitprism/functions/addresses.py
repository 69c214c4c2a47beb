"""IP addresses as text keys of one width, which sort as the addresses do."""

from functools import reduce

from pyspark.sql import functions as F

# Hexadecimal digits of a key.
DIGITS = 32

# Fixed value: where IPv4 addresses stand among all others.
MAPPED = "00000000000000000000ffff"

_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})(\.(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})){3}$"
_V4_TAIL = r"^(.*:)([^:]*\..*)$"


def _v4_digits(address):
    """Eight digits of an IPv4 address; null for any other text."""
    parts = F.split(F.when(F.regexp_like(address, F.lit(_V4)), address), r"\.")
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(parts, F.lit(i)).cast("int"))), 2, "0") for i in range(4)])


def _groups(text):
    """Parts between colons as four digits each; none of an empty text."""
    parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))
    return F.transform(parts, lambda g: F.when(F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$")), F.lpad(g, 4, "0")))


def _v6_digits(address):
    """32 digits of an IPv6 address, in any form that leaves out zeros or ends with
    an IPv4 address; null for any other text."""
    text = F.regexp_replace(F.lower(address), "%.*$", "")
    tail = _v4_digits(F.regexp_extract(text, _V4_TAIL, 2))
    hexed = F.concat(F.regexp_extract(text, _V4_TAIL, 1), F.left(tail, F.lit(4)), F.lit(":"), F.right(tail, F.lit(4)))
    text = F.when(F.contains(text, F.lit(".")), hexed).otherwise(text)
    halves = F.split(text, "::", -1)
    left, right = _groups(F.get(halves, F.lit(0))), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    fits = F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    filled = F.concat(left, F.array_repeat(F.lit("0000"), F.when(fits, missing).otherwise(0)), right)
    whole = fits & ~F.exists(filled, lambda g: g.isNull())
    return F.when(whole, F.array_join(filled, ""))


def address_key(address):
    """32 hexadecimal digits of an IPv4 or IPv6 address; null for any other text."""
    address = F.trim(address)
    return F.coalesce(F.concat(F.lit(MAPPED), _v4_digits(address)), F.when(F.contains(address, F.lit(":")), _v6_digits(address)))


def prefixes(key):
    """The beginnings of a key, from the empty one to the whole."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIGITS)), lambda n: F.left(key, n))


_DIGIT = "0123456789abcdef"


def range_prefixes(first, last):
    """The fewest beginnings that all keys from ``first`` to ``last`` have, and no
    others: an array; empty if the range is.

    Digits that run from 0 to f at the end are left out. Of the rest, the digit after
    what both ends share gives the beginnings between them; further on, those over the
    first key's digits and those under the last key's.
    """
    zeros = F.length(F.regexp_extract(first, "(0*)$", 1))
    effs = F.length(F.regexp_extract(last, "(f*)$", 1))
    size = F.lit(DIGITS) - F.least(zeros, effs)
    a, b = F.left(first, size), F.left(last, size)
    places = F.sequence(F.lit(1), F.lit(DIGITS))
    shared = F.size(F.filter(places, lambda i: (i <= size) & (F.left(a, i) == F.left(b, i))))

    def digit(key, i):
        return F.instr(F.lit(_DIGIT), F.substr(key, i, F.lit(1))) - 1

    def under(key, i, low, high):
        """Beginnings that differ from the key at a place, by digits in between."""
        head = F.left(key, i - 1)
        digits = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(digits, lambda d: F.concat(head, F.substr(F.lit(_DIGIT), d + 1, F.lit(1))))

    deeper = F.filter(places, lambda i: (i > shared + 1) & (i <= size))
    parts = [
        under(a, shared + 1, digit(a, shared + 1) + 1, digit(b, shared + 1) - 1),
        F.flatten(F.transform(deeper, lambda i: under(a, i, digit(a, i) + 1, F.lit(15)))),
        F.flatten(F.transform(deeper, lambda i: under(b, i, F.lit(0), digit(b, i) - 1))),
        F.array(a, b),
    ]
    whole = F.when(a == b, F.array(a)).otherwise(reduce(lambda x, y: F.concat(x, y), parts))
    return F.when(first <= last, whole).otherwise(F.array().cast("array<string>"))
