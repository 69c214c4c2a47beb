"""Seasonal campaign labels."""

from pyspark.sql import functions as F

# Season names, the words and the emoji that point to them.
BLACK_FRIDAY = "Black Friday"
CHRISTMAS = "Christmas"
CHRISTMAS_COLUMN_WORDS = ["christmas", "advent", "holiday season"]
BLACK_COLUMN_WORD = "black"
BLACK_COLUMN_WORDS = ["friday", "week"]
BLACK_FRIDAY_WORDS = ["black friday", "cyber monday", "thanksgiving"]
BLACK_FRIDAY_JOINED = "blackfriday"
CHRISTMAS_WORDS = ["christmas", "xmas"]
CHRISTMAS_EMOJI = ["🎄", "🎅", "❄", "⛄", "🧦"]
BLACK_FRIDAY_EMOJI = ["🦃"]
CHRISTMAS_MARKER = "🎄"
BLACK_FRIDAY_MARKER = "🖤"

SEASONS = [BLACK_FRIDAY, CHRISTMAS]


def _mentions(text, words):
    test = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(text, F.lit(word))
    return test


def _column_season(holiday):
    """Season named by the holiday column itself, else null."""
    name = F.lower(F.coalesce(holiday, F.lit("")))
    black = F.contains(name, F.lit(BLACK_COLUMN_WORD)) & _mentions(name, BLACK_COLUMN_WORDS)
    return F.when(black, F.lit(BLACK_FRIDAY)).when(
        _mentions(name, CHRISTMAS_COLUMN_WORDS), F.lit(CHRISTMAS)
    )


# Each season word holds one of these, so most texts need three searches only.
HINTS = ["day", "mas", BLACK_FRIDAY_WORDS[2]]

# Characters of the long text that a word begun in the subject can reach.
EDGE = 16


def joined_edge(subject, translated):
    """Subject and the start of the text after it, where words can span both."""
    empty = F.lit("")
    return F.concat(F.coalesce(subject, empty), F.lit(" "), F.left(F.coalesce(translated, empty), F.lit(EDGE)))


def season_marks(text):
    """Which season words and emoji a text in lower case holds; a struct. Make the
    text a column of its own first, as it is searched many times."""
    hinted = _mentions(text, HINTS)
    # only texts with characters of several bytes can hold emoji
    wide = F.length(text) < F.octet_length(text)
    return F.struct(
        (hinted & _mentions(text, BLACK_FRIDAY_WORDS)).alias("black_friday"),
        (hinted & F.contains(text, F.lit(BLACK_FRIDAY_JOINED))).alias("joined"),
        (hinted & _mentions(text, CHRISTMAS_WORDS)).alias("christmas"),
        (wide & _mentions(text, CHRISTMAS_EMOJI)).alias("christmas_emoji"),
        (wide & _mentions(text, BLACK_FRIDAY_EMOJI)).alias("black_friday_emoji"),
    )


def type_needs_text(holiday):
    """Whether ``holiday_type`` has to look at the text."""
    return _column_season(holiday).isNull()


def label_needs_text(holiday):
    """Whether ``holiday_label`` has to look at the text."""
    return F.coalesce(holiday, F.lit("")) == ""


def holiday_type(holiday, marks):
    """Season of a message from its holiday column, words or emoji (``marks``: a
    function from a mark to whether the message has it); else null."""
    return F.coalesce(
        _column_season(holiday),
        F.when(marks("black_friday"), F.lit(BLACK_FRIDAY)).when(marks("christmas"), F.lit(CHRISTMAS)),
        F.when(marks("christmas_emoji"), F.lit(CHRISTMAS)).when(marks("black_friday_emoji"), F.lit(BLACK_FRIDAY)),
    )


def holiday_label(holiday, marks):
    """As ``holiday_type``, but other holiday names are kept, emoji do not
    count, and a message without any holiday gets the empty text."""
    words = F.when(marks("black_friday") | marks("joined"), F.lit(BLACK_FRIDAY)).when(marks("christmas"), F.lit(CHRISTMAS))
    own = F.nullif(holiday, F.lit(""))
    return F.coalesce(_column_season(holiday), own, words, F.lit(""))
