"""Text expressions: trimming, sender domains, emoji."""

from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The single code points Unicode counts as emoji, without ASCII
# and the regional letters (those are emoji only in pairs).
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3
23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615
2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712
2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757
2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55
3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A
1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D
1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590
1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC
1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C
1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""


def _char_class(ranges):
    points = ["-".join(rf"\x{{{p}}}" for p in r.split("-")) for r in ranges.split()]
    return "".join(points)


EMOJI_CLASS = _char_class(EMOJI_RANGES)

# Runs that hold no emoji, as few wide ranges: cheap to test per character, so
# the long class above only sees what is left of a text.
_PLAIN_RANGES = _char_class("0-A8 AA-AD AF-203B 329A-1F003")
_PLAIN_RUN = f"[{_PLAIN_RANGES}]+"
_NOT_PLAIN = f"[^{_PLAIN_RANGES}]"
_NOT_EMOJI = f"[^{EMOJI_CLASS}]+"


def strip(col):
    """Cut white space of any kind off both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def sender_domain(sender, unicode_words=True):
    """Lower-case domain of the first address in a From field, else null."""
    flag = "(?U)" if unicode_words else ""
    domain = F.regexp_extract(F.lower(sender), flag + r"[\w.-]+@([\w.-]+)", 1)
    return F.nullif(domain, F.lit(""))


def emoji_only(col):
    """The text with everything but its emoji removed."""
    is_ascii = F.length(col) == F.octet_length(col)
    # a search builds no text, so most texts with accents or other scripts end there
    is_plain = is_ascii | ~F.regexp_like(col, F.lit(_NOT_PLAIN))
    found = F.regexp_replace(F.regexp_replace(col, _PLAIN_RUN, ""), _NOT_EMOJI, "")
    return F.when(is_plain, F.lit("")).otherwise(found)


def any_emoji(emoji_text):
    """Whether what ``emoji_only`` left of a text is anything."""
    return F.coalesce(F.length(emoji_text) > 0, F.lit(False))


def has_emoji(col):
    return any_emoji(emoji_only(col))


def emoji_list(emoji_text):
    """Split a text made of emoji alone into its code points."""
    return F.regexp_extract_all(emoji_text, F.lit("."), 0)
