"""Pseudonyms for personal numbers and dates that keep their format.

Numbers and dates are found by pattern, validated, and mapped to numbers of
their own kind by a keyed permutation, so a card number stays a valid card
number with its separators, and equal values stay equal in all documents. Each
kind's values are numbered within a domain of A x B values; a Feistel network
alternately adds a keyed digest of one part to the other, modulo A or B, which
is a permutation of the domain. All of it is column expressions.

| kind | validated by | permuted |
| --- | --- | --- |
| card | 13 to 19 digits in whole groups with a space or hyphen between, Luhn sum, anywhere in a run of groups | all digits but the last, which is the new check digit |
| phone | ten digits as area, exchange and line | within all ten-digit numbers |
| social | ddd-dd-dddd, no part of zeros, area below 900 and not 666 | within such numbers |
| ip | four numbers up to 255 | within all addresses |
| date | calendar dates yyyy-mm-dd and dd/mm/yyyy, 1800 to 2199 | within the 146,097 days of these years |
| date | mm/dd/yyyy where that is no dd/mm/yyyy | within the 88,497 days after a 12th, so that it stays one |
| mail | local part and domain | letters and digits of the local part, each within its kind, by a network over its even and odd places for each domain |

Only digests of the key, one for each kind and round, are part of the expressions
and so of query plans and event logs; the key itself is not.
"""

import hashlib
import hmac

from pyspark.sql import functions as F

ROUNDS = 8

# In the order in which they are tried at a place. Runs are bounded, so that
# long texts without any match take time in proportion to their length.
PATTERNS = {
    "mail": r"(?<![\w.%+-])[\w.%+-]{1,64}+@[\w-]{1,63}+(?:\.[\w-]{1,63}+){1,8}",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Cards are looked for between these: in runs of digits, spaces and hyphens, at
# each group of digits; the usual groupings go before others.
_RUN = r"(?<!\d)\d[\d -]{12,}+"
_CARD = r"^[ -]*\d(?:[ -]?\d){12,18}$"
_USUAL = r"^[ -]*(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})$"


def _sql(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(text):
    return f"cast({text} as bigint)"


def round_keys(key, kind):
    """Digests of the key for the rounds of a kind, as hexadecimal texts."""
    return [hmac.new(key.encode(), f"{kind}|{i}".encode(), hashlib.sha256).hexdigest() for i in range(ROUNDS)]


def _round_key(key, kind, i):
    """The digest of round ``i``, a number from 0 on."""
    return f"array({', '.join(map(_sql, round_keys(key, kind)))})[{i}]"


def _feistel(kind, a, b, size_a, size_b, key):
    """A struct (a, b): the permuted parts."""
    def digest(i, other):
        return f"cast(conv(substr(sha2(concat({_round_key(key, kind, i)}, '|', {other}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), struct({a} as a, {b} as b), (s, i) -> if(i % 2 = 0, "
        f"struct((s.a + {digest('i', 's.b')} % {size_a}) % {size_a} as a, s.b as b), "
        f"struct(s.a as a, (s.b + {digest('i', 's.a')} % {size_b}) % {size_b} as b)))"
    )


def _with(name, value, body):
    """``body`` with a value named once: SQL has no let, a one-element transform does."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _refilled(match, digits):
    """The match with its digits replaced in order."""
    count = f"length(regexp_replace(substr({match}, 1, i + 1), '[^0-9]', ''))"
    return (f"array_join(transform(split({match}, ''), (c, i) -> "
            f"if(c between '0' and '9', substr({digits}, {count}, 1), c)), '')")


def _luhn(digits, odd_from_end):
    """Luhn sum; ``odd_from_end``: 1 if the last digit counts double."""
    digit = f"cast(substr({digits}, -p, 1) as int)"
    double = f"{digit} * 2 - if({digit} > 4, 9, 0)"
    return (f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + if(p % 2 = {odd_from_end}, {double}, {digit}))")


def _card(key):
    half = "cast((length(d) - 1) div 2 as int)"
    rest = f"(length(d) - 1 - {half})"
    power = "cast(pow(10, {}) as bigint)".format
    f = _feistel("card", _number(f"substr(d, 1, {half})"), _number(f"substr(d, {half} + 1, {rest})"), power(half), power(rest), key)
    body = f"concat(lpad(cast(f.a as string), {half}, '0'), lpad(cast(f.b as string), {rest}, '0'))"
    check = f"cast((10 - {_luhn('n', 1)} % 10) % 10 as string)"
    new = _with("f", f, _with("n", body, _refilled("m", f"concat(n, {check})")))
    return _with("d", "regexp_replace(m, '[^0-9]', '')", new)


def _cards(key):
    """Of a run ``r``: a struct (text, n), its cards replaced and counted.

    ``u`` has each group of digits with what stands before it. A candidate is k
    groups from the i-th on; a start takes its usual grouping, else its longest
    other that no usual grouping starts in. Cards go from left to right.
    """
    window = "array_join(slice(u, i + 1, k), '')".format
    valid = _with("d", "regexp_replace(w, '[^0-9]', '')", f"{_luhn('d', 0)} % 10 = 0")
    fits = _with("w", window(), f"if(w rlike {_sql(_CARD)}, {valid}, false)")
    all_k = f"filter(sequence(1, least(19, size(u) - i)), k -> {fits})"
    usual = f"coalesce(array_min(filter(ks, k -> {window()} rlike {_sql(_USUAL)})), 0)"
    starts = f"transform(u, (x, i) -> {_with('ks', all_k, f'struct({usual} as usual, ks as ks)')})"
    other = "coalesce(array_max(filter(x.ks, k -> not exists(slice(t, i + 2, k - 1), z -> z.usual > 0))), 0)"
    picked = f"filter(transform(t, (x, i) -> struct(i as i, if(x.usual > 0, x.usual, {other}) as k)), c -> c.k > 0)"
    got = (f"aggregate({picked}, struct(0 as free, cast(array() as array<struct<i: int, k: int>>) as got), "
           "(a, c) -> if(c.i >= a.free, struct(c.i + c.k as free, concat(a.got, array(c)) as got), a)).got")
    free = "if(x = 0, 0, got[x - 1].i + got[x - 1].k)"
    card = _with("m", "array_join(slice(u, c.i + 1, c.k), '')", _card(key))
    pieces = f"transform(got, (c, x) -> concat(array_join(slice(u, {free} + 1, c.i - {free}), ''), {card}))"
    last = "if(size(got) = 0, 0, got[size(got) - 1].i + got[size(got) - 1].k)"
    text = f"concat(array_join({pieces}, ''), array_join(slice(u, {last} + 1, size(u) - {last}), ''), regexp_extract(r, '[ -]*$', 0))"
    units = "regexp_extract_all(r, '[ -]*[0-9]+', 0)"
    return _with("u", units, _with("t", starts, _with("got", got, f"struct({text} as text, size(got) as n)")))


def _between(key):
    """Of a text ``g`` between other values: a struct (text, n) as for a run."""
    runs = _with("rs", f"transform(regexp_extract_all(g, {_sql(_RUN)}, 0), r -> {_cards(key)})", _with(
        "gs", f"split(g, {_sql(_RUN)}, -1)",
        "struct(array_join(transform(gs, (x, i) -> if(i < size(rs), concat(x, rs[i].text), x)), '') as text, "
        "aggregate(rs, 0, (a, x) -> a + x.n) as n)"))
    return f"if(g rlike {_sql(_RUN)}, {runs}, struct(g as text, 0 as n))"


def _phone(key):
    half = [_number(f"substr(right(d, 10), {at}, 5)") for at in (1, 6)]
    f = _feistel("phone", *half, 100000, 100000, key)
    new = "concat(left(d, length(d) - 10), lpad(cast(f.a as string), 5, '0'), lpad(cast(f.b as string), 5, '0'))"
    return _with("f", f, _with("n", new, _refilled("m", "n")))


def _social(key):
    area, group, serial = (_number(f"substr(d, {at}, {size})") for at, size in ((1, 3), (4, 2), (6, 4)))
    place = f"(({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1)"
    f = _feistel("social", place, f"({serial} - 1)", 898 * 99, 9999, key)
    new = ("concat(lpad(cast(f.a div 99 + if(f.a div 99 >= 665, 2, 1) as string), 3, '0'), "
           "lpad(cast(f.a % 99 + 1 as string), 2, '0'), lpad(cast(f.b + 1 as string), 4, '0'))")
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    return f"if({valid}, {_with('f', f, _with('n', new, _refilled('m', 'n')))}, m)"


def _ip(key):
    octet = "cast(split(m, '[.]')[{}] as bigint)".format
    f = _feistel("ip", f"({octet(0)} * 256 + {octet(1)})", f"({octet(2)} * 256 + {octet(3)})", 65536, 65536, key)
    new = "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)"
    valid = " and ".join(f"{octet(i)} < 256" for i in range(4))
    return f"if({valid}, {_with('f', f, new)}, m)"


def _date(key):
    iso = "substr(m, 5, 1) = '-'"
    year, first, second = (f"cast(if({iso}, substr(m, {a}, {n}), substr(m, {b}, {n})) as int)"
                           for a, b, n in ((1, 7, 4), (6, 4, 2), (9, 1, 2)))
    start = "date'1800-01-01'"

    def valid(month, day):
        return (f"{year} between 1800 and 2199 and {month} between 1 and 12 and {day} >= 1 "
                f"and {day} <= day(last_day(make_date({year}, {month}, 1)))")

    index = f"cast(datediff(make_date({year}, {first}, {second}), {start}) as bigint)"
    f = _feistel("date", f"({index} div 773)", f"({index} % 773)", 189, 773, key)
    new = f"date_format(date_add({start}, cast(f.a * 773 + f.b as int)), {{}})".format
    day_first = _with("f", f, f"if({iso}, {new(_sql('yyyy-MM-dd'))}, {new(_sql('dd/MM/yyyy'))})")
    # mm/dd: the days from the 13th on are numbered, 12 fewer in each month
    months = f"(({year} - 1800) * 12 + {second} - 1)"
    late = f"cast(datediff(make_date({year}, {second}, {first}), {start}) - 12 * ({months} + 1) as bigint)"
    f = _feistel("date of month first", f"({late} div 9833)", f"({late} % 9833)", 9, 9833, key)
    about = "cast(floor(n / 18.436875D) as int)"
    month = (f"array_max(filter(sequence(greatest({about} - 2, 0), least({about} + 2, 4799)), "
             f"y -> datediff(add_months({start}, y), {start}) - 12 * y <= n))")
    month_first = _with("f", f, _with("n", "cast(f.a * 9833 + f.b as int)", _with(
        "y", month, f"date_format(date_add({start}, n + 12 * (y + 1)), 'MM/dd/yyyy')")))
    return f"case when {valid(first, second)} then {day_first} when not {iso} and {valid(second, first)} then {month_first} else m end"


def _mail(key):
    """Each round moves the letters and digits at every other place on within their
    kind, as far as a digest of the places between says."""
    other = "array_join(filter(s, (x, j) -> (j + r) % 2 = 1), '')"
    digest = f"sha2(concat({_round_key(key, 'mail', 'r')}, '|', o, '|', i div 32, '|', lower(substring_index(m, '@', -1))), 256)"
    by = f"cast(conv(substr({digest}, cast(2 * (i % 32) + 1 as int), 2), 16, 10) as int)"
    moved = (f"case when (i + r) % 2 = 1 then c when c between '0' and '9' then char(48 + (ascii(c) - 48 + {by}) % 10) "
             f"when c between 'a' and 'z' then char(97 + (ascii(c) - 97 + {by}) % 26) else c end")
    step = _with("o", other, f"transform(s, (c, i) -> {moved})")
    start = "split(lower(substring_index(m, '@', 1)), '')"
    return f"concat(array_join(aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {step}), ''), '@', substring_index(m, '@', -1))"


def _pseudonym(key):
    makers = {"mail": _mail, "date": _date, "ip": _ip, "social": _social, "phone": _phone}
    whens = " ".join(f"when m rlike {_sql(f'^(?:{p})$')} then {makers[kind](key)}" for kind, p in PATTERNS.items())
    return _with("d", "regexp_replace(m, '[^0-9]', '')", f"case {whens} else m end")


def pseudonymise(docs, key, text="text"):
    """``docs`` with personal values in ``text`` replaced; adds ``n_found``, the
    values that were (found by pattern but not valid: not counted, kept).

    A null text stays null, an empty one empty, with ``n_found`` 0. Each row is
    treated alone, so repeated rows come out alike and an empty table is empty.
    Other columns stay; a column called ``n_found`` is replaced.
    """
    names = [c for c in docs.columns if c != "n_found"]
    # other columns are put away in one, so that no name clashes
    others = [F.col(f"`{c}`") for c in names if c != text]
    found = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.col(text).alias("_text"))
    whole_text = F.col("_text")
    found = found.withColumn("_found", F.regexp_extract_all(whole_text, F.lit(_ANY), 0))
    new = F.when(F.size("_found") > 0, F.expr(f"transform(_found, m -> {_pseudonym(key)})"))
    gaps = F.split(whole_text, _ANY, -1)
    rest = found.withColumn("_gaps", gaps).withColumn(
        "_rest", F.expr(f"transform(_gaps, g -> {_between(key)})")).withColumn("_new", F.coalesce(new, F.array().cast("array<string>")))
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    cards = F.aggregate("_rest", F.lit(0), lambda n, x: n + x["n"])
    whole = F.array_join(F.flatten(F.zip_with("_rest", F.concat("_new", F.array(F.lit(""))), lambda g, n: F.array(g["text"], n))), "")
    return rest.select(
        *[F.when(whole_text.isNull(), whole_text).otherwise(whole).alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names],
        F.when(whole_text.isNull(), F.lit(0)).otherwise(changed + cards).cast("long").alias("n_found"))
