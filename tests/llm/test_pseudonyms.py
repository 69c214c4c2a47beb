"""Pseudonyms over the whole small table, and what their patterns must find."""

import datetime as dt
import hashlib
import re

from conftest import DATA

from hitprism.llm import pii
from hitprism.llm import queries as q

PHONE = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")


def shape(text):
    return re.sub(r"\d", "9", text)


def replaced(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymise(table, "k").collect()}
    return [found[i] for i in range(len(texts))]


def test_all_phones_of_the_table(spark):
    before = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    after = {r.doc_id: (r.text or "", r.n_found) for r in q.pii_pseudonyms(spark, DATA).collect()}
    assert before.keys() == after.keys()
    pairs = []
    for d, text in before.items():
        new, n = after[d]
        old_phones, new_phones = PHONE.findall(text), PHONE.findall(new)
        assert len(old_phones) == len(new_phones) and n >= len(old_phones)
        pairs += zip(old_phones, new_phones)
        if not n:
            assert new == text
    assert all(a != b for a, b in pairs)
    assert len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_any_area_and_exchange(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "call 123-045-6789.", "000.000.0000"]
    for text, (new, n) in zip(texts, replaced(spark, texts)):
        assert n == 1 and new != text and shape(new) == shape(text)


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [card, f"{card} 123", f"{card} 12/27", f"7 {card}", f"{card} 5500 0000 0000 0004", f"{card} 988-555-2485",
             f"{card} 12/12/1990", "1 2 3  4 - 5", "4111111111111111222222222222222222"]
    got = replaced(spark, texts)
    assert [n for _, n in got] == [1, 1, 1, 1, 2, 2, 2, 0, 0]
    new = got[0][0]
    assert new != card and shape(new) == shape(card)
    assert [got[i][0] for i in (1, 2, 3)] == [f"{new} 123", f"{new} 12/27", f"7 {new}"]
    assert all(got[i][0].startswith(new) and shape(got[i][0]) == shape(texts[i]) for i in (4, 5, 6))
    assert [got[i][0] for i in (7, 8)] == texts[7:]


def test_month_before_day(spark):
    texts = ["12/25/1990", "25/12/1990", "02/30/1990"]
    (new, n), (other, m), kept = replaced(spark, texts)
    assert n == m == 1 and kept == (texts[2], 0)
    assert new != texts[0] and 1 <= int(new[:2]) <= 12 < int(new[3:5]) and int(other[3:5]) <= 12
    days = spark.range(146097).selectExpr("id as doc_id", "date_add(date'1800-01-01', cast(id as int)) as day").where("day(day) > 12")
    days = days.selectExpr("doc_id", "date_format(day, 'MM/dd/yyyy') as text")
    out = pii.pseudonymise(days, "k")
    assert tuple(out.selectExpr("count(distinct text)", "min(int(substr(text, 4, 2)))", "sum(n_found) > 88000").first()) == (88497, 13, True)


def feistel(kind, a, b, size_a, size_b, key):
    for i, k in enumerate(pii.round_keys(key, kind)):
        by = int(hashlib.sha256(f"{k}|{a if i % 2 else b}".encode()).hexdigest()[:15], 16)
        a, b = ((a, (b + by) % size_b) if i % 2 else ((a + by) % size_a, b))
    return a, b


def refilled(text, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in text)


def pseudonym(m, key):
    """What a match of one of the patterns becomes, in plain Python."""
    kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m, re.ASCII))
    d = re.sub(r"\D", "", m)
    if kind == "phone":
        a, b = feistel(kind, int(d[-10:-5]), int(d[-5:]), 10**5, 10**5, key)
        return refilled(m, f"{d[:-10]}{a:05}{b:05}")
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = feistel(kind, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "social":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        areas = [n for n in range(1, 900) if n != 666]
        if area not in areas or not group or not serial:
            return m
        a, b = feistel(kind, areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key)
        return refilled(m, f"{areas[a // 99]:03}{a % 99 + 1:02}{b + 1:04}")
    if kind == "mail":
        local, domain = m.split("@")
        s = list(local.lower())
        for r, k in enumerate(pii.round_keys(key, kind)):
            other = "".join(s[1 - r % 2::2])
            for i in range(r % 2, len(s), 2):
                by = hashlib.sha256(f"{k}|{other}|{i // 32}|{domain.lower()}".encode()).digest()[i % 32]
                for first, n in (("0", 10), ("a", 26)):
                    if 0 <= ord(s[i]) - ord(first) < n:
                        s[i] = chr(ord(first) + (ord(s[i]) - ord(first) + by) % n)
                        break
        return "".join(s) + "@" + domain
    iso = m[4] == "-"
    forms = ["%Y-%m-%d"] if iso else ["%d/%m/%Y", "%m/%d/%Y"]
    start = dt.date(1800, 1, 1)
    for form in forms:
        try:
            day = dt.datetime.strptime(m, form).date()
        except ValueError:
            continue
        if not 1800 <= day.year <= 2199:
            continue
        if form != "%m/%d/%Y":
            a, b = feistel("date", *divmod((day - start).days, 773), 189, 773, key)
            day = start + dt.timedelta(a * 773 + b)
        else:
            late = [start + dt.timedelta(i) for i in range(146097)]
            late = [x for x in late if x.day > 12]
            a, b = feistel("date of month first", *divmod(late.index(day), 9833), 9, 9833, key)
            day = late[a * 9833 + b]
        return day.strftime(form).rjust(10, "0")
    return m


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def card(m, key):
    d = re.sub(r"\D", "", m)
    half = (len(d) - 1) // 2
    rest = len(d) - 1 - half
    a, b = feistel("card", int(d[:half]), int(d[half:-1]), 10**half, 10**rest, key)
    body = f"{a:0{half}}{b:0{rest}}"
    return refilled(m, body + str(-luhn(body + "0") % 10))


def test_query_equals_brute_force(spark):
    before = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    after = {r.doc_id: (r.text, r.n_found) for r in q.pii_pseudonyms(spark, DATA).collect()}
    found = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), re.ASCII)
    usual = re.compile(r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?!\d)")
    n_values = 0
    for d, text in before.items():
        parts, n, at = [], 0, 0
        spans = [*found.finditer(text or ""), None]
        for m in spans:
            gap = (text or "")[at:m.start() if m else None]
            for c in usual.findall(gap):  # the table has cards in usual groups only
                if luhn(re.sub(r"\D", "", c)) == 0:
                    gap, n = gap.replace(c, card(c, q.PII_KEY)), n + 1
            parts.append(gap)
            if m:
                new = pseudonym(m[0], q.PII_KEY)
                parts.append(new)
                n, at = n + (new != m[0]), m.end()
        assert after[d] == (text if text is None else "".join(parts), n), d
        n_values += n
    assert n_values > 20


def test_short_mail_names_stay_apart(spark):
    texts = [f"{c}{n}@b.co" for c in "abcdefghijklmnopqrstuvwxyz" for n in ["", *range(10)]] + ["a@c.co", "A.b-9_z@B.co", "a.b-9_z@B.co"]
    new = [t for t, _ in replaced(spark, texts)]
    assert len(set(new[:-3])) == len(texts) - 3
    assert all(re.fullmatch(r"[a-z]\d?@b.co", t) for t in new[:-3])
    assert new[-1] == new[-2] and re.fullmatch(r"[a-z]\.[a-z]-\d_[a-z]@B.co", new[-1])


def test_the_key_is_not_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.pseudonymise(table, "very secret")._jdf.queryExecution().toString()
    assert "very secret" not in plan


def test_repeated_rows_and_edges(spark):
    rows = [(1, "a@b.co 10.1.2.3"), (1, "a@b.co 10.1.2.3"), (2, None), (3, ""), (None, "x " * 50_000 + "a@b.co")]
    table = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, _found string, n_found long")
    got = sorted((tuple(r) for r in pii.pseudonymise(table, "k").select("doc_id", "text", "n_found").collect()), key=repr)
    assert got[0] == got[1] and got[0][2] == 2 and (2, None, 0) in got and (3, "", 0) in got
    assert pii.pseudonymise(table.limit(0), "k").count() == 0
