"""The catalog's queries as SQL for another engine, to check results against.

Written for DuckDB on the same tables, and on purpose in other terms than the
operators: self-joins, ordered aggregates and window frames over whole groups.
"""

import datetime as dt

from hitprism.functions.text import EMOJI_CLASS
from hitprism.operators.counts import SETS
from hitprism.plans.catalog import CHOSEN, COMPETITOR, FIRST_DAY, LAST_DAY, YEAR
from hitprism.schema import FILTER_COLUMNS, HITS
from hitprism.sources.star import RANGES, hits_sql

NATIONS = [f"NATION_{i}" for i in range(25)]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
VERTICALS = ["Casino", "Sports", "Poker"]
CHANNELS = ["email", "sms", "calls", "push"]
EMAIL_TYPES = ["Informational", "Newsletter", "Promotional", "System", "Transactional", "Welcome"]
TONES = ["Formal", "Friendly", "Playful", "Urgent"]
PROMO_TYPES = ["Branding", "Cashback", "Deposit Bonus", "Free Chips", "Free Spins",
               "System Message", "Tournament"]
PROVIDERS = ["AS100 Alpha Mail", "AS200 Beta Post", "AS300 Gamma Send", "Unknown"]

_TEXTS = {"content", "translated_content"}
_PER_OFFER = {"type", "promotion_type", "promotion_types", "value", "play_value",
              "deposit_requirement"}
_ALL = [f.name for f in HITS.fields]


def _q(name):
    return f'"{name}"'


def _columns(skip=frozenset()):
    return ", ".join(_q(c) for c in _ALL if c not in skip)


# All columns, whole texts as digests.
_DIGESTED = ", ".join(f'md5("{c}") AS "{c}"' if c in _TEXTS else _q(c) for c in _ALL)


def _with(body, **parts):
    """A SELECT over the hits view; ``msgs`` has one row per message."""
    ctes = {"hits": hits_sql()}
    if "msgs" in body or any("msgs" in p for p in parts.values()):
        ctes["msgs"] = (
            f"SELECT DISTINCT ON (tracking_hit_id) {_columns(_TEXTS | _PER_OFFER)} "
            "FROM hits ORDER BY tracking_hit_id"
        )
    ctes.update(parts)
    text = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes.items())
    return f"WITH {text}\n{body}"


def _wide(tall, key, column, value, names, kind="BIGINT"):
    cells = ",\n".join(
        f"CAST(coalesce(sum(CASE WHEN {column} = '{n}' THEN {value} END), 0) AS {kind}) AS \"{n}\""
        for n in names
    )
    return f"SELECT {key},\n{cells}\nFROM ({tall}) AS tall GROUP BY {key}"


def _count(source, *keys):
    names = ", ".join(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT {names}, count(*) AS n FROM {source} WHERE {known} GROUP BY {names}"


def _even(x, digits):
    scale = 10**digits
    return f"round_even(({x}) * {scale}, 0) / {scale}"


def _clock(x):
    return f"printf('%02d:%02d:%02d', ({x}) // 3600, ({x}) % 3600 // 60, ({x}) % 60)"


def _second(ts="local_created_at"):
    return f"CAST(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}) AS BIGINT)"


_LABEL = "coalesce(type, 'No Promo') || ' - ' || coalesce(value, 'No Value')"
_SERVICE = "('Welcome', 'Informational', 'System', 'Transactional')"


def _kind(type_):
    return (
        f"CASE WHEN {type_} = 'No Promo' AND email_type = 'Promotional' THEN 'Branding' "
        f"WHEN {type_} = 'No Promo' AND email_type IN {_SERVICE} THEN 'System Message' "
        f"ELSE {type_} END"
    )


def _normal(type_):
    chips = rf"regexp_replace({type_}, '(?i)\bfree chip\b', 'Free Chips', 'g')"
    return rf"regexp_replace({chips}, '(?i)\bTournament Entry\b', 'Tournament', 'g')"


def _has(text, *words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_H = "lower(coalesce(holiday, ''))"
_T = "lower(coalesce(subject, '') || ' ' || coalesce(translated_content, ''))"
_SEASON_COLUMN = (
    f"WHEN {_has(_H, 'black')} AND {_has(_H, 'friday', 'week')} THEN 'Black Friday' "
    f"WHEN {_has(_H, 'christmas', 'advent', 'holiday season')} THEN 'Christmas' "
)
_HOLIDAY_TYPE = (
    f"CASE {_SEASON_COLUMN}"
    f"WHEN {_has(_T, 'black friday', 'cyber monday', 'thanksgiving')} THEN 'Black Friday' "
    f"WHEN {_has(_T, 'christmas', 'xmas')} THEN 'Christmas' "
    f"WHEN {_has(_T, '🎄', '🎅', '❄', '⛄', '🧦')} THEN 'Christmas' "
    f"WHEN {_has(_T, '🦃')} THEN 'Black Friday' ELSE NULL END"
)
_HOLIDAY_LABEL = (
    f"CASE {_SEASON_COLUMN}WHEN holiday <> '' THEN holiday "
    f"WHEN {_has(_T, 'black friday', 'blackfriday', 'cyber monday', 'thanksgiving')} "
    f"THEN 'Black Friday' WHEN {_has(_T, 'christmas', 'xmas')} THEN 'Christmas' ELSE '' END"
)
_OFFER_TEXT = (
    "CASE WHEN coalesce(type, '') <> '' AND coalesce(nullif(value, ''), play_value, '') <> '' "
    "THEN type || ': ' || coalesce(nullif(value, ''), play_value) "
    "WHEN coalesce(nullif(value, ''), play_value, '') <> '' "
    "THEN coalesce(nullif(value, ''), play_value) "
    "WHEN coalesce(type, '') <> '' THEN type ELSE NULL END"
)
_DOMAIN = r"""nullif(regexp_extract(lower("from"), '[\w.-]+@([\w.-]+)', 1), '')"""

_DAY_MICROS = 86400000000


def _days(start, end):
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / {_DAY_MICROS}.0) AS BIGINT)"


def _period(bound, days, keep):
    return _with(
        f"SELECT {_DIGESTED}, days_since FROM (SELECT *, {days} AS days_since FROM "
        f"(SELECT *, {bound} OVER (PARTITION BY tracking_id) AS edge FROM hits "
        f"WHERE tracking_id IS NOT NULL) AS a) AS b WHERE {keep}"
    )


def _velocity(days=30):
    return (
        "SELECT competitor_name, tracking_id, lifecycle, count(*) AS volume, "
        "strftime(min(local_created_at), '%d-%b-%Y') AS min_date_str, "
        "strftime(max(local_created_at), '%d-%b-%Y') AS max_date_str, "
        "CAST(date_diff('day', CAST(min(local_created_at) AS DATE), "
        "CAST(max(local_created_at) AS DATE)) + 1 AS BIGINT) AS active_period, "
        + _even(f"CAST(count(*) * 7 AS DOUBLE) / {days}", 2)
        + " AS weekly_velocity FROM msgs GROUP BY competitor_name, tracking_id, lifecycle"
    )


_GRID = (
    "SELECT CAST(d.range AS BIGINT) AS day_no, CAST(h.range AS BIGINT) AS hour "
    "FROM range(7) AS d, range(24) AS h"
)
_CELLS = (
    "SELECT competitor_name, CAST(isodow(local_created_at) - 1 AS BIGINT) AS day_no, "
    "CAST(hour(local_created_at) AS BIGINT) AS hour FROM msgs"
)
_HEAT = (
    "SELECT grid.day_no, grid.hour, count(cells.day_no) AS n FROM grid "
    "LEFT JOIN cells ON cells.day_no = grid.day_no AND cells.hour = grid.hour "
    "GROUP BY grid.day_no, grid.hour"
)
_DAY_NAME = "dayname(DATE '2024-01-01' + CAST(day_no AS INT))"


def _shares(source, column):
    pct = _even("CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY competitor_name) * 100", 1)
    return f"SELECT *, {pct} AS pct FROM ({_count(source, 'competitor_name', column)}) AS c"


def _ranked(source, column):
    return (
        f"SELECT s.competitor_name, s.{column}, s.n, s.pct, r.column_rank "
        f"FROM ({_shares(source, column)}) AS s JOIN (SELECT {column}, "
        f"row_number() OVER (ORDER BY sum(CAST(pct AS DECIMAL(28,1))) DESC, {column}) "
        f"AS column_rank FROM ({_shares(source, column)}) AS t GROUP BY {column}) AS r "
        f"ON r.{column} = s.{column}"
    )


_PROMO_ROWS = (
    f"SELECT competitor_name, {_kind('given')} AS type FROM (SELECT competitor_name, email_type, "
    + _normal("coalesce(type, 'No Promo')")
    + " AS given FROM hits WHERE email_type IN ('Promotional', 'Welcome', 'Informational', 'System', "
    "'Transactional')) AS k"
)

_PAIR_COUNTS = (
    "SELECT competitor_name, from_ip, count(*) AS n FROM msgs "
    "WHERE competitor_name IS NOT NULL GROUP BY competitor_name, from_ip"
)
_IP_DIM = (
    "SELECT DISTINCT from_ip, CASE split_part(from_ip, '.', 4) "
    "WHEN '0' THEN 'AS100 Alpha Mail' WHEN '1' THEN 'AS100 Alpha Mail' "
    "WHEN '2' THEN 'AS100 Alpha Mail' WHEN '3' THEN 'AS200 Beta Post' "
    "WHEN '4' THEN 'AS200 Beta Post' WHEN '5' THEN 'AS300 Gamma Send' END AS org "
    "FROM hits WHERE from_ip IS NOT NULL"
)
_PROVIDERS = (
    "SELECT competitor_name, coalesce(org, 'Unknown') AS provider, "
    "count(DISTINCT hits.from_ip) AS n_ips FROM hits JOIN ip_dim ON ip_dim.from_ip = hits.from_ip "
    "WHERE competitor_name IS NOT NULL GROUP BY 1, 2"
)
_IP_NUMBER = " + ".join(
    f"CAST(split_part({{0}}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
_NETWORKS = (
    "SELECT DISTINCT concat('10.0.', split_part(from_ip, '.', 3), '.0') AS network, 24 AS prefix, "
    "'AS400 Delta Net' AS org FROM hits WHERE from_ip IS NOT NULL AND split_part(from_ip, '.', 3) <> '3' "
    "UNION ALL SELECT from_ip, CASE WHEN org LIKE 'AS100%' THEN 31 ELSE 32 END, org FROM ip_dim "
    "WHERE split_part(from_ip, '.', 4) IN ('0', '5')"
)
_CIDR_PROVIDERS = (
    "SELECT competitor_name, coalesce(org, 'Unknown') AS provider, count(DISTINCT from_ip) AS n_ips FROM ("
    "SELECT DISTINCT ON (competitor_name, from_ip) competitor_name, from_ip, org "
    "FROM (SELECT DISTINCT competitor_name, from_ip FROM hits "
    "WHERE competitor_name IS NOT NULL AND from_ip IS NOT NULL) AS p "
    f"LEFT JOIN networks ON ({_IP_NUMBER.format('from_ip')}) // CAST(pow(2, 32 - prefix) AS BIGINT) "
    f"= ({_IP_NUMBER.format('network')}) // CAST(pow(2, 32 - prefix) AS BIGINT) "
    "ORDER BY competitor_name, from_ip, prefix DESC NULLS LAST) AS longest GROUP BY 1, 2"
)
_RANGES = " UNION ALL ".join(
    f"SELECT DISTINCT {family} AS family, ({a}) * 1000 + {b} AS low, ({c}) * 1000 + {d} AS high, '{org}' AS org "
    f"FROM senders WHERE {where}" for family, a, b, c, d, org, where in RANGES)
_SENDERS = (
    "SELECT DISTINCT competitor_name, CASE WHEN tracking_id % 3 = 0 THEN 6 ELSE 4 END AS family, "
    "CAST(split_part(from_ip, '.', 3) AS INT) AS a, CAST(split_part(from_ip, '.', 4) AS INT) AS b "
    "FROM hits WHERE from_ip IS NOT NULL"
)
_RANGE_PROVIDERS = (
    "SELECT competitor_name, coalesce(org, 'Unknown') AS provider, count(*) AS n_ips FROM ("
    "SELECT DISTINCT ON (competitor_name, s.family, a, b) competitor_name, org FROM senders AS s "
    "LEFT JOIN ranges AS r ON r.family = s.family AND a * 1000 + b BETWEEN low AND high "
    "WHERE competitor_name IS NOT NULL "
    "ORDER BY competitor_name, s.family, a, b, low DESC NULLS LAST, high, org) AS chosen GROUP BY 1, 2"
)


def _cascade(chosen):
    """The values at each filter by filtering step by step."""
    parts, fits = [], ["true"]
    for i, c in enumerate(FILTER_COLUMNS):
        parts.append(f"SELECT DISTINCT CAST({i} AS INT) AS position, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value "
                     f"FROM hits WHERE {c} IS NOT NULL AND {' AND '.join(fits)}")
        if chosen.get(c):
            fits.append(f"{c} IN ({', '.join(repr(v) for v in chosen[c])})")
    return " UNION ALL ".join(parts)


def _counted():
    columns = list(dict.fromkeys(c for names in SETS.values() for c in names))
    days = ("created_at", "local_created_at")
    own = {c: f"CAST(CAST({c} AS DATE) AS VARCHAR)" if c in days else c for c in columns}
    return " UNION ALL ".join(
        "SELECT " + ", ".join(f"{own[c] if c in names else 'CAST(NULL AS VARCHAR)'} AS {c}" for c in columns)
        + f", count(*) AS n_rows, '{part}' AS part FROM hits GROUP BY ALL" for part, names in SETS.items())


_EARLY = "epoch_us(local_created_at) - epoch_us(tracking_start_at) <= 172800000000"


def _first48(source, *keys):
    return _with(
        f"SELECT {', '.join(keys)}, count(*) AS n FROM {source} "
        f"WHERE {_EARLY} AND competitor_name IS NOT NULL GROUP BY {', '.join(keys)}"
    )


def _emoji_of(column):
    return f"regexp_extract_all({column}, '[{EMOJI_CLASS}]')"


_TEXT_MSGS = (
    "SELECT tracking_hit_id, any_value(competitor_name) AS competitor_name, "
    "any_value(subject) AS subject, any_value(content) AS content FROM hits GROUP BY 1"
)


def _used_pct(column):
    used = f"count(*) FILTER (WHERE len({_emoji_of(column)}) > 0)"
    share = _even(f"CAST({used} AS DOUBLE) / nullif(count({column}), 0) * 100", 2)
    return f"coalesce({share}, 0.0)"


_OFFERS = f"SELECT *, {_LABEL} AS offer_label FROM hits"
_REAL_OFFERS = (
    f"SELECT competitor_name, {_LABEL} AS offer_label, count(*) AS n FROM hits "
    "WHERE type IS NOT NULL AND type NOT IN ('No Promo', 'No Promo - No Values') "
    "AND competitor_name IS NOT NULL GROUP BY 1, 2"
)
_TYPED_OFFERS = (
    f"SELECT coalesce(type, 'No Promo') AS type, {_LABEL} AS offer_label, competitor_name, "
    "count(*) AS n FROM hits WHERE competitor_name IS NOT NULL GROUP BY 1, 2, 3"
)


def _mix(scope, sets, level, source="offers", where="true"):
    return _with(
        f"SELECT {scope} AS scope_value, competitor_name, offer_label, count(*) AS n, "
        f"{level} AS level FROM {source} WHERE {where} GROUP BY GROUPING SETS ({sets})",
        offers=_OFFERS,
    )


_LEVEL = (
    "CASE WHEN grouping(offer_label) = 0 THEN 'offer_label' "
    "WHEN grouping(competitor_name) = 0 THEN 'competitor_name' ELSE 'all' END"
)

_PER_HIT = (
    "SELECT tracking_hit_id, count(*) AS bundle_size, "
    "string_agg(offer_label, ' | ' ORDER BY offer_label) AS label FROM "
    f"(SELECT DISTINCT tracking_hit_id, {_LABEL} AS offer_label FROM hits) AS o GROUP BY 1"
)
_BUNDLE_ROWS = (
    "SELECT tracking_hit_id, CASE WHEN length(label) > 180 THEN substring(label, 1, 180) || '…' "
    "ELSE label END AS bundle_label, bundle_size FROM per_hit WHERE bundle_size >= 2"
)
_BUNDLES = "SELECT bundle_label, bundle_size, count(*) AS n FROM rows_ GROUP BY 1, 2"


def _bundled(body):
    return _with(body, per_hit=_PER_HIT, rows_=_BUNDLE_ROWS, bundles=_BUNDLES)


_MODES = (
    "SELECT competitor_name, promotion_type, value, play_value, n FROM (SELECT *, "
    "rank() OVER (PARTITION BY competitor_name, promotion_type, value ORDER BY n DESC) AS place "
    "FROM (SELECT competitor_name, promotion_type, value, play_value, count(*) AS n FROM hits "
    "WHERE promotion_type = 'Free Spins' AND competitor_name IS NOT NULL AND value IS NOT NULL "
    "AND play_value IS NOT NULL GROUP BY 1, 2, 3, 4) AS c) AS r "
    "WHERE place = 1 AND play_value <> ''"
)
_SEASONAL = (
    f"SELECT {_columns(_TEXTS)}, {_HOLIDAY_TYPE} AS holiday_type, "
    f"{_OFFER_TEXT} AS offer_text FROM hits "
    "WHERE competitor_name IS NOT NULL"
)
_ACTIVITY = (
    "SELECT c.competitor_name, s.holiday_type, count(DISTINCT x.tracking_hit_id) AS n FROM "
    "(SELECT DISTINCT competitor_name FROM seasonal WHERE holiday_type IS NOT NULL) AS c "
    "CROSS JOIN (VALUES ('Black Friday'), ('Christmas')) AS s(holiday_type) "
    "LEFT JOIN seasonal AS x ON x.competitor_name = c.competitor_name "
    "AND x.holiday_type = s.holiday_type GROUP BY 1, 2"
)


def _joined(x, where):
    return f"coalesce(string_agg(DISTINCT {x}, ', ' ORDER BY {x}) FILTER (WHERE {where}), '')"


def _promos(where="true"):
    return _with(
        "SELECT competitor_name, tracking_hit_id, label AS holiday, "
        "strftime(min(local_created_at), '%d-%B-%Y') AS date, "
        "arg_min(subject, (local_created_at, subject)) FILTER (WHERE subject IS NOT NULL) "
        "AS subject, "
        + _joined("v", "v <> ''") + " AS offer, "
        + _joined("play_value", "play_value IS NOT NULL") + " AS wager, "
        + _joined("deposit_requirement", "deposit_requirement IS NOT NULL") + " AS requirements "
        f"FROM (SELECT {_columns(_TEXTS)}, {_HOLIDAY_LABEL} AS label, coalesce(value, 'No Value') AS v FROM hits "
        f"WHERE competitor_name IS NOT NULL) AS h WHERE label IN ('Black Friday', 'Christmas') "
        f"AND {where} GROUP BY 1, 2, 3"
    )


_TIMELINE = (
    "SELECT competitor_name, created_at, CASE WHEN competitor_name IS NOT NULL THEN "
    "CAST(date_diff('day', CAST(min(created_at) OVER (PARTITION BY competitor_name) AS DATE), "
    "CAST(created_at AS DATE)) AS BIGINT) END AS day_offset, "
    + _kind("coalesce(type, 'No Promo')") + f" AS type, subject, {_HOLIDAY_LABEL} AS holiday FROM hits"
)
_TIMELINE_COLUMNS = (
    "competitor_name, created_at, CAST(day_offset AS DOUBLE) AS day_offset, "
    "'Day ' || CAST(day_offset AS VARCHAR) AS day_label, "
    "type, subject"
)


def _leader(metric, column):
    return (
        f"(SELECT '{metric}' AS metric, CAST({column} AS VARCHAR) AS value, count(*) AS n FROM hits "
        f"WHERE {column} IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"
    )


_LEADERS = " UNION ALL ".join(
    [_leader("promotion", "promotion_types"),
     _leader("day", "CAST(local_created_at AS DATE)"),
     _leader("category", "category")]
)
_NAMES = "string_agg(DISTINCT competitor_name, ', ' ORDER BY competitor_name)"
_VERTICALS = (
    f"SELECT vertical, count(DISTINCT competitor_name) AS competitors, {_NAMES} AS names, "
    "count(*) AS n FROM hits WHERE vertical IS NOT NULL GROUP BY vertical"
)


def _line(section, block, source, *texts, key="''"):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {block} AS block, {key} AS key, {i} AS pos, "
        f"{text} AS text FROM {source}"
        for i, text in enumerate(texts)
    )


_LINES = " UNION ALL ".join([
    _line("summary", 1, "one", "'Total messages tracked: **' || rows_ || '**'"),
    _line("summary", 2, "one", "'Total number of competitors: **' || competitors || '**'"),
    _line("summary", 3, "one", "'Competitors: **' || names || '**'"),
    _line("summary", 4, "verticals",
          "'Total number of ' || vertical || ' competitors: **' || competitors || '**'",
          "vertical || ' Competitors: **' || names || '**'",
          "'Total messages in ' || vertical || ': **' || n || '**'", key="vertical"),
    _line("summary", 5, "promo",
          "'Most common promotion type: **' || value || '** (' || n || ' times)'"),
    _line("summary", 6, "day", "'Peak activity day: **' || value || '** with ' || n || ' messages'"),
    _line("summary", 7, "cat", "'Most common content category: **' || value || '**'"),
    _line("summary", 8, "single", "'All messages are classified as: **' || classification || '**'"),
    _line("recommendation", 1, "promo",
          "'Consider emphasizing `' || value || '` in your upcoming campaigns based on volume.'"),
    _line("recommendation", 2, "day",
          "'Evaluate the content and timing on ' || value || "
          "' to understand what drove high engagement.'"),
    _line("recommendation", 3, "cat",
          "'Ensure variety in content strategy if one category like `' || value || '` dominates.'"),
    _line("recommendation", 4, "single",
          "'Review classification criteria to ensure it''s capturing message diversity.'"),
])


def oracle_sql():
    velocity_table = _with("SELECT * FROM velocity", velocity=_velocity())
    labelled = "SELECT *, '{}' || active_period || ' days' AS period FROM velocity"
    cross_keys = ["competitor_name", "vertical", "lifecycle", "channel"]
    cross_label = "vertical || ' | ' || lifecycle || ' | ' || channel"
    cross_names = [f"{v} | {s} | {c}" for v in VERTICALS for s in SEGMENTS for c in CHANNELS]
    per_ip = _count("msgs", "from_ip", "competitor_name")
    domains = f"SELECT *, {_DOMAIN} AS from_domain FROM msgs"
    per_domain = _count("domains", "from_domain", "competitor_name")
    heat = {"grid": _GRID, "cells": _CELLS, "heat": _HEAT}
    seasonal = {"seasonal": _SEASONAL}
    after = LAST_DAY + dt.timedelta(days=1)
    return {
        "S1": _with(f"SELECT {_DIGESTED} FROM hits"),
        "S2": _with("SELECT tracking_hit_id, play_value, created_at FROM hits"),
        "S3": _with("SELECT tracking_hit_id, play_value, CASE WHEN play_value = '' THEN NULL "
                    "ELSE created_at END AS created_at FROM hits"),
        "S1_rejects": _with(
            "SELECT channel, count(*) AS n, 'clean' AS kind FROM hits WHERE category <> '1-URGENT' GROUP BY 1 "
            "UNION ALL SELECT channel, count(*), 'null' FROM hits WHERE category = '1-URGENT' GROUP BY 1 "
            "UNION ALL SELECT NULL, count(*), 'rejected' FROM hits WHERE category = '1-URGENT'"),
        "S4": _with(_count("msgs", "competitor_name")),
        "F1": _with(f"SELECT {_DIGESTED} FROM hits WHERE country IN ('ASIA', 'EUROPE') "
                    "AND channel IN ('email', 'sms')"),
        "F2": _with(f"SELECT {_DIGESTED} FROM hits WHERE local_created_at >= DATE '{FIRST_DAY}' "
                    f"AND local_created_at < DATE '{after}'"),
        "F3": _with("SELECT DISTINCT competitor_name AS value FROM hits "
                    "WHERE competitor_name IS NOT NULL"),
        "F3_accounts": _with("SELECT DISTINCT tracking_id AS value FROM hits "
                             "WHERE tracking_id IS NOT NULL"),
        "F3_cascade": _with(_cascade(CHOSEN)),
        "F4": _with("SELECT min(local_created_at) AS min_ts, max(local_created_at) AS max_ts "
                    "FROM hits"),
        "F5": _with(f"SELECT {_DIGESTED} FROM hits WHERE year(local_created_at) = {YEAR}"),
        "P1": _period("min(local_created_at)", _days("edge", "local_created_at"),
                      "days_since <= 364"),
        "P2": _period("max(created_at)", _days("created_at", "edge"), "days_since < 365"),
        "P3": _with(f"SELECT {_DIGESTED}, (epoch_us(local_created_at) - "
                    "epoch_us(tracking_start_at)) / 3600000000.0::DOUBLE AS hours_since "
                    f"FROM hits WHERE {_EARLY}"),
        "D1": _with(f"SELECT {_DIGESTED} FROM (SELECT DISTINCT ON (tracking_hit_id) * FROM hits "
                    "ORDER BY tracking_hit_id, type NULLS LAST, value NULLS LAST, "
                    "play_value NULLS LAST, deposit_requirement NULLS LAST) AS d"),
        "D2": _with(
            "SELECT "
            + ", ".join(
                {"type": "coalesce(type, 'No Promo') AS type",
                 "value": "coalesce(value, 'No Value') AS value"}.get(
                    c, f'md5("{c}") AS "{c}"' if c in _TEXTS else _q(c))
                for c in _ALL
            )
            + f", {_LABEL} AS offer_label, TRY_CAST(regexp_extract(value, "
            r"'(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS numeric_value, "
            "CAST(CAST(local_created_at AS DATE) AS VARCHAR) AS date, "
            "strftime(local_created_at, '%Y-%m') AS month FROM hits"
        ),
        "D3": _with("SELECT tracking_hit_id, email_type, type AS given_type, "
                    + _kind("coalesce(type, 'No Promo')") + " AS type FROM hits"),
        "D4": _with("SELECT tracking_hit_id, given_type, " + _normal("given_type")
                    + " AS type FROM (SELECT tracking_hit_id, coalesce(type, 'No Promo') "
                    "AS given_type FROM hits) AS g"),
        "D5": _with(f'SELECT tracking_hit_id, "from", {_DOMAIN} AS from_domain FROM hits'),
        "D6a": _with(f"SELECT tracking_hit_id, holiday, {_HOLIDAY_TYPE} AS holiday_type FROM hits"),
        "D6b": _with(f"SELECT tracking_hit_id, {_HOLIDAY_LABEL} AS holiday FROM hits"),
        "D7": _with("SELECT tracking_hit_id, type, value, play_value, "
                    f"{_OFFER_TEXT} AS offer_text FROM hits"),
        "D8": _with("SELECT tracking_hit_id, " + ", ".join(
            f"array_to_string({_emoji_of(c)}, '') AS {c}_emoji, "
            f"coalesce(len({_emoji_of(c)}) > 0, false) AS {c}_has_emoji"
            for c in ("subject", "content")) + " FROM hits"),
        "D9": _with("SELECT tracking_hit_id, dayname(local_created_at) AS day_of_week, "
                    "hour(local_created_at) AS hour, day(local_created_at) AS day, "
                    "month(local_created_at) AS month FROM hits"),
        "D10": _with(
            "SELECT competitor_name, offer_label, count(tracking_hit_id) AS instances, "
            "coalesce(substring(string_agg(DISTINCT subject, '; ' ORDER BY subject), 1, 2000), '') "
            "AS subjects FROM offers GROUP BY competitor_name, offer_label", offers=_OFFERS),
        "R1": _with(
            "SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE c END AS competitor_name, "
            "CASE WHEN g = 1 THEN 'ALL' ELSE k END AS country, n, g = 1 AS is_total FROM "
            "(SELECT competitor_name AS c, country AS k, count(*) AS n, grouping(country) AS g "
            "FROM msgs WHERE competitor_name IS NOT NULL AND country IS NOT NULL "
            "GROUP BY GROUPING SETS ((competitor_name, country), ())) AS t"),
        "R2": _with(_count("msgs", "competitor_name")),
        "R3": velocity_table,
        "R4": _with(labelled.format("First "), velocity=_velocity()),
        "R4_all_time": _with(labelled.format("Since Creation - "), velocity=_velocity(7)),
        "R5": _with(
            "SELECT slice_name, CAST(v AS DOUBLE) AS weekly_velocity, "
            "CAST(v AS DOUBLE) / CAST((SELECT sum(v) FROM slices) AS DOUBLE) AS share FROM slices",
            velocity=_velocity(),
            slices="SELECT tracking_id || ' — ' || coalesce(competitor_name, '') AS slice_name, "
                   "sum(CAST(weekly_velocity AS DECIMAL(28,2))) AS v FROM velocity "
                   "WHERE weekly_velocity > 0 GROUP BY 1"),
        "R6": _with(
            "SELECT row_number() OVER (ORDER BY active_period DESC, weekly_velocity DESC, "
            "competitor_name NULLS LAST, tracking_id NULLS LAST, lifecycle NULLS LAST) - 1 AS idx, "
            "* FROM velocity", velocity=_velocity()),
        "R7": _with(_count("msgs", *cross_keys)),
        "R7_wide": _with(
            _wide(f"SELECT competitor_name, {cross_label} AS label, n FROM tall_",
                  "competitor_name", "label", "n", cross_names),
            tall_=_count("msgs", *cross_keys)),
        "R8": _with("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS n "
                    "FROM hits GROUP BY 1"),
        "R9": _with(
            "SELECT competitor_name, channel, n, CAST(sum(n) OVER (PARTITION BY competitor_name) AS BIGINT) AS total, "
            "CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY competitor_name) * 100 AS pct FROM (SELECT competitor_name, "
            "channel, count(*) AS n FROM hits WHERE competitor_name IS NOT NULL GROUP BY 1, 2) AS c"),
        "R9_wide": _with(
            "SELECT *, " + ", ".join(f"CAST({c} AS DOUBLE) / total * 100 AS {c}_pct" for c in ("email", "sms", "calls", "other"))
            + " FROM (SELECT competitor_name, count(*) FILTER (WHERE channel = 'email') AS email, "
            "count(*) FILTER (WHERE channel = 'sms') AS sms, count(*) FILTER (WHERE channel = 'calls') AS calls, "
            "count(*) FILTER (WHERE channel = 'push') AS other, count(*) AS total "
            "FROM hits WHERE competitor_name IS NOT NULL GROUP BY 1) AS c"),
        "F1_long": _with(f"SELECT {_DIGESTED} FROM hits WHERE tracking_id BETWEEN 1 AND 1200"),
        "R10": _with(_count("hits", "promotion_types")),
        "R11": _with(_count("hits", "promotion_types", "category")),
        "R12": _with(_count("hits", "classification")),
        "R13": _with(_count("hits", "channel_type")),
        "R8_R53_counts": _with(_counted()),
        "R14": _with(f"SELECT {_DAY_NAME} AS day_of_week, hour, n FROM heat", **heat),
        "R14_wide": _with(
            _wide(f"SELECT {_DAY_NAME} AS day_of_week, CAST(hour AS VARCHAR) AS h, n FROM heat",
                  "day_of_week", "h", "n", [str(h) for h in range(24)]), **heat),
        "R15": _with(
            f"SELECT day_no, {_DAY_NAME} AS day_of_week, start - 1 AS opp1, start + 3 AS opp2 FROM "
            "(SELECT a.day_no, a.hour AS start, row_number() OVER (PARTITION BY a.day_no "
            "ORDER BY sum(b.n) DESC, a.hour DESC) AS place FROM heat AS a JOIN heat AS b "
            "ON b.day_no = a.day_no AND b.hour BETWEEN a.hour AND a.hour + 2 "
            "WHERE a.hour <= 17 GROUP BY a.day_no, a.hour) AS w WHERE place = 1", **heat),
        "R16": _with(
            "SELECT x.name AS excluded_competitor, "
            f"{_DAY_NAME.replace('day_no', 'grid.day_no')} AS day_of_week, grid.hour, "
            "(SELECT count(*) FROM cells WHERE cells.day_no = grid.day_no "
            "AND cells.hour = grid.hour) - coalesce(own.n, 0) AS n "
            "FROM (SELECT DISTINCT competitor_name AS name FROM cells "
            "WHERE competitor_name IS NOT NULL UNION ALL SELECT NULL) AS x CROSS JOIN grid "
            "LEFT JOIN (SELECT competitor_name, day_no, hour, count(*) AS n FROM cells "
            "GROUP BY 1, 2, 3) AS own ON own.competitor_name = x.name "
            "AND own.day_no = grid.day_no AND own.hour = grid.hour",
            grid=_GRID, cells=_CELLS),
        "R17": _with(
            "SELECT CAST(d AS VARCHAR) AS date, month(d) AS month, "
            "(isodow(date_trunc('month', d)) - 1 + day(d) - 1) // 7 AS week_row, "
            "isodow(d) - 1 AS weekday_col, count(sent.day) AS n FROM (SELECT CAST(range AS DATE) "
            f"AS d FROM range(TIMESTAMP '{YEAR}-01-01', TIMESTAMP '{YEAR + 1}-01-01', "
            "INTERVAL 1 DAY)) AS days LEFT JOIN sent ON sent.day = d "
            "WHERE month(d) IN (SELECT month(day) FROM sent) GROUP BY d",
            sent="SELECT CAST(local_created_at AS DATE) AS day FROM msgs "
                 f"WHERE year(local_created_at) = {YEAR}"),
        "R18": _with(
            "SELECT CAST(day AS VARCHAR) AS date, competitor_name, n, "
            "CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_total, "
            "CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day) AS share FROM "
            "(SELECT CAST(local_created_at AS DATE) AS day, competitor_name, count(*) AS n "
            f"FROM msgs WHERE year(local_created_at) = {YEAR} AND competitor_name IS NOT NULL "
            "GROUP BY 1, 2) AS c"),
        "R18_by_channel": _with(
            "SELECT CAST(day AS VARCHAR) AS date, channel, n, "
            "CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_total, "
            "CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day) AS share FROM "
            "(SELECT CAST(local_created_at AS DATE) AS day, channel, count(*) AS n "
            f"FROM msgs WHERE year(local_created_at) = {YEAR} AND channel IS NOT NULL "
            "GROUP BY 1, 2) AS c"),
        "R19": _with(
            f"SELECT t.tracking_id, t.competitor_name, {_clock('t.med')} AS median_time, "
            f"{_clock('t.avg_')} AS mean_time, b.competitor_rows FROM "
            f"(SELECT tracking_id, competitor_name, CAST(floor(median({_second()})) AS BIGINT) "
            f"AS med, CAST(floor(avg({_second()})) AS BIGINT) AS avg_ FROM hits "
            "WHERE competitor_name IS NOT NULL AND tracking_id IS NOT NULL GROUP BY 1, 2) AS t "
            "JOIN (SELECT competitor_name, count(*) AS competitor_rows FROM hits GROUP BY 1) AS b "
            "ON b.competitor_name = t.competitor_name"),
        "R19_rows": _with(
            f"SELECT competitor_name, tracking_id, {_clock(_second())} AS time, "
            f"CAST({_second()} AS DOUBLE) / 60 AS minutes FROM hits"),
        "R20": _with(
            "SELECT rank, rank || '. ' || competitor_name AS label, competitor_name, n, "
            + ", ".join(f"q[{i}] / 60 AS {name}"
                        for i, name in enumerate(["min", "q1", "median", "q3", "max"], 1))
            + " FROM (SELECT *, row_number() OVER (ORDER BY n DESC, competitor_name) AS rank FROM "
            "(SELECT competitor_name, count(*) AS n, "
            f"quantile_cont(CAST({_second()} AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q "
            "FROM hits WHERE competitor_name IS NOT NULL GROUP BY 1) AS b) AS r"),
        "R21": _with(
            "SELECT competitor_name, tracking_id, from_domain, count(*) AS n, "
            "strftime(min(local_created_at), '%d-%b-%Y') AS first_seen, "
            "strftime(max(local_created_at), '%d-%b-%Y') AS last_seen FROM domains "
            "WHERE competitor_name IS NOT NULL AND from_domain IS NOT NULL GROUP BY 1, 2, 3",
            domains=domains),
        "R22": _with(per_domain, domains=domains),
        "R22_wide": _with(_wide(per_domain, "from_domain", "competitor_name", "n", NATIONS),
                          domains=domains),
        "R23": _with(
            "SELECT competitor_name, from_ip, count(*) AS n, min(created_at) AS first_seen, "
            'max(created_at) AS last_seen, count(DISTINCT "to") AS unique_to FROM msgs '
            "WHERE competitor_name IS NOT NULL AND from_ip IS NOT NULL GROUP BY 1, 2"),
        "R24": _with(per_ip),
        "R24_wide": _with(_wide(per_ip, "from_ip", "competitor_name", "n", NATIONS)),
        "R25": _with(
            "SELECT *, total_ips - high_volume_ips AS other_ips FROM (SELECT competitor_name, "
            "count(from_ip) AS total_ips, count(*) FILTER (WHERE n >= 20) AS high_volume_ips "
            "FROM per_ip GROUP BY 1) AS t WHERE total_ips >= 1", per_ip=_PAIR_COUNTS),
        "R26": _with(_PROVIDERS, ip_dim=_IP_DIM),
        "R26_wide": _with(_wide(_PROVIDERS, "competitor_name", "provider", "n_ips", PROVIDERS),
                          ip_dim=_IP_DIM),
        "R26_cidr": _with(_CIDR_PROVIDERS, ip_dim=_IP_DIM, networks=_NETWORKS),
        "R26_ranges": _with(_RANGE_PROVIDERS, senders=_SENDERS, ranges=_RANGES),
        "R27": _with(
            "SELECT competitor_name, string_agg(provider, '; ' ORDER BY provider) AS providers "
            f"FROM ({_PROVIDERS}) AS p GROUP BY 1", ip_dim=_IP_DIM),
        "R28": _with(
            "SELECT *, CASE WHEN avg_subject_length < 24 THEN 'red' "
            "WHEN avg_subject_length < 30 THEN 'yellow' WHEN avg_subject_length <= 36 THEN 'green' "
            "WHEN avg_subject_length <= 42 THEN 'yellow' ELSE 'red' END AS band FROM "
            "(SELECT competitor_name, "
            + _even(r"avg(length(regexp_replace(subject, '^\s+|\s+$', '', 'g')))", 2)
            + " AS avg_subject_length FROM msgs WHERE subject IS NOT NULL "
            "AND competitor_name IS NOT NULL GROUP BY 1) AS s"),
        "R29": _with(_shares("msgs", "email_type")),
        "R29_wide": _with(_wide(_shares("msgs", "email_type"), "competitor_name", "email_type",
                                "pct", EMAIL_TYPES, "DOUBLE")),
        "R30": _with(_ranked("promo", "type"), promo=_PROMO_ROWS),
        "R30_wide": _with(_wide(_shares("promo", "type"), "competitor_name", "type", "pct",
                                PROMO_TYPES, "DOUBLE"), promo=_PROMO_ROWS),
        "R31": _with(_ranked("msgs", "tone_of_voice")),
        "R31_wide": _with(_wide(_shares("msgs", "tone_of_voice"), "competitor_name",
                                "tone_of_voice", "pct", TONES, "DOUBLE")),
        "R32": _with(
            "SELECT t.*, coalesce(e.top_emojis, '') AS top_emojis FROM (SELECT competitor_name, "
            f"count(*) AS total, {_used_pct('subject')} AS subject_pct, "
            f"{_used_pct('content')} AS content_pct FROM texts WHERE competitor_name IS NOT NULL "
            "GROUP BY 1) AS t LEFT JOIN (SELECT competitor_name, "
            "string_agg(emoji || ' (' || n || ')', ', ' ORDER BY n DESC, emoji) AS top_emojis FROM "
            "(SELECT *, row_number() OVER (PARTITION BY competitor_name ORDER BY n DESC, emoji) "
            "AS place FROM (SELECT competitor_name, emoji, count(*) AS n FROM "
            f"(SELECT competitor_name, unnest({_emoji_of('subject')}) AS emoji FROM texts UNION ALL "
            f"SELECT competitor_name, unnest({_emoji_of('content')}) AS emoji FROM texts) AS u "
            "GROUP BY 1, 2) AS c) AS p WHERE place <= 5 GROUP BY 1) AS e "
            "ON e.competitor_name = t.competitor_name", texts=_TEXT_MSGS),
        "R33": _with(f"SELECT {_TIMELINE_COLUMNS} FROM ({_TIMELINE}) AS t"),
        "R34": _first48("msgs", "competitor_name"),
        "R35": _first48("(SELECT * REPLACE (coalesce(email_type, 'Informational') AS email_type) "
                        "FROM msgs) AS m", "competitor_name", "email_type"),
        "R36": _first48(
            "(SELECT DISTINCT ON (tracking_hit_id) competitor_name, local_created_at, "
            "tracking_start_at, coalesce(type, 'No Promo') AS type FROM hits "
            "ORDER BY tracking_hit_id, hits.type NULLS LAST) AS m", "competitor_name", "type"),
        "R37": _with(
            "SELECT offer_rank, r.offer_label, competitor_name, n FROM real JOIN "
            "(SELECT offer_label, row_number() OVER (ORDER BY sum(n) DESC, count(*) DESC, "
            "offer_label) AS offer_rank FROM real GROUP BY 1) AS r "
            "ON r.offer_label = real.offer_label WHERE offer_rank <= 30", real=_REAL_OFFERS),
        "R38": _with(
            "SELECT b.offer_rank, b.type, b.offer_label, b.total, o.competitor_name, o.n FROM "
            "typed AS o JOIN (SELECT *, row_number() OVER (ORDER BY type, total DESC, offer_label) "
            "AS offer_rank FROM (SELECT type, offer_label, CAST(sum(n) AS BIGINT) AS total "
            "FROM typed GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30) AS t) AS b "
            "ON b.type = o.type AND b.offer_label = o.offer_label", typed=_TYPED_OFFERS),
        "R39": _mix("'overall'", "(competitor_name, offer_label), (competitor_name), ()", _LEVEL),
        "R39_per_lifecycle": _mix(
            "lifecycle", "(lifecycle, competitor_name, offer_label), (lifecycle, competitor_name), "
            "(lifecycle)", _LEVEL, where="lifecycle IS NOT NULL"),
        "R39_per_competitor": _mix(
            "competitor_name", "(competitor_name, offer_label), (competitor_name)",
            "CASE WHEN grouping(offer_label) = 0 THEN 'offer_label' ELSE 'all' END",
            where="competitor_name IS NOT NULL"),
        "R40": _with(
            "SELECT a.offer_label AS offer_a, b.offer_label AS offer_b, count(*) AS n "
            "FROM held AS a JOIN held AS b ON b.tracking_hit_id = a.tracking_hit_id GROUP BY 1, 2",
            offers=_OFFERS,
            best="SELECT offer_label FROM offers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20",
            held="SELECT DISTINCT tracking_hit_id, offer_label FROM offers "
                 "WHERE offer_label IN (SELECT offer_label FROM best)"),
        "R41": _with(
            "SELECT bundle_size, count(*) AS n_hits FROM (SELECT tracking_hit_id, count(*) "
            "AS bundle_size FROM hits GROUP BY 1) AS s GROUP BY 1"),
        "R42": _bundled("SELECT * FROM bundles"),
        "R42_per_hit": _bundled("SELECT * FROM rows_"),
        "R43": _bundled(
            "SELECT size_bucket, bundle_label, CAST(sum(n) AS BIGINT) AS n, "
            "CASE WHEN grouping(bundle_label) = 0 THEN 'bundle_label' "
            "WHEN grouping(size_bucket) = 0 THEN 'size_bucket' ELSE 'all' END AS level "
            "FROM (SELECT *, 'Bundles of ' || bundle_size AS size_bucket FROM bundles) AS t "
            "GROUP BY ROLLUP (size_bucket, bundle_label)"),
        "R44": _bundled(
            "SELECT row_number() OVER (ORDER BY bundle_size DESC, n DESC, bundle_label) AS rank, * "
            "FROM bundles ORDER BY bundle_size DESC, n DESC, bundle_label LIMIT 20"),
        "R45": _with(
            "SELECT competitor_name, promotion_type, value, "
            "string_agg(play_value, ', ' ORDER BY play_value) AS modes "
            f"FROM ({_MODES}) AS m GROUP BY 1, 2, 3"),
        "R45_modes": _with(_MODES),
        "R46": _with(
            "SELECT competitor_name, holiday_type, local_created_at AS first_date, "
            "subject AS first_subject, offer_text AS first_offer, play_value AS first_wager, "
            "deposit_requirement AS first_requirements FROM (SELECT *, row_number() OVER "
            "(PARTITION BY competitor_name, holiday_type ORDER BY local_created_at, "
            "tracking_hit_id, subject NULLS FIRST, offer_text NULLS FIRST, "
            "play_value NULLS FIRST, deposit_requirement NULLS FIRST) AS place FROM seasonal "
            "WHERE holiday_type IS NOT NULL) AS s WHERE place = 1", **seasonal),
        "R47": _with(_ACTIVITY, **seasonal),
        "R47_wide": _with(_wide(_ACTIVITY, "competitor_name", "holiday_type", "n",
                                ["Black Friday", "Christmas"]), **seasonal),
        "R48": _promos(),
        "R48_competitor": _promos(f"competitor_name = '{COMPETITOR}'"),
        "R49": _with(
            f"SELECT {_TIMELINE_COLUMNS}, holiday, CASE WHEN holiday IN ('Christmas', "
            "'Black Friday') THEN holiday ELSE type END AS color_label, CASE holiday "
            "WHEN 'Christmas' THEN '🎄' WHEN 'Black Friday' THEN '🖤' ELSE '' END AS marker "
            f"FROM ({_TIMELINE}) AS t"),
        "R50": _with(
            "SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM hits UNION ALL "
            "SELECT 'competitors', CAST(count(DISTINCT competitor_name) AS VARCHAR) FROM hits "
            f"UNION ALL SELECT 'names', {_NAMES} FROM hits"),
        "R51": _with(_VERTICALS),
        "R52": _with(_LEADERS),
        "R53": _with(
            "SELECT count(DISTINCT classification) = 1 AND count(*) = count(classification) "
            "AS is_single, CASE WHEN count(DISTINCT classification) = 1 AND "
            "count(*) = count(classification) THEN min(classification) END AS classification "
            "FROM hits"),
        "R54": _with(
            "SELECT section, row_number() OVER (PARTITION BY section ORDER BY block, key, pos) "
            f"AS line_no, text FROM ({_LINES}) AS l",
            one="SELECT count(*) AS rows_, count(DISTINCT competitor_name) AS competitors, "
                f"{_NAMES} AS names FROM hits",
            verticals=_VERTICALS, lead=_LEADERS,
            promo="SELECT * FROM lead WHERE metric = 'promotion'",
            day="SELECT * FROM lead WHERE metric = 'day'",
            cat="SELECT * FROM lead WHERE metric = 'category'",
            single="SELECT min(classification) AS classification FROM hits "
                   "HAVING count(DISTINCT classification) = 1 "
                   "AND count(*) = count(classification)"),
    }
