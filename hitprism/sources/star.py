"""The hits table as a view on an order star schema.

An order is a message and its line items are the offers. Each column is one
expression that Spark SQL and other SQL engines read alike.
"""

from pyspark.sql import functions as F

from hitprism.schema import HITS

TABLES = ["lineitem", "orders", "customer", "nation", "region", "part", "documents"]

# Second of the day at which an order counts as sent.
_SECOND = "(o_orderkey * 7919) % 86400"
_TYPE = (
    "CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'ECONOMY' THEN 'Free Spins' "
    "WHEN 'MEDIUM' THEN 'free chip' WHEN 'SMALL' THEN 'Tournament Entry' "
    "WHEN 'LARGE' THEN 'Deposit Bonus' ELSE 'Cashback' END"
)
_CHANNEL = (
    "CASE WHEN o_orderkey % 41 = 0 THEN 'push' WHEN o_orderkey % 3 = 0 THEN 'email' "
    "WHEN o_orderkey % 3 = 1 THEN 'sms' ELSE 'calls' END"
)


def _text(number):
    return f"CAST({number} AS VARCHAR(20))"


COLUMNS = {
    "tracking_hit_id": "o_orderkey",
    "tracking_id": "o_custkey",
    "competitor_name": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE n_name END",
    "country": "r_name",
    "vertical": "CASE o_orderstatus WHEN 'F' THEN 'Casino' WHEN 'O' THEN 'Sports' ELSE 'Poker' END",
    "lifecycle": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_mktsegment END",
    "channel": _CHANNEL,
    "channel_type": _CHANNEL,
    "category": "o_orderpriority",
    "classification": "'Marketing'",
    "email_type": (
        "CASE o_orderkey % 7 WHEN 0 THEN 'Welcome' WHEN 1 THEN 'Informational' "
        "WHEN 2 THEN 'System' WHEN 3 THEN 'Transactional' WHEN 4 THEN 'Newsletter' "
        "WHEN 5 THEN NULL ELSE 'Promotional' END"
    ),
    "tone_of_voice": (
        "CASE o_orderkey % 5 WHEN 0 THEN 'Urgent' WHEN 1 THEN 'Friendly' "
        "WHEN 2 THEN 'Formal' WHEN 3 THEN 'Playful' ELSE NULL END"
    ),
    "type": _TYPE,
    "promotion_type": _TYPE,
    "promotion_types": _TYPE,
    "value": (
        "CASE WHEN l_suppkey % 10 = 0 THEN NULL "
        f"WHEN p_type = 'ECONOMY' THEN concat({_text('p_size')}, ' FS') "
        f"ELSE concat({_text('CAST(round(l_discount * 100) AS INT)')}, '%') END"
    ),
    "play_value": (
        "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0.10' ELSE '0.20' END"
    ),
    "deposit_requirement": (
        "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'min 10' ELSE 'min 20' END"
    ),
    "from": (
        f"concat(' Promo <News', {_text('o_orderkey % 6')}, '@Mail', "
        f"{_text('o_custkey % 9')}, '.Example.com> ')"
    ),
    "to": f"concat('inbox', {_text('o_custkey % 12')}, '@example.org')",
    "from_ip": (
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE "
        f"concat('10.0.', {_text('o_custkey % 4')}, '.', {_text('o_orderkey % 8')}) END"
    ),
    "subject": (
        "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat(' ', o_orderpriority, "
        "repeat(' bonus', CAST(n_nationkey % 4 AS INT)), ' from ', n_name, "
        "CASE o_orderkey % 11 WHEN 0 THEN ' 🎄' WHEN 1 THEN ' Black Friday' "
        "WHEN 2 THEN ' 🔥🔥' ELSE '' END) END"
    ),
    "content": (
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE "
        "concat(text, CASE o_orderkey % 6 WHEN 0 THEN ' 🔥' ELSE '' END) END"
    ),
    "translated_content": "CASE WHEN o_orderkey % 31 = 0 THEN 'merry xmas' ELSE text END",
    "holiday": (
        "CASE WHEN month(o_orderdate) = 12 AND o_orderkey % 3 = 0 THEN 'Advent' "
        "WHEN month(o_orderdate) = 11 AND o_orderkey % 3 = 0 THEN 'Black Week' "
        "WHEN o_orderkey % 13 = 0 THEN 'Anniversary' ELSE NULL END"
    ),
    "created_at": f"o_orderdate + CAST({_SECOND} AS INT) * INTERVAL '1' SECOND",
    "local_created_at": (
        f"o_orderdate + CAST({_SECOND} + (n_nationkey % 5) * 3600 AS INT) * INTERVAL '1' SECOND"
    ),
    "tracking_start_at": "o_orderdate - CAST(o_orderkey % 6 AS INT) * INTERVAL '1' DAY",
}


def hits_from_star(spark, folder):
    """The hits table over the parquet tables in ``folder``.

    Line items join their parts, and orders their customers, before they meet, so that
    no more than that is shuffled. The texts join last but for the names of nations and
    regions, so that they are shuffled by their document only, and the names never.
    """
    t = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES}
    n_documents = t["documents"].agg(F.count(F.lit(1)).alias("n")).scalar()
    offers = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    rows = (
        t["orders"]
        .withColumn("doc_ref", F.col("o_orderkey") % n_documents)
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(offers, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t["documents"], F.col("doc_ref") == F.col("doc_id"))
        .join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    columns = [
        F.expr(COLUMNS[f.name]).cast(f.dataType).alias(f.name) for f in HITS.fields
    ]
    return rows.select(*columns)


def hits_sql():
    """The same view as the text of a SELECT, for a check by another engine."""
    columns = ",\n  ".join(f'{sql} AS "{name}"' for name, sql in COLUMNS.items())
    return (
        f"SELECT\n  {columns}\nFROM lineitem\n"
        "JOIN (SELECT *, o_orderkey % (SELECT count(*) FROM documents) AS doc_ref FROM orders)\n"
        "  AS orders ON l_orderkey = o_orderkey\n"
        "JOIN customer ON o_custkey = c_custkey\n"
        "JOIN nation ON c_nationkey = n_nationkey\n"
        "JOIN region ON n_regionkey = r_regionkey\n"
        "JOIN part ON l_partkey = p_partkey\n"
        "JOIN documents ON doc_id = doc_ref"
    )


def ip_dim(hits):
    """A provider table for the IPs seen; some are left out on purpose."""
    last = F.substring_index("from_ip", ".", -1)
    org = (
        F.when(last.isin("0", "1", "2"), F.lit("AS100 Alpha Mail"))
        .when(last.isin("3", "4"), F.lit("AS200 Beta Post"))
        .when(last == "5", F.lit("AS300 Gamma Send"))
    )
    known = hits.select("from_ip", org.alias("org")).where(F.col("org").isNotNull())
    return known.distinct()


def networks(hits):
    """Blocks of the IPs seen: most wide ones, and narrow ones inside them."""
    part = [F.split_part("from_ip", F.lit("."), F.lit(i)) for i in (1, 2, 3, 4)]
    wide = hits.where(F.col("from_ip").isNotNull() & (part[2] != "3")).select(
        F.concat_ws(".", *part[:3], F.lit("0")).alias("network"), F.lit(24).alias("prefix"),
        F.lit("AS400 Delta Net").alias("org")).distinct()
    narrow = ip_dim(hits).where(part[3].isin("0", "5")).select(
        F.col("from_ip").alias("network"), F.when(part[3] == "0", 31).otherwise(32).alias("prefix"), "org")
    return wide.union(narrow)


# Ranges of the addresses seen: family, third and fourth part of both ends (``a`` is
# an address's own third part), provider, and the third parts that have the range.
RANGES = [
    (4, "a", "0", "a", "255", "AS500 Wide Net", "a <> 3"),
    (4, "a", "2", "a + 1", "3", "AS600 Cross Net", "a = 1"),
    (4, "a", "4", "a", "5", "AS700 Next Net", "true"),
    (4, "a", "4", "a", "4", "AS750 Point Net", "a = 0"),
    (6, "a", "0", "a", "5", "AS800 Six Net", "a <> 2"),
    (6, "a", "3", "a + 1", "1", "AS900 Six Cross", "a = 0"),
]


def address_ranges(hits):
    """Ranges of IPv4 and IPv6 addresses that overlap, touch and share starts."""
    parts = hits.where(F.col("from_ip").isNotNull()).select(F.split("from_ip", r"\.")[2].cast("int").alias("a")).distinct()
    shape = {4: "concat('10.0.', {0}, '.', {1})", 6: "concat('2001:db8:0:0:', lower(hex({0})), '::', lower(hex({1})))"}
    each = [F.when(F.expr(where), F.struct(F.expr(shape[family].format(a, b)).alias("first_ip"), F.expr(shape[family].format(c, d)).alias("last_ip"),
                                           F.lit(org).alias("org"))) for family, a, b, c, d, org, where in RANGES]
    return parts.select(F.explode(F.array(*each)).alias("r")).where("r IS NOT NULL").select("r.*")
