"""Who sends: domains, IP addresses, providers."""

from pyspark.sql import functions as F

from hitprism.functions import addresses, text, times
from hitprism.operators.messages import messages
from hitprism.schema import HIT_ID, require

UNKNOWN = "Unknown"
_DIGITS = "0123456789abcdef"


def _domain_groups(hits, deduped, unicode_words, *keys):
    domain = text.sender_domain(F.col("from"), unicode_words)
    keys = [*keys, "from_domain"]
    return (
        messages(hits, "competitor_name", "tracking_id", "from", "local_created_at", deduped=deduped)
        .withColumn("from_domain", domain)
        .dropna(subset=["competitor_name", "tracking_id", "from_domain"])
        .groupBy(*keys)
    )


def domain_summary(hits, deduped=False, unicode_words=True):
    """Messages and first and last day per competitor, account and domain."""
    groups = _domain_groups(hits, deduped, unicode_words, "competitor_name", "tracking_id")
    sent = F.col("local_created_at")
    return groups.agg(
        F.count(HIT_ID).alias("n"),
        F.date_format(F.min(sent), times.SHORT_DATE).alias("first_seen"),
        F.date_format(F.max(sent), times.SHORT_DATE).alias("last_seen"),
    )


def domain_matrix(hits, deduped=False, unicode_words=True):
    """Messages per domain and competitor."""
    groups = _domain_groups(hits, deduped, unicode_words, "competitor_name")
    return groups.agg(F.count(HIT_ID).alias("n")).select("from_domain", "competitor_name", "n")


def ip_summary(hits, deduped=False):
    """Messages, first and last time and distinct recipients per competitor and IP."""
    require(hits, "from_ip")
    keys = ["competitor_name", "from_ip"]
    created = times.parse_lenient(F.col("created_at"))
    return (
        messages(hits, *keys, "created_at", "to", deduped=deduped)
        .dropna(subset=keys)
        .withColumn("created_at", created)
        .groupBy(*keys)
        .agg(
            F.count(HIT_ID).alias("n"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.count_distinct("to").alias("unique_to"),
        )
    )


def ip_matrix(hits, deduped=False):
    """Messages per IP and competitor."""
    require(hits, "from_ip")
    keys = ["from_ip", "competitor_name"]
    rows = messages(hits, *keys, deduped=deduped).dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(HIT_ID).alias("n"))


def ips_vs_high_volume(hits, threshold=20, min_ips=1, deduped=False):
    """Distinct IPs per competitor, and how many of them send a lot.

    Messages without an IP form a group that can count as high volume although
    it is no IP; the remainder can then fall short by one.
    """
    require(hits, "from_ip")
    keys = ["competitor_name", "from_ip"]
    per_ip = (
        messages(hits, *keys, deduped=deduped)
        .where(F.col("competitor_name").isNotNull())
        .groupBy(*keys)
        .agg(F.count(HIT_ID).alias("n"))
    )
    return (
        per_ip.groupBy("competitor_name")
        .agg(
            F.count("from_ip").alias("total_ips"),
            F.count_if(F.col("n") >= threshold).alias("high_volume_ips"),
        )
        .where(F.col("total_ips") >= min_ips)
        .withColumn("other_ips", F.col("total_ips") - F.col("high_volume_ips"))
        .orderBy(F.desc("total_ips"), "competitor_name")
    )


def provider_matrix(hits, ip_dim):
    """Distinct IPs per competitor and provider.

    ``ip_dim(from_ip, org)`` has one row per known IP; others are ``Unknown``. An
    IP that is listed twice counts once for each of its providers.
    Only distinct pairs reach the join, so no IP is met more often than there
    are competitors, and Spark picks the join from the table's size.
    """
    require(hits, "from_ip")
    keys = ["competitor_name", "from_ip"]
    pairs = hits.select(*keys).dropna().distinct()
    provider = F.coalesce("org", F.lit(UNKNOWN)).alias("provider")
    return (
        pairs.join(ip_dim.select("from_ip", "org"), "from_ip", "left")
        .groupBy("competitor_name", provider)
        .agg(F.count_distinct("from_ip").alias("n_ips"))
    )


def _ip_number(address):
    """An IPv4 address as a number; null for any other text."""
    is_ip = F.regexp_like(address, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    parts = F.split(F.when(is_ip, address), r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("long")
    return number


def _masked(number, prefix):
    """The number of the network block that holds the address."""
    return F.call_function("shiftright", number, (F.lit(32) - prefix).cast("int"))


def provider_matrix_by_network(hits, networks):
    """``provider_matrix`` by network block: the longest prefix wins.

    ``networks(network, prefix, org)`` has IPv4 blocks such as ``10.0.1.0`` and
    24. An address is looked up once per prefix length, by equality of its block.
    Of a block that is listed twice, the first name in order counts. Addresses
    outside all blocks, or of another kind, are ``Unknown``.
    """
    require(hits, "from_ip")
    pairs = hits.select("competitor_name", "from_ip").dropna().distinct()
    lengths = F.sequence(F.lit(0), F.lit(32))
    probes = (
        pairs.select("from_ip").distinct()
        .select("from_ip", _ip_number(F.col("from_ip")).alias("number"), F.explode(lengths).alias("prefix"))
        .select("from_ip", "prefix", _masked(F.col("number"), F.col("prefix")).alias("block"))
    )
    blocks = (
        networks.select(F.col("prefix").cast("int").alias("prefix"), _ip_number(F.col("network")).alias("number"), "org")
        .groupBy("prefix", _masked(F.col("number"), F.col("prefix")).alias("block")).agg(F.min("org").alias("org"))
    )
    owners = probes.join(blocks, ["prefix", "block"]).groupBy("from_ip").agg(F.max_by("org", "prefix").alias("org"))
    return provider_matrix(hits, owners)


def provider_matrix_by_range(hits, ranges):
    """``provider_matrix`` by ranges of IPv4 and IPv6 addresses, both ends included.

    ``ranges(first_ip, last_ip, org)`` may overlap: of the ranges that hold an address
    the one that starts last counts, then the one that ends first, then the first name
    in order. A range is kept as the beginnings that its addresses have in common, a
    few digits each; an address is looked up by each of its own beginnings, by
    equality. Rows whose ends are no addresses, or in the wrong order, hold none.
    """
    require(hits, "from_ip")
    first, last = addresses.address_key(F.col("first_ip")), addresses.address_key(F.col("last_ip"))
    blocks = ranges.select(first.alias("first"), last.alias("last"), "org").where("first <= last").select(
        "first", "last", "org", F.explode(addresses.range_prefixes(F.col("first"), F.col("last"))).alias("block"))
    probes = (
        hits.select("from_ip").dropna().distinct()
        .select("from_ip", addresses.address_key(F.col("from_ip")).alias("key")).where("key IS NOT NULL")
        .select("from_ip", F.explode(addresses.prefixes(F.col("key"))).alias("block"))
    )
    # of equal starts the smallest end and name: as a maximum, by what they fall short of
    latest = F.struct(F.col("first"), F.translate("last", _DIGITS, _DIGITS[::-1]).alias("end"))
    best = probes.join(blocks, "block").groupBy("from_ip", latest.alias("place")).agg(F.min("org").alias("org"))
    owners = best.groupBy("from_ip").agg(F.max_by("org", "place").alias("org"))
    return provider_matrix(hits, owners)


def provider_list(hits, ip_dim):
    """Providers of each competitor in name order, joined by ``; ``."""
    names = F.array_sort(F.collect_list("provider"))
    return (
        provider_matrix(hits, ip_dim)
        .groupBy("competitor_name")
        .agg(F.array_join(names, "; ").alias("providers"))
        .orderBy("competitor_name")
    )
