"""URL filters as a sorted sweep over intervals.

A host is written from its last label on (``org.example.blog.``), so a rule's host
with all its subdomains is one interval of these keys, and a path prefix is an
interval of paths. Two sweeps join addresses to rules:

1. over hosts, giving each address every rule host it lies in;
2. over (rule host, path), giving the innermost rule around each path.

A sweep sorts interval starts, interval ends and points together, range by
range of the sorted keys. Intervals of prefixes nest, so the running count of
open intervals is the height of the stack of active rules, and the rule at
height h is the last one that started at height h. Ranges hand their height,
and the open rule of each height, to the next range; that is a row per range
and height. Nothing is joined by an inequality.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitprism.llm.stored import stored

START, POINT, END = 0, 1, 2
_PAST = bytes([255])  # sorts after any UTF-8 text


def parts(url):
    """Host (A-Z lower-cased) and path of an address column; empty where it is
    null or has no ``://``."""
    after = F.when(F.col(url).contains("://"), F.substr(F.col(url), F.instr(F.col(url), F.lit("://")) + 3))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """Labels from the last to the first, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points, rules, group, all_levels):
    """Join points to the intervals around them.

    ``points``: columns ``group`` (equal for a match; may be none), ``key``,
    ``point``. ``rules``: ``group``, ``key`` (a prefix), ``rule``, one row per group
    and key. Gives (point, rule): the innermost rule, or with ``all_levels`` every
    one. Points in no interval give no row.
    """
    # the last column parts events with one key among ranges; their order is free
    place = [*group, "key", "kind", "tie"]

    def event(df, kind, key, step, point, rule):
        return df.select(*group, key.alias("key"), F.lit(kind).alias("kind"), F.xxhash64(point).alias("tie"),
                         F.lit(step).alias("step"), point.alias("point"), rule.alias("rule"))

    key = F.encode("key", "UTF-8")
    no_point = F.lit(None).cast(points.schema["point"].dataType)
    no_rule = F.lit(None).cast(rules.schema["rule"].dataType)
    events = (
        event(points, POINT, key, 0, F.col("point"), no_rule)
        .union(event(rules, START, key, 1, no_point, F.col("rule")))
        .union(event(rules, END, F.concat(key, F.lit(_PAST)), -1, no_point, no_rule))
    )
    ranges = stored(events.repartitionByRange(*place).withColumn("range", F.spark_partition_id()), "sweep")

    # the height of the stack at each event
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heights = ranges.groupBy("range").agg(F.sum("step").alias("steps")).select(
        "range", F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("height_before"))
    running = Window.partitionBy("range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    # heights: a row per range, that is per task of the sort
    at = ranges.withColumn("steps", F.sum("step").over(running)).join(F.broadcast(heights), "range").withColumn(
        "height", (F.col("steps") + F.col("height_before")).cast("int"))
    at = stored(at.where("kind <> 2").select("range", *place, "point", "rule", "height", "height_before"), "heights")

    # the rule that is open at each height where a range begins
    started = at.where("kind = 0").groupBy("range", F.col("height").alias("level")).agg(
        F.max_by("rule", F.struct(*place)).alias("rule"))
    asked = heights.where("height_before > 0").select(
        "range", F.explode(F.sequence(F.lit(1), F.col("height_before").cast("int"))).alias("level"), no_rule.alias("rule"))
    earlier = Window.partitionBy("level").orderBy("range", "asks").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        started.withColumn("asks", F.lit(1)).unionByName(asked.withColumn("asks", F.lit(0)))
        .withColumn("carried", F.last("rule", ignorenulls=True).over(earlier)).where("asks = 0").select("range", "level", "carried")
    )

    # the last rule that started at a point's height, or at each height up to it
    level = F.explode(F.sequence(F.lit(1), F.col("height"))) if all_levels else F.col("height")
    at_level = at.where("kind = 1 AND height > 0").select("range", *place, "point", "rule", level.alias("level")).union(
        at.where("kind = 0").select("range", *place, "point", "rule", F.col("height").alias("level")))
    same_level = Window.partitionBy("range", "level").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    return (
        at_level.withColumn("rule", F.last("rule", ignorenulls=True).over(same_level)).where("kind = 1")
        .join(carried, ["range", "level"], "left")
        .select("point", F.coalesce("rule", "carried").alias("rule"))
    )


def filter_urls(pages, rules, url="url", default="allow"):
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row.

    ``rules``: columns host, path, verdict. A rule fits its host and all
    subdomains if the path starts with the rule's; of several the longest (host
    and path together) wins, then the one with the longer host. Of two rules
    with equal host and path ``block`` wins. Without a rule the verdict is
    ``default``. Null rule hosts or paths count as empty.

    Equal addresses are judged once and joined back by host and path, so
    repeated rows and a host with a large share of the rows cost no more.
    Columns of the added names are replaced, others stay.
    """
    added = ("host", "path", "rule", "verdict")
    host, path = parts(url)
    kept = [c for c in pages.columns if c not in added]
    parsed = pages.select("*", F.struct(host.alias("host"), path.alias("path")).alias("_at"))
    targets = parsed.select("_at.host", "_at.path").distinct()
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", host_key(F.col("host")))

    hosts = clean.select(F.col("host_key").alias("key"), F.col("host_key").alias("rule")).distinct()
    points = targets.select(host_key(F.col("host")).alias("key"), F.struct("host", "path").alias("point"))
    in_hosts = sweep(points, hosts, [], all_levels=True)
    rule = F.struct("host", F.col("path").alias("path"), "verdict")
    paths = clean.select("host_key", F.col("path").alias("key"), rule.alias("rule"))
    inside = sweep(in_hosts.select(F.col("rule").alias("host_key"), F.col("point.path").alias("key"), "point"), paths, ["host_key"], all_levels=False)
    length = F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))
    # stored, so that the join below sorts both sides anew and can split hot addresses
    best = stored(inside.groupBy("point").agg(F.max_by("rule", length).alias("rule")), "verdicts")
    found = best.select(F.col("point").alias("_point"), F.col("rule").alias("_rule"))
    return parsed.join(found, [F.col(f"_at.{c}") == F.col(f"_point.{c}") for c in ("host", "path")], "left").select(
        *kept, F.col("_at.host").alias("host"), F.col("_at.path").alias("path"),
        F.concat("_rule.host", "_rule.path").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))
