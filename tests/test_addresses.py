"""Address keys and ranges against the standard library's numbers."""

import ipaddress
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hitprism.functions import addresses
from hitprism.operators import sender


def number(text):
    try:
        ip = ipaddress.ip_address(text.strip().split("%")[0])
    except ValueError:
        return None
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def samples(rng, n=150):
    out = ["", "x", "1.2.3", "1.2.3.256", "1.2.3.4.5", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
           "1::2::3", ":::", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "12345::", "g::",
           " 10.0.0.1 ", "fe80::1%eth0", "FE80::ABCD", "2001:db8::0:1", "1:2", ":1", "1:", "255.255.255.255", "0.0.0.0"]
    for _ in range(n):
        out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        out.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))))
        out.append(ipaddress.IPv6Address(rng.getrandbits(rng.randint(1, 128))).exploded)
    return out


def test_keys_are_the_numbers(spark):
    texts = samples(random.Random(1))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ip string")
    found = {r.ip: r.key for r in df.select("ip", addresses.address_key(F.col("ip")).alias("key")).collect()}
    assert found.pop(None) is None
    assert found == {t: None if number(t) is None else f"{number(t):032x}" for t in texts}


def test_range_prefixes_cover_the_range_and_no_more(spark):
    rng = random.Random(2)
    ends = [(0, (1 << 128) - 1), (5, 5), (0, 0), (1 << 127, (1 << 128) - 1), (16, 31), (15, 32), (9, 3)]
    for _ in range(60):
        a = rng.getrandbits(128) & ~((1 << rng.choice([0, 4, 16, 64])) - 1)
        ends.append((a, min(a + rng.getrandbits(rng.randint(1, 100)), (1 << 128) - 1)))
    df = spark.createDataFrame([(f"{a:032x}", f"{b:032x}") for a, b in ends], "a string, b string")
    for r in df.select("a", "b", addresses.range_prefixes(F.col("a"), F.col("b")).alias("parts")).collect():
        covered = sorted((int(p.ljust(32, "0"), 16), int(p.ljust(32, "f"), 16)) for p in r.parts)
        low, high = int(r.a, 16), int(r.b, 16)
        if low > high:
            assert covered == []
            continue
        assert covered[0][0] == low and covered[-1][1] == high
        assert all(after[0] == before[1] + 1 for before, after in zip(covered, covered[1:]))


@pytest.mark.parametrize("seed", [3, 4])
def test_overlapping_ranges(spark, hits, seed):
    rng = random.Random(seed)
    v4 = [f"10.0.{rng.randint(0, 2)}.{rng.randint(0, 20)}" for _ in range(60)]
    v6 = [str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.randint(0, 300))).upper() for _ in range(60)]
    senders = [(rng.choice("AB"), ip) for ip in [*v4, *v6, "no address", "9.9.9.9"]] + [("A", None), (None, "10.0.0.1")]
    ranges = []
    for pool in (v4, v6):
        for _ in range(12):
            a, b = sorted(rng.sample(pool, 2), key=number)
            ranges.append((a, b, f"org {rng.randint(0, 4)}"))
    ranges += [(v4[0], v4[0], "org 9"), (v4[0], v4[0], "org 8"), ("10.0.2.9", "10.0.0.1", "turned"), ("x", "y", "none"), (None, v4[1], "none"), (v6[0], "::ffff:10.0.0.0", "turned")]
    want = {}
    for name, ip in {s for s in senders if None not in s}:
        n, best = number(ip), None
        for a, b, org in ranges:
            low, high = (None if x is None else number(x) for x in (a, b))
            if None not in (n, low, high) and low <= n <= high:
                key = (-low, high, org)
                best = min(best, key) if best else key
        want.setdefault((name, best[2] if best else "Unknown"), set()).add(ip)
    table = hits(*[{"tracking_hit_id": i, "competitor_name": c, "from_ip": ip} for i, (c, ip) in enumerate(senders)])
    got = sender.provider_matrix_by_range(table, spark.createDataFrame(ranges, "first_ip string, last_ip string, org string"))
    assert rows(got, "competitor_name", "provider", "n_ips") == sorted((*k, len(v)) for k, v in want.items())
    empty = sender.provider_matrix_by_range(table, spark.createDataFrame([], "first_ip string, last_ip string, org string"))
    assert {r.provider for r in empty.collect()} == {"Unknown"}
