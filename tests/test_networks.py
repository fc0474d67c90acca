"""Addresses in networks against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from snapweave.operators import networks

ODD = [None, "10.0.0.1", "255.171.0.9", "", "1.2.3", "256.1.1.1", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", ":::", "FE80::1%eth0", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "12345::", "g::", "1.2.3.4:5"]


def number(text):
    try:
        ip = ipaddress.ip_address((text or "").split("%")[0])
    except ValueError:
        return None
    return int(ip) if ip.version == 6 else (0xFFFF << 32) + int(ip)


def test_bits_of_odd_addresses(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "ip string").select("ip", networks.address_bits(F.col("ip")).alias("bits")).collect()
    assert [(r.ip, None if r.bits is None else int(r.bits, 2)) for r in got] == [(t, number(t)) for t in ODD]


def test_narrowest_network(spark):
    rnd = random.Random(3)
    four = lambda: ".".join(str(rnd.choice([1, 2, 10, 255])) for _ in range(4))
    six = lambda: str(ipaddress.ip_address(sum(rnd.choice([0, 1, 0xABCD]) << 16 * k for k in range(8))))
    nets = [(f"{four()}/{rnd.randrange(33)}", f"n{k}") for k in range(60)] + [(f"{six()}/{rnd.randrange(129)}", f"m{k}") for k in range(60)] + [("1.2.10.255", "one"), ("bad/8", "x"), ("1.2.3.4/33", "x"), ("::/0", "all"), ("::/0", "again")]
    rows = [(k, ip) for k, ip in enumerate(ODD + [four() for _ in range(150)] + [six() for _ in range(150)] + ["1.2.10.255"] * 3)]

    def span(net):
        at, _, length = net.partition("/")
        base = number(at)
        most = 128 if ":" in at else 32
        if base is None or (length and int(length) > most):
            return None
        bits = (int(length) if length else most) + (0 if ":" in at else 96)
        return bits, base >> (128 - bits)

    def want(ip):
        n = number(ip)
        held = [(s[0], net, label) for net, label in nets if n is not None and (s := span(net)) and n >> (128 - s[0]) == s[1]]
        if not held:
            return None, None
        bits = max(held)[0]
        return min((net, label) for b, net, label in held if b == bits)

    got = networks.locate(spark.createDataFrame(rows, "id long, ip string"), "ip", spark.createDataFrame(nets, "network string, label string")).collect()
    assert sorted((r.id, r.network, r.label) for r in got) == [(k, *want(ip)) for k, ip in rows]
    none = networks.locate(spark.createDataFrame(rows, "id long, ip string"), "ip", spark.createDataFrame([], "network string, label string"))
    assert none.where("label is null").count() == len(rows)
