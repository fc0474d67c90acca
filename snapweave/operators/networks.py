"""Addresses in a table of networks: the longest prefix that holds each, by equi-joins on prefixes of 128 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits below which a network of either kind is wide: there are fewer than 2 ** 18 of these, so they are broadcast.
WIDE = 16


def _hextets(text: Column) -> Column:
    """The parts of one side of `::`, padded to four digits each; a dotted end as two of them."""
    pair = lambda p, k: F.lpad(F.lower(F.hex(F.get(F.split(p, r"\."), F.lit(k)).try_cast("bigint") * 256 + F.get(F.split(p, r"\."), F.lit(k + 1)).try_cast("bigint"))), 4, "0")
    parts = F.transform(F.split(text, ":"), lambda p: F.when(p.contains("."), F.concat(pair(p, 0), pair(p, 2))).otherwise(F.lpad(p, 4, "0")))
    return F.when(text == "", "").otherwise(F.array_join(parts, ""))


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_bits(ip: Column) -> Column:
    """An address as 128 digits 0 and 1, an IPv4 one as ::ffff:a.b.c.d; null for what is no address. Zones are left out, case is no matter."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    dotted = rf"{octet}(\.{octet}){{3}}"
    half = lambda digits, at: F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0")

    def bits(whole: Column) -> Column:
        fits = whole.rlike(r"^[0-9a-f]{0,4}(:[0-9a-f]{0,4})*(:[\d.]+)?$") & ~whole.rlike(":::|^:[^:]|[^:]:$")
        joined = lambda sides: _once(F.transform(sides, _hextets), lambda s: F.when(F.size(s) == 1, s[0]).when((F.size(s) == 2) & (F.length(s[0]) + F.length(s[1]) <= 28), F.concat(s[0], F.repeat(F.lit("0"), 32 - F.length(s[0]) - F.length(s[1])), s[1])))
        return F.when(fits, _once(joined(F.split(whole, "::")), lambda digits: F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat(half(digits, 1), half(digits, 17)))))

    whole = lambda low: F.when(low.rlike(rf"^{dotted}$"), F.concat(F.lit("::ffff:"), low)).when(low.rlike(rf"^[0-9a-f:]*(:{dotted})?$"), low)
    return _once(F.regexp_replace(F.lower(F.trim(ip)), "%.*$", ""), lambda low: _once(whole(low), bits))


def network_prefix(network: Column) -> Column:
    """The first bits of a network `address/length` (an address alone is a network of one); null for what is none."""
    ip, length = F.substring_index(network, "/", 1), F.when(network.contains("/"), F.regexp_extract(network, r"/(\d{1,3})$", 1)).otherwise("128")
    four = ~ip.contains(":")
    bits = F.when(four & network.contains("/"), length.try_cast("int") + 96).otherwise(length.try_cast("int"))
    return F.when((bits <= 128) & (bits >= F.when(four, 96).otherwise(0)), F.substring(address_bits(ip), F.lit(1), bits))


def locate(rows: DataFrame, ip: str, networks: DataFrame) -> DataFrame:
    """rows with `network` and `label` of the narrowest network (network, label) that holds their address; null where there is none.

    Each distinct address is looked up once, by its prefixes of the lengths that networks have (at most 129). Wide networks, of which there are few,
    are broadcast, so that no prefix that most addresses share is a key of a shuffle. Of networks that are the same the first by name counts. An
    IPv4 address that is written as an IPv6 one lies in IPv4 networks.
    """
    held = networks.select(network_prefix(F.col("network")).alias("prefix"), "network", "label").where("prefix is not null")
    held = held.groupBy("prefix").agg(F.min(F.struct("network", "label")).alias("held")).withColumn("bits", F.length("prefix"))
    lengths = [r.bits for r in held.select("bits").distinct().collect()]  # at most 129
    name = F.col(ip)
    each = rows.select(name.alias("_ip")).distinct().select("_ip", address_bits(F.col("_ip")).alias("_bits")).where("_bits is not null")
    wide = lambda n: n <= WIDE or 96 <= n <= 96 + WIDE
    found = None
    for of in ([n for n in lengths if wide(n)], [n for n in lengths if not wide(n)]):
        if of:
            keys = each.select("_ip", F.explode(F.array(*map(F.lit, of))).alias("_n"), "_bits").select("_ip", F.substring(F.col("_bits"), F.lit(1), F.col("_n")).alias("prefix"))
            nets = held.where(F.col("bits").isin(of))
            got = keys.join(F.broadcast(nets) if wide(of[0]) else nets, "prefix").select("_ip", "bits", "held")
            found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.withColumns({"network": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})
    best = found.groupBy("_ip").agg(F.max_by("held", "bits").alias("_held"))
    return rows.join(best, name == F.col("_ip"), "left").select(*[rows[c] for c in rows.columns], F.col("_held.network").alias("network"), F.col("_held.label").alias("label"))
