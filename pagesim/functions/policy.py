"""Network and response policies: public addresses, media types, encodings, sizes."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Networks that are not public.
BLOCKED_IPV4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
BLOCKED_IPV6 = ["::/128", "::1/128", "fe80::/10", "fc00::/7", "2001:db8::/32", "ff00::/8"]
_V4, _V6, _NAT64 = [ipaddress.ip_network(x) for x in BLOCKED_IPV4], [ipaddress.ip_network(x) for x in BLOCKED_IPV6], ipaddress.ip_network("64:ff9b::/96")


def is_public_ip(value: str | None) -> bool:
    """Whether an address is globally routable unicast; IPv4 inside IPv6 counts as that IPv4."""
    try:
        address = ipaddress.ip_address(value or "")
    except ValueError:
        return False
    if address.version == 6:
        inner = address.ipv4_mapped or (ipaddress.IPv4Address(int(address) & 0xFFFFFFFF) if address in _NAT64 else None)
        if inner is None:
            return address.is_global and not any(address in n for n in _V6)
        address = inner
    return address.is_global and not any(address in n for n in _V4)


@F.arrow_udf(T.BooleanType())
def _public(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array((is_public_ip(x) for x in batch.to_pylist()), pa.bool_())


def public_ip(address: Column) -> Column:
    return _public(address)


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    parts = F.split(address, r"\.")
    ok = address.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    value = sum((F.get(parts, F.lit(k)).try_cast("bigint") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(ok, value)


def blocked_ranges(spark: SparkSession) -> DataFrame:
    """network, lo, hi of the blocked IPv4 networks."""
    return spark.createDataFrame([(x, int(n[0]), int(n[-1])) for x in BLOCKED_IPV4 for n in [ipaddress.ip_network(x)]], "network string, lo bigint, hi bigint")


def public_ipv4(addresses: DataFrame, column: str = "ip") -> DataFrame:
    """addresses with ip_number and is_public, by a range join with the 14 blocked networks."""
    ranges = F.broadcast(blocked_ranges(addresses.sparkSession))
    numbered = addresses.withColumn("ip_number", ipv4_number(F.col(column)))
    blocked = numbered.join(ranges, F.col("ip_number").between(F.col("lo"), F.col("hi")), "left")
    return blocked.select(*addresses.columns, "ip_number", (F.col("ip_number").isNotNull() & F.col("network").isNull()).alias("is_public"))


def vetted_hosts(answers: DataFrame) -> DataFrame:
    """(host, address) answers to host, accepted, connect_to: any bad answer rejects, else the first address in order."""
    judged = answers.withColumn("_ok", public_ip(F.col("address")))
    return judged.groupBy("host").agg(F.bool_and("_ok").alias("accepted"), F.when(F.bool_and("_ok"), F.min("address")).alias("connect_to"))


def media_type_problem(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.when(~kind.isin("text/html", "application/xhtml+xml"), F.concat(F.lit("Unsupported content type: "), F.when(kind == "", "missing").otherwise(kind)))


def encoding_problem(encoding: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(encoding, F.lit(""))))
    return F.when(~kind.isin("", "identity", "gzip", "deflate"), F.concat(F.lit("Unsupported content encoding: "), kind))


def size_problem(body: Column, limit: int = 2 << 20) -> Column:
    return F.when(F.octet_length(body) > limit, f"Response exceeded {limit} bytes")
