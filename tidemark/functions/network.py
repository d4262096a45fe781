"""Columns of cache headers, a map of header names to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an edge server is named, and the addresses of a debug header.
SERVER, DEBUG = r"from a([0-9\-]+).deploy", r"\[a=([0-9\.]+),"


def server_ip(header: Column) -> Column:
    return F.replace(F.regexp_extract(header, SERVER, 1), F.lit("-"), F.lit("."))


def known(x: Column) -> Column:
    """An array of the value, empty if it is null."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))


def cache_path(headers: Column) -> Column:
    """struct(cache_hit, remote_hit, cache_ip, remote_ip, origin_ip, final_ip, ips): what answered a request, from the client on."""
    get = lambda k: F.try_element_at(headers, F.lit(k))
    named = get("x-cache").contains("TCP_HIT") | get("x-cache").contains("TCP_MISS")
    first = F.when(named, server_ip(get("x-cache")))
    remote = server_ip(get("x-cache-remote"))
    none = F.array().cast("array<string>")
    parents = F.coalesce(F.transform(F.split(get("x-parent-response-time"), ", "), lambda x: F.get(F.split(x, ","), F.lit(1))), none)
    debug = F.coalesce(F.regexp_extract_all(get("akamai-amd-bc-debug"), F.lit(DEBUG), F.lit(1)), none)
    origin = F.get(F.split(get("x-origin-response-time"), ","), F.lit(1))
    back = F.when(F.size(parents) > 1, F.reverse(F.slice(parents, F.lit(2), F.greatest(F.size(parents) - 1, F.lit(0))))).otherwise(none)
    ips = F.concat(known(first), known(remote), back, known(F.get(debug, F.lit(0))))
    ips = F.when(origin.isNotNull() & ~F.array_contains(ips, origin), F.array_append(ips, origin)).otherwise(ips)
    final = F.coalesce(origin, F.try_element_at(debug, F.lit(-1)), F.get(parents, F.lit(0)))
    return F.struct(F.when(named, get("x-cache").contains("TCP_HIT")).alias("cache_hit"), get("x-cache-remote").contains("TCP_HIT").alias("remote_hit"),
                    first.alias("cache_ip"), remote.alias("remote_ip"), origin.alias("origin_ip"), final.alias("final_ip"), ips.alias("ips"))


def local_hour(ts: Column, zones: Column) -> Column:
    """The mean local hour, rounded down, over a country's time zones; null where none is known."""
    hours = F.transform(zones, lambda z: F.hour(F.from_utc_timestamp(ts, z)).cast("long"))
    return F.when(F.size(zones) > 0, F.floor(F.aggregate(hours, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(zones)))
