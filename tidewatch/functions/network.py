"""Addresses and host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null unless it has four octets up to 255."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.try_cast("long")))


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def classify_ipv4(ip: Column) -> Column:
    """routable, reason and kind of an address, or of the first address of a CIDR block (prefix up to 32)."""
    base, prefix = F.split_part(F.trim(ip), F.lit("/"), F.lit(1)), F.split_part(F.trim(ip), F.lit("/"), F.lit(2))
    number = ipv4_number(base)
    bits = F.when(F.contains(ip, F.lit("/")), prefix.try_cast("int"))
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("long")
    number = F.when(~F.contains(ip, F.lit("/")), number).when(bits.between(0, 32), number - number % size)
    result = lambda ok, reason, kind: F.struct(F.lit(ok).alias("routable"), F.lit(reason).alias("reason"), F.lit(kind).alias("kind"))
    case = F.when(number.isNull(), result(False, "Invalid IP address format", "Invalid"))
    for first, length, reason, kind in P.IPV4_BLOCKS:
        low = _number(first)
        case = case.when(number.between(low, low + (1 << (32 - length)) - 1), result(False, reason, kind))
    return case.otherwise(result(True, "Globally routable public address", "Public"))


def normalise_ipv4(ip: Column) -> Column:
    """Without leading zeros; other strings stay as they are."""
    return F.when(ipv4_number(ip).isNotNull(), F.array_join(F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int").cast("string")), ".")).otherwise(ip)


def normalise_domain(host: Column) -> Column:
    """Lower case, without outer blanks, dots and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^[\s.]+|[\s.]+$", ""), r"^www\.", "")


def valid_domain(host: Column) -> Column:
    """Labels of 1 to 63 letters, digits and inner hyphens, at least two of them, the last of letters; not a file name or a number."""
    labels = host.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$")
    return labels & ~looks_like_file(host) & ~host.rlike(r"^\d+\.[A-Za-z]+$")


def looks_like_file(host: Column) -> Column:
    """Two parts of which the second is a file suffix."""
    return (F.size(F.split(host, r"\.")) == 2) & F.element_at(F.split(host, r"\."), -1).isin(*P.FILE_SUFFIXES)


def private_needs_context(ip: Column, text: Column) -> Column:
    """Whether a threat word lies within 100 characters of an address's first occurrence."""
    at = F.instr(text, ip)
    around = F.substr(text, F.greatest(at - 100, F.lit(1)), F.length(ip) + 200)
    return F.lower(around).rlike("|".join(P.THREAT_NEAR))
