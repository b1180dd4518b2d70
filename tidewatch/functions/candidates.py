"""Candidates of indicators, their format checks, the fallback verdict on them, and the whole extraction of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .indicators import commands, distinct_matches, emails, file_paths, hashes, matches, processes, refang, registry_keys, stix_pattern_values
from .links import url_candidates
from .network import classify_ipv4, ipv4_number, normalise_domain, normalise_ipv4, private_needs_context, valid_domain

EMPTY = "array<string>"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def package_name(host: Column) -> Column:
    """Reverse host names, as programs have them: a known start, or com, org or net with a word of programs or makers."""
    low = F.lower(host)
    known = F.exists(F.array(*map(F.lit, P.PACKAGE_STARTS)), lambda s: F.startswith(low, s))
    return (F.size(F.split(host, r"\.")) >= 3) & (known | (low.rlike(r"^(?:com|org|net)\.") & _any(low, P.PACKAGE_WORDS)))


def file_name(host: Column) -> Column:
    """A known suffix, or two parts of which the first holds a word of file names and the second is short."""
    low = F.lower(host)
    suffix = F.exists(F.array(*map(F.lit, P.NAME_SUFFIXES)), lambda s: F.endswith(low, s))
    return suffix | (low.rlike(r"^[^.]+\.[a-z]{1,3}$") & _any(F.split_part(low, F.lit("."), F.lit(1)), P.NAME_WORDS))


def domain_candidates(text: Column) -> Column:
    """Host names, restored and normalised, that are no abbreviation, program, file or malformed name."""
    found = F.transform(F.concat(matches(text, P.HOST_CANDIDATE), matches(text, P.HOST_DEFANGED)), refang)
    good = F.filter(found, lambda h: ~F.lower(h).isin(*P.NO_HOSTS) & ~package_name(h) & ~file_name(h) & valid_domain(h) & (F.length(h) > 3))
    return F.array_distinct(F.transform(good, normalise_domain))


def valid_ip(ip: Column) -> Column:
    """An address of four octets, with or without a prefix length of up to 32."""
    base, prefix = F.split_part(ip, F.lit("/"), F.lit(1)), F.split_part(ip, F.lit("/"), F.lit(2))
    return ipv4_number(base).isNotNull() & (~F.contains(ip, F.lit("/")) | prefix.try_cast("int").between(0, 32))


def ip_candidates(text: Column) -> Column:
    """Address blocks, then single addresses that are not the base of one. Private addresses need a threat word near their
    first occurrence unless they are written defanged. Of the newer family none passes: its candidates are eight full groups, which
    look like serial numbers, or malformed."""
    block = rf"\b(?:{P.OCTET}\.){{3}}{P.OCTET}/[0-9]{{1,2}}\b"
    block_defanged = rf"\b(?:{P.OCTET}\[\.\]){{3}}{P.OCTET}/[0-9]{{1,2}}\b"
    blocks = F.filter(F.transform(distinct_matches(text, block, block_defanged), refang), valid_ip)
    bases = F.transform(blocks, lambda b: F.split_part(b, F.lit("/"), F.lit(1)))
    written = distinct_matches(text, rf"\b(?:{P.OCTET}\.){{3}}{P.OCTET}\b", rf"\b(?:{P.OCTET}\[\.\]){{3}}{P.OCTET}\b")
    kept = F.filter(written, lambda w: ~F.array_contains(bases, refang(w)) & valid_ip(refang(w)) & (~w.rlike(P.PRIVATE_WIDE) | private_needs_context(w, text)))
    return F.array_distinct(F.concat(blocks, F.transform(kept, lambda w: normalise_ipv4(refang(w)))))


def routable(ips: Column) -> Column:
    return F.filter(ips, lambda i: classify_ipv4(i)["routable"])


def not_routable(ips: Column) -> Column:
    """ip, reason and kind of the others."""
    rated = F.transform(ips, lambda i: F.struct(i.alias("ip"), classify_ipv4(i).alias("c")))
    return F.transform(F.filter(rated, lambda r: ~r["c"]["routable"]), lambda r: F.struct(r["ip"].alias("ip"), r["c"]["reason"].alias("reason"), r["c"]["kind"].alias("kind")))


def valid_url(url: Column) -> Column:
    """A web scheme, a host with a dot that is an address or ends in letters, and no triple slash; bracketed hosts pass."""
    name = F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)
    return url.rlike(r"(?i)^https?://[^/\s]+") & ~url.rlike("///") & (F.contains(url, F.lit("[.]")) | valid_ip(name) | name.rlike(r"^[^.].*\.[A-Za-z]{2,}$"))


def valid_hash(value: Column) -> Column:
    return value.rlike("(?i)^(?:[a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64}|[a-f0-9]{128})$")


def accept(value: Column, context: Column) -> Column:
    """The verdict without a model: defanged values, or values whose defanged form (often the value itself) is in the text;
    in a text about threats any but trusted hosts; elsewhere what looks suspicious."""
    text = F.coalesce(context, F.lit(""))
    variants = (F.replace(value, F.lit("."), F.lit("[.]")), F.replace(value, F.lit(":"), F.lit("[:]")), F.replace(value, F.lit("http"), F.lit("hxxp")))
    written = F.contains(text, variants[0]) | F.contains(text, variants[1]) | F.contains(text, variants[2])
    return (
        F.when(_any(value, P.DEFANG_MARKS) | written, True)
        .when(_any(F.lower(text), P.THREAT_CONTEXT), ~_any(F.lower(value), P.TRUSTED_HOSTS))
        .otherwise(value.rlike(P.SUSPICIOUS))
    )


NETWORK = ("urls", "domains", "ips")
LISTS = ("urls", "domains", "ips", "hashes", "file_paths", "processes", "registry_keys", "commands", "emails")


def extract(rows: DataFrame, text: str = "text", source_url: str | None = None) -> DataFrame:
    """All indicator lists of a text as further columns: urls, domains, ips, hashes, file_paths, processes, registry_keys, commands,
    emails and the addresses that cannot be routed (non_routable). Values of pattern lines are added once, valid ones alone, and
    excluded ones are left out, and so is the host of the source. With over ten network indicators each must be accepted; with over
    a hundred in a text that reads like a report, all addresses are.

    It goes in steps, so that each list is found once and not again wherever it is used; one scan, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.lit("") if source_url is None else F.coalesce(F.regexp_extract(F.lower(source_url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    out = rows.withColumns({"_text": t, "_own": own, "_stix": stix_pattern_values(t), "_urls": url_candidates(t, valid_url), "_domains": domain_candidates(t), "_every": ip_candidates(t), "_hashes": hashes(t)})
    named = F.transform("_stix", lambda s: s["value"])
    out = out.withColumns({"_named": named, "_every": F.array_except("_every", named)})
    of = lambda good, *kinds: F.filter(F.transform(F.filter("_stix", lambda s: s["kind"].isin(*kinds)), lambda s: s["value"]), good)
    out = out.withColumns({
        "urls": F.array_union(F.array_except("_urls", "_named"), of(valid_url, "url")), "domains": F.array_union(F.array_except("_domains", "_named"), of(valid_domain, "domain")),
        "ips": F.array_union(routable(F.col("_every")), of(valid_ip, "ipv4")), "hashes": F.array_union(F.array_except("_hashes", "_named"), of(valid_hash, "md5", "sha1", "sha256", "sha512")),
    })
    foreign = lambda d: (F.lower(d) != F.col("_own")) & (F.lower(d) != F.regexp_replace("_own", r"^www\.", ""))
    out = out.withColumn("domains", F.filter("domains", foreign))
    out = out.withColumn("_total", F.size("urls") + F.size("domains") + F.size("ips"))
    report = (F.col("_total") > 100) & F.lower("_text").rlike("|".join(P.REPORT_WORDS))
    keep = {"urls": lambda x: accept(x, F.col("_text")), "domains": lambda x: accept(x, F.col("_text")), "ips": lambda x: report | accept(x, F.col("_text"))}
    lists = {k: F.array_sort(F.when(F.col("_total") > 10, F.filter(k, keep[k])).otherwise(F.col(k))) for k in NETWORK}
    host = {"hashes": F.col("hashes"), "file_paths": file_paths(F.col("_text")), "processes": processes(F.col("_text")), "registry_keys": registry_keys(F.col("_text")), "commands": commands(F.col("_text")), "emails": emails(F.col("_text"))}
    out = out.withColumns(lists | {k: F.array_sort(v) for k, v in host.items()} | {"non_routable": not_routable(F.col("_every"))})
    return out.drop("_text", "_own", "_stix", "_urls", "_domains", "_every", "_hashes", "_named", "_total")


def valid_indicator(kind: Column, value: Column) -> Column:
    """Whether a value has the form of its kind: url, domain, ip or hash; other kinds are taken as they are."""
    return F.when(kind == "url", valid_url(value)).when(kind == "domain", valid_domain(value)).when(kind == "ip", valid_ip(value)).when(kind == "hash", valid_hash(value)).otherwise(True)


def products(text: Column, cve: Column) -> Column:
    """Product names within 500 characters of the first mention of a CVE id, in title case and without repeats."""
    at = F.instr(F.lower(text), F.lower(cve))
    low = F.greatest(at - 500, F.lit(1))
    context = F.substr(text, low, at - low + F.length(cve) + 500)
    found = F.concat(*(matches(context, p, 1) for p in P.PRODUCTS))
    return F.when(at > 0, F.array_distinct(F.transform(found, lambda p: F.initcap(F.trim(p))))).otherwise(F.array().cast(EMPTY))
