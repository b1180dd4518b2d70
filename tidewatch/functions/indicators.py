"""Extraction and normalisation of indicators from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def distinct_matches(text: Column, *found: str, group: int = 0) -> Column:
    """Matches of all patterns, the first occurrence of each kept in order."""
    return F.array_distinct(F.concat(*(matches(text, p, group) for p in found)))


def refang(text: Column) -> Column:
    """Undoes the usual ways of making an indicator unclickable."""
    for a, b in (("hxxp", "http"), ("[.]", "."), ("[:]", ":"), ("[@]", "@")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def defang(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]"))


def indicators(text: Column) -> Column:
    """The six lists of a chunk: cves, ips, domains, hashes, techniques, actors, as found."""
    return F.struct(
        distinct_matches(text, P.CVE).alias("cves"),
        distinct_matches(text, P.IPV4).alias("ips"),
        distinct_matches(text, P.DOMAIN_PAIR).alias("domains"),
        distinct_matches(text, P.HASH).alias("hashes"),
        distinct_matches(text, P.TECHNIQUE).alias("techniques"),
        distinct_matches(text, P.ACTORS).alias("actors"),
    )


def first_indicator(text: Column) -> Column:
    """kind and value of the first match in the order CVE, address, domain, hash; null if there is none."""
    def one(kind: str, pattern: str, change) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
        return F.when(found.isNotNull(), F.struct(F.lit(kind).alias("kind"), change(found).alias("value")))

    return F.coalesce(one("cve", r"(?i)\bCVE-\d{4}-\d{4,7}\b", F.upper), one("ip", P.IPV4, lambda c: c), one("domain", P.DOMAIN_PAIR, F.lower), one("hash", P.HASH, F.lower))


def query_indicators(text: Column) -> Column:
    """Indicators of a search string: CVE ids in capitals, checked addresses, SHA-256 values, whole domains; repeats stay."""
    return F.struct(
        F.transform(matches(text, r"(?i)\bCVE-\d{4}-\d{4,7}\b"), F.upper).alias("cves"),
        matches(text, P.IPV4_OCTETS).alias("ips"),
        matches(text, P.SHA256).alias("hashes"),
        matches(text, P.DOMAIN_FULL).alias("domains"),
    )


def loose_cve_mentions(text: Column) -> Column:
    """CVE ids whose prefix may be missing, in canonical form; not within longer identifiers. One for each mention, in order."""
    years, numbers = matches(text, P.CVE_LOOSE, 1), matches(text, P.CVE_LOOSE, 2)
    return F.zip_with(years, numbers, lambda y, n: F.concat(F.lit("CVE-"), y, F.lit("-"), n))


def loose_cves(text: Column) -> Column:
    """The ids of loose_cve_mentions, each once."""
    return F.array_distinct(loose_cve_mentions(text))


def normalise_hash(value: Column) -> Column:
    return F.lower(F.trim(value))


def normalise_cve(value: Column) -> Column:
    up = F.upper(F.trim(value))
    return F.when(up.startswith("CVE-"), up).otherwise(F.concat(F.lit("CVE-"), up))


def plausible_hash(value: Column) -> Column:
    """Hexadecimal of a known length, and not one character throughout."""
    return value.rlike("^[a-f0-9]+$") & F.length(value).isin(32, 40, 64, 128) & (F.length(F.replace(value, F.left(value, F.lit(1)), F.lit(""))) > 0)


def hashes(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(matches(text, P.HASH_EXACT), normalise_hash), plausible_hash))


def labelled_hashes(text: Column) -> Column:
    found = F.concat(*(matches(text, p, 1) for p in P.HASH_LABELLED))
    return F.array_distinct(F.filter(F.transform(found, normalise_hash), plausible_hash))


def emails(text: Column) -> Column:
    """Addresses in lower case, defanged ones restored."""
    return F.array_distinct(F.transform(F.concat(matches(text, P.EMAIL), matches(text, P.EMAIL_DEFANGED)), lambda e: F.lower(refang(e))))


def processes(text: Column) -> Column:
    return F.filter(distinct_matches(text, P.PROCESS), lambda p: F.length(p) > 6)


def file_paths(text: Column) -> Column:
    """Paths of 4 to 4096 characters that hold no web or narrative word and no character illegal in both worlds."""
    bad = "|".join(w.replace("[", r"\[").replace("]", r"\]").replace(".", r"\.") for w in P.PATH_STOP_WORDS)
    found = F.transform(distinct_matches(text, *P.FILE_PATHS), lambda x: F.regexp_replace(x, r"^['\"\s]+|['\"\s]+$", ""))
    return F.array_distinct(F.filter(found, lambda p: F.length(p).between(4, 4096) & ~F.lower(p).rlike(bad) & ~p.rlike(r"[\x00]")))


def registry_keys(text: Column) -> Column:
    """Registry keys under a known root (or relative to the two common ones), in the characters that keys have, without commands or double separators."""
    roots = "|".join(P.REGISTRY_ROOTS)

    def good(k: Column) -> Column:
        rooted = k.rlike(rf"(?i)^(?:{roots})\\") & ~k.rlike(P.REGISTRY_ODD)
        return F.length(k).between(5, 1024) & ~k.rlike(P.REGISTRY_STOP) & k.rlike(r"^[A-Za-z0-9\\._\-{}\s:()]+$") & (k.rlike(r"(?i)^(?:\\registry\\machine|software|system)\\") | rooted)

    return F.filter(F.transform(distinct_matches(text, *P.REGISTRY), lambda x: F.trim(x)), good)


def commands(text: Column) -> Column:
    """Command lines of over 10 characters that are not narrative."""
    found = F.transform(distinct_matches(text, *P.COMMANDS), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda c: (F.length(c) > 10) & ~c.rlike(P.COMMAND_NARRATIVE) & ~c.startswith("PowerShell\t")))


def urls(text: Column) -> Column:
    """Web addresses, restored and trimmed of closing punctuation; placeholders and short ones are left out."""
    found = F.transform(F.concat(matches(text, P.URL), matches(text, P.URL_DEFANGED)), lambda u: F.regexp_replace(refang(u), r"[.,;:!?)]+$", ""))
    hosts = "|".join(h.replace(".", r"\.") for h in P.PLACEHOLDER_HOSTS)
    return F.array_distinct(F.filter(found, lambda u: (F.length(u) > 10) & ~F.lower(u).rlike(rf"^https?://(?:www\.)?(?:{hosts})(?:[/:?#]|$)")))


def stix_pattern_values(text: Column) -> Column:
    """kind and value of what pattern lines hold: the first of each kind in each pattern. Serial numbers, hardware addresses and other
    hexadecimal groups have the kind excluded: no indicators, and not to be taken for some elsewhere in the text."""
    bodies = matches(text, P.STIX_BODY, 1)

    def of(body: Column) -> Column:
        plain = [F.struct(F.lit(k).alias("kind"), F.regexp_extract(body, p, 1).alias("value")) for k, p in P.STIX_VALUES.items()]
        grouped = F.transform(F.filter(matches(body, r"=\s*'([^']*:[^']*)'", 1), lambda v: v.rlike(r"^(?:[0-9A-Fa-f]{0,4}:)+[0-9A-Fa-f]{0,4}$")), lambda v: F.struct(F.lit("excluded").alias("kind"), v.alias("value")))
        other = F.concat(*(matches(body, p, 1) for p in (*P.STIX_VALUES.values(),)))
        return F.concat(F.array(*plain), F.filter(grouped, lambda g: ~F.array_contains(other, g["value"])))

    return F.array_distinct(F.filter(F.flatten(F.transform(bodies, of)), lambda v: v["value"] != ""))


def has_indicator(found: Column, tags: Column) -> Column:
    """Whether any list of `found` has entries or a tag says so."""
    lists = [F.size(found[k]) > 0 for k in ("cves", "ips", "domains", "hashes")]
    return lists[0] | lists[1] | lists[2] | lists[3] | F.coalesce(F.exists(tags, lambda t: F.upper(t).isin("IOC", "CVE", "INDICATOR")), F.lit(False))


def search_queries(text: Column, title: Column) -> Column:
    """Up to six search strings: the title, the first 40 words and a few indicators, in order and without repeats."""
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, 40), " ")
    found = F.concat(F.slice(matches(text, P.CVE), 1, 2), F.slice(matches(text, P.IPV4), 1, 2), F.slice(matches(text, P.DOMAIN_PAIR), 1, 2), F.slice(matches(text, P.HASH), 1, 1))
    lead = F.filter(F.array(title, words), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(F.array_distinct(F.concat(lead, found)), 1, 6)
