"""Web addresses and host names as reports write them: whole, without a scheme, or made unclickable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .indicators import matches
from .network import normalise_domain, valid_domain
from .urls import canonical_url


def restored(url: Column) -> Column:
    u = F.regexp_replace(url, "(?i)hxxp", "http")
    return F.replace(F.replace(u, F.lit("[:]"), F.lit(":")), F.lit("[.]"), F.lit("."))


def ioc_url(url: Column) -> Column:
    """Trimmed, with a scheme, without closing punctuation; else as written."""
    u = F.trim(url)
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(u, r"[.,;:!?]+$", "")


def _address(url: Column) -> Column:
    return url.rlike(r"^https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}/[0-9]{1,2}")


def url_candidates(text: Column, valid) -> Column:
    """Addresses that any of the candidate patterns finds, restored, with a scheme where a path, a query or a common ending shows
    what they are, without closing punctuation; no placeholders, no address blocks, none of ten characters or fewer; in canonical form,
    if `valid` accepts it; sorted and without repeats."""
    found = F.concat(*(matches(text, p) for p in P.URL_CANDIDATES))

    def clean(raw: Column) -> Column:
        u = restored(raw)
        bare = ~F.lower(u).rlike("^https?://") & (F.contains(u, F.lit(".")) | F.contains(raw, F.lit("[")))
        looks = F.contains(u, F.lit("/")) | F.contains(u, F.lit("?")) | F.lower(u).rlike(r"\.(?:com|org|net|gov)")
        u = F.when(bare & looks, F.concat(F.lit("https://"), u)).otherwise(u)
        return F.regexp_replace(F.regexp_replace(u, r"[.,;:!?)]+$", ""), r"(https?:)//+", "$1//")

    def good(u: Column) -> Column:
        return (F.length(u) > 10) & ~F.lower(u).rlike(r"example\.com|test\.com|localhost") & ~_address(u)

    canonical = F.transform(F.filter(F.transform(found, clean), good), canonical_url)
    return F.array_sort(F.array_distinct(F.filter(canonical, valid)))


def legacy_urls(text: Column, valid, accept) -> Column:
    """Addresses by the sixteen older patterns (any case), restored: no mail addresses, address blocks or short file names; with a
    scheme where they have none; if `valid` and `accept` (which sees the text too) say so. Case, path and parameters stay."""
    found = F.concat(*(matches(text, p) for p in P.LEGACY_URLS))
    marks = r"[.,;:!?()\[\]{}\"' \t\n\r]"

    def trimmed(raw: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(raw, rf"^{marks}+|{marks}+$", ""), r"[,'\"]+$", "")

    def wanted(u: Column) -> Column:
        mail = F.contains(u, F.lit("@")) & ~u.rlike("^https?://")
        bare = F.regexp_replace(u, "https?://", "")
        return ~(mail | _address(u) | u.rlike(r"/[0-9]{1,2}[\]'\s]*$") | bare.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}/[0-9]{1,2}$"))

    def named(u: Column) -> Column:
        part = F.split_part(F.split_part(u, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
        labels = F.split(part, r"\.")
        file = (F.size(labels) == 2) & (F.length(labels[0]) < 15) & F.lower(F.element_at(labels, -1)).isin(*P.PAGE_SUFFIXES)
        fits = (F.size(labels) >= 2) & (F.length(F.element_at(labels, -1)) >= 2)
        bare = ~u.rlike("^https?://") & F.contains(u, F.lit("."))
        return F.when(bare & fits & file, F.lit(None).cast("string")).when(bare & fits, F.concat(F.lit("https://"), u)).otherwise(u)

    urls = F.filter(F.transform(F.filter(F.transform(found, trimmed), wanted), lambda u: named(restored(u))), lambda u: u.isNotNull())
    good = F.filter(urls, lambda u: valid(u) & F.contains(F.regexp_extract(u, r"^https?://([^/?#]*)", 1), F.lit(".")) & accept(u, text))
    return F.array_sort(F.array_distinct(F.transform(good, ioc_url)))


def legacy_domains(text: Column, accept) -> Column:
    """Host names by the four older patterns, which want nothing but blanks behind them to the end of the text; no version numbers,
    files or abbreviations; if they are valid and `accept` (on the name as written, and the text) says so."""
    found = F.concat(*(matches(text, p) for p in P.LEGACY_DOMAINS))
    marks = r"[.,;:!?()\[\]{}\"' \t\n\r]"
    written = F.transform(found, lambda d: F.regexp_replace(d, rf"^{marks}+|{marks}+$", ""))

    def good(raw: Column) -> Column:
        d = F.replace(raw, F.lit("[.]"), F.lit("."))
        odd = d.rlike(r"^\d+\.\d+$") | d.rlike(r"\.(?:exe|dll|pdf|doc)$") | F.lower(d).isin(*P.NO_HOSTS)
        return ~odd & valid_domain(d) & (F.length(d) > 3) & accept(raw, text)

    return F.array_sort(F.array_distinct(F.transform(F.filter(written, good), lambda d: normalise_domain(F.replace(d, F.lit("[.]"), F.lit("."))))))


def _meta(html: Column, names: str) -> Column:
    """Contents of all meta tags whose name or property is one of these, in order; those without content are left out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    mine = F.filter(tags, lambda t: t.rlike(rf"(?i)\s(?:name|property)\s*=\s*[\"']?(?:{names})[\"'\s/>]"))
    values = F.transform(mine, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?is)\scontent\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(t, r"(?is)\scontent\s*=\s*'([^']*)'", 1)))
    return F.filter(values, lambda v: v != "")


def page_metadata(html: Column) -> Column:
    """title, author, description, published_date and site_name: from the title and meta tags (the last one counts), and where these say
    nothing from the first block of linked data that does."""
    last = lambda names: F.get(F.reverse(_meta(html, names)), F.lit(0))
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def linked(*paths: str) -> Column:
        values = F.transform(blocks, lambda b: F.coalesce(*(F.get_json_object(b, p) for p in paths)))
        found = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
        return F.get(found, F.lit(0))

    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.struct(
        F.coalesce(title, linked("$.headline")).alias("title"),
        F.coalesce(last("author|article:author"), linked("$.author.name", "$.author")).alias("author"),
        last("description|og:description").alias("description"),
        F.coalesce(last("published_time|article:published_time|article:published"), linked("$.datePublished")).alias("published_date"),
        last("og:site_name").alias("site_name"),
    )
