"""Web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LINK_WORDS, TRACKING_PARAMETERS

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def host(url: Column) -> Column:
    """Host and port in lower case, without a leading www."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """One form for equal addresses: web scheme, lower-case host without www and default port, no closing slash, parameters
    sorted, without those that track or are empty; path, values and fragment keep their case. Null stays null."""
    scheme = F.lower(_part(url, 1))
    scheme = F.when(scheme.isin("http", "https"), scheme).otherwise("https")
    name = host(url)
    name = F.when(scheme == "https", F.regexp_replace(name, ":443$", "")).otherwise(F.regexp_replace(name, ":80$", ""))
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+$") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING_PARAMETERS))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda s: s["p"]), "&")
    fragment = _part(url, 5)
    return F.concat(scheme, F.lit("://"), name, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def clean_link(url: Column, words: tuple[str, ...] = LINK_WORDS) -> Column:
    """Without the parameters whose name contains one of the words."""
    kept = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike("|".join(words)))
    query = F.array_join(kept, "&")
    base = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(_part(url, 5) != "", F.concat(F.lit("#"), _part(url, 5))).otherwise(""))
