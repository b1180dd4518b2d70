"""The document-to-artifact plan: detect, parse, extract, classify, heal, in one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, indicators, text
from ..operators.relational import completeness, heal, merge_lists, smart_list

LISTS = ["cves", "ips", "domains", "hashes", "urls", "emails", "techniques", "motivations"]


def artifacts(documents: DataFrame) -> DataFrame:
    """One row per document with all extracted fields, healed and rated for completeness.

    Everything is a column expression over one scan: no shuffle, no Python worker. A null text counts as empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = indicators.indicators(t)
    out = documents.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2(t.cast("binary"), 256).alias("content_sha256"), (F.length("text") > 0).alias("has_text"),
        classify.detect_kind(t, F.lit(""))["kind"].alias("kind"), F.split_part(t, F.lit("\n"), F.lit(1)).alias("title"),
        found["cves"].alias("cves"), found["ips"].alias("ips"), found["domains"].alias("domains"), indicators.hashes(t).alias("hashes"),
        indicators.urls(t).alias("urls"), indicators.emails(t).alias("emails"), classify.explicit_techniques(t).alias("techniques"),
        classify.motivations(t).alias("motivations"), classify.high_tension(t).alias("high_tension_event"), classify.cyber_related(t).alias("cyber_related"),
        classify.zero_day(t).alias("zero_day_mention"), classify.actively_exploited(t).alias("active_exploitation"),
        classify.geography(t)["affects_singapore"].alias("affects_singapore"), classify.geography(t)["affects_asean"].alias("affects_asean"),
        classify.relevance(t).alias("relevance"), text.estimate_tokens(t).alias("tokens"),
    )
    return completeness(heal(out, strings=["title"], lists=LISTS), ["title", *LISTS])


# Fields of the final record by type, with the names under which readers expect them.
TEXTS = ("title", "url", "source_url", "summary", "markdown", "regional_context", "escalation_potential", "stakeholder_interests")
FLAGS = ("zero_day_mention", "active_exploitation_mentioned", "patch_availability", "affects_singapore", "affects_asean", "high_tension_event")
NAME_LISTS = ("threat_actors", "malware", "affected_products", "mitre_ttps", "victims", "sectors", "possible_motivations")
PLAIN_LISTS = ("cve_vulns", "recommendations_and_mitigations", "underlying_causes", "strategic_implications")
CVE = "struct<vulnerabilities:array<struct<id:string,products:array<string>>>,total_count:int,patch_availability:boolean,active_exploitation:boolean,highest_severity:string,highest_cvss:double>"
IOCS = "struct<urls:array<string>,domains:array<string>,hashes:array<string>,ips:array<string>>"


def assembled(rows: DataFrame, key: str) -> DataFrame:
    """The final record: key and all fields, those that rows lack or leave null at their default. Names are merged by their variants (the
    longest form at the first place), also the products inside each vulnerability; the source is the address, a missing title the
    address, and what is not rated counts as related to security."""
    empty = F.array().cast("array<string>")
    has = lambda c: F.col(c) if c in rows.columns else None
    given = lambda c, default: default if has(c) is None else F.coalesce(has(c), default)
    flag = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "yes", "1", "on"), F.lit(False)) if c in rows.columns else F.lit(False)
    url = given("url", F.lit(""))
    texts = {c: given(c, F.lit("")).cast("string") for c in TEXTS}
    texts |= {"url": url, "source_url": given("source_url", url), "title": F.coalesce(F.nullif(F.trim(texts["title"]), F.lit("")), url)}
    lists = {c: smart_list(given(c, empty)) for c in NAME_LISTS} | {c: merge_lists(given(c, empty), normalise=F.trim) for c in PLAIN_LISTS}
    none = F.from_json(F.lit('{"vulnerabilities":[],"total_count":0,"patch_availability":false,"active_exploitation":false,"highest_severity":"UNKNOWN","highest_cvss":0.0}'), CVE)
    cve = given("cve", none)
    cve = cve.withField("vulnerabilities", F.transform(F.coalesce(cve["vulnerabilities"], F.array().cast("array<struct<id:string,products:array<string>>>")), lambda v: v.withField("products", smart_list(F.coalesce(v["products"], empty)))))
    iocs = given("iocs", F.from_json(F.lit('{"urls":[],"domains":[],"hashes":[],"ips":[]}'), IOCS))
    other = {"cve": cve, "iocs": iocs, "cve_severity": given("cve_severity", F.lit("{}")), "cyber_related": F.lit(True) if has("cyber_related") is None else F.coalesce(has("cyber_related"), F.lit(True))}
    every = texts | {c: flag(c) for c in FLAGS} | lists | other
    return rows.select(key, *(v.alias(c) for c, v in every.items()))
