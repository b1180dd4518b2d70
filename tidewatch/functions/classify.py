"""Rule-based classifiers of text."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .evidence import evidence
from .indicators import matches


def any_match(text: Column, found: tuple[str, ...]) -> Column:
    """Whether any pattern occurs. One with a gap (.*) is tried only on texts that hold what stands on both sides of it, since a gap makes
    every start look to the end of its line."""

    def one(pattern: str) -> Column:
        sides = pattern.split(".*")
        return reduce(and_, (text.rlike(p) for p in (*sides, pattern))) if len(sides) > 1 else text.rlike(pattern)

    return reduce(or_, map(one, found))


def high_tension(text: Column) -> Column:
    return any_match(F.lower(text), P.TENSION)


def motivations(text: Column) -> Column:
    """The labels whose patterns occur, in fixed order; `unknown` if none does."""
    low = F.lower(text)
    labels = F.filter(F.array(*(F.when(any_match(low, p), k) for k, p in P.MOTIVATIONS.items())), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unknown")))


def relevance(text: Column) -> Column:
    """8, 6 or 4 by the strongest kind of pattern that occurs, else 1."""
    out = F.lit(1)
    for score, found in reversed(P.RELEVANCE):
        out = F.when(any_match(text, found), score).otherwise(out)
    return out


def key_elements(text: Column) -> Column:
    """Some matches of each strong and medium pattern, sorted."""
    parts = [F.slice(matches(text, p), 1, 3 if score == 8 else 2) for score, found in P.RELEVANCE[:2] for p in found]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def motivation_evidence(text: Column) -> Column:
    """For each label found, the passages around its patterns (see evidence.evidence): label and found."""
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), evidence(text, p).alias("found")) for k, p in P.MOTIVATIONS.items())), lambda x: F.size(x["found"]) > 0)


def tension_evidence(text: Column) -> Column:
    """Up to five passages around the patterns of tension."""
    return F.slice(evidence(text, P.TENSION), 1, 5)


def cyber_related(text: Column) -> Column:
    return text.rlike(P.CYBER_WORDS)


def zero_day(text: Column) -> Column:
    return text.rlike(P.ZERO_DAY)


def actively_exploited(text: Column) -> Column:
    return text.rlike(P.EXPLOITED)


def geography(text: Column) -> Column:
    """Whether Singapore, and whether the region (which it implies), is named."""
    here = text.rlike(P.GEO_SINGAPORE)
    return F.struct(here.alias("affects_singapore"), (here | text.rlike(P.GEO_ASEAN)).alias("affects_asean"))


def explicit_techniques(text: Column) -> Column:
    """Technique ids that have a word of context within 50 characters before or after, sorted. Each id is looked at by itself, so ids
    close together share their context. Ids in paths, in versions or behind a product's name are no techniques."""
    before = "|".join(f"{w}(?s:.){{0,{50 - len(w)}}}" for w in P.TECHNIQUE_WORDS)
    after = "|".join(f"(?s:.){{0,{50 - len(w)}}}{w}" for w in P.TECHNIQUE_WORDS)
    name = r"T\d{4}(?:\.\d{3})?"
    one = rf"(?<!{P.TECHNIQUE_NOT_BEFORE})\b{name}\b(?!{P.TECHNIQUE_NOT_AFTER})"
    near = rf"{one}(?:(?=(?i:{after}))|(?<=(?i:{before}){name}))"  # what stands around is looked at where an id is found
    found = F.array_sort(F.array_distinct(matches(text, near)))
    return F.when(text.rlike(P.TECHNIQUE), found).otherwise(F.array().cast("array<string>"))


def best_techniques(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key and technique: the greatest confidence (high, medium, low), explicit before behavioural, then the first
    evidence. The best row comes from an aggregation with partial results, so a hot key is no single task's."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.lower("confidence")), F.lit(9))
    rank = F.when(rank == 0, 9).otherwise(rank)
    order = F.struct(rank.alias("rank"), (F.col("source") != "explicit").alias("behavioural"), "evidence", "confidence", "source")
    best = rows.groupBy(key, "technique").agg(F.min(order).alias("b"), F.count("*").alias("mentions"))
    return best.select(key, "technique", "b.confidence", "b.source", "b.evidence", "mentions")


def behaviour_techniques(text: Column) -> Column:
    """Technique ids that words in the text point to, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.contains(low, F.lit(w)), t) for w, t in P.BEHAVIOURS)), lambda x: x.isNotNull())))


def summary_facts(text: Column) -> Column:
    """The lists of a short summary, each sorted: name and values."""
    return F.array(*(F.struct(F.lit(k).alias("name"), F.array_sort(F.array_distinct(matches(text, p))).alias("found")) for k, p in P.SUMMARY_FACTS.items()))


def severity(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("UNKNOWN")


def severity_rank(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL"))), name), F.lit(0))


def detect_kind(text: Column, mime: Column) -> Column:
    """Scores of each content type, the best of them and its score; ties go to the first in the order given."""
    head, low = F.left(text, F.lit(2048)), F.lower(F.coalesce(mime, F.lit("")))

    def weight(kind: str, of: Column) -> Column:
        w, found = P.KIND_PATTERNS[kind]
        return F.least(F.lit(1.0), F.round(sum((F.when(of.rlike(p), w).otherwise(0.0) for p in found), F.lit(0.0)), 2))

    is_json = F.when(F.trim(text).rlike(r"^[\[{]"), F.try_parse_json(text).isNotNull()).otherwise(False)
    stix, misp, rss = weight("STIX", text), weight("MISP", head), weight("RSS", head)
    html = F.when(low.contains("html"), 0.7).otherwise(weight("HTML", head))
    pdf = F.when(low.contains("pdf") | text.startswith("%PDF"), 0.9).otherwise(0.0)
    json = F.when(low.contains("json"), 0.5).otherwise(0.0) + F.when(is_json, F.when((stix > 0.3) | (misp > 0.3), -0.1).otherwise(0.3)).otherwise(0.0)
    scores = {"STIX": stix, "MISP": misp, "RSS": rss, "HTML": html, "PDF": pdf, "JSON": F.greatest(F.lit(0.0), F.least(F.lit(1.0), json)), "TEXT": F.lit(0.1)}
    table = F.array(*(F.struct(v.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, v) in enumerate(scores.items())))
    best = F.array_max(table)
    rss_first = low.contains("html") & (rss > 0.3) & (rss < html)
    kind = F.when(rss_first, "RSS").when(best["score"] < 0.2, "TEXT").otherwise(best["kind"])
    return F.struct(kind.alias("kind"), F.round(F.when(rss_first, rss).otherwise(best["score"]), 2).alias("score"))
