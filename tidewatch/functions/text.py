"""Text measures, identifiers, cleaning and light formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CATEGORIES

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the name space of addresses in name-based UUIDs


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """Mean of 1.3 per word and one per 3.5 characters, of the text with single blanks."""
    t = collapse(text)
    return F.floor((F.size(words(text)) * 1.3 + F.length(t) / 3.5) / 2).cast("long")


def input_strategy(text: Column, most: int = 1000) -> Column:
    """How a text of this size is given to a model: whole, cut, or in scored chunks."""
    n = estimate_tokens(text)
    return F.when(n <= most, "full").when(n <= 1.5 * most, "truncate").otherwise("chunk")


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("md5:"), F.md5(F.left(text, F.lit(512)).cast("binary")))


def uuid5(name: Column) -> Column:
    """The name-based UUID of a string in the name space of addresses."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def point_id(name: Column) -> Column:
    """Digits stay a number, a UUID stays itself in lower case, anything else becomes its uuid5."""
    number = F.regexp_replace(name, "^0+(?=.)", "")
    return F.when(name.rlike(r"^\d+$"), number).when(name.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(name)).otherwise(uuid5(name))


def iso_seconds(text: Column) -> Column:
    """Unix seconds of an ISO timestamp; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def snippet(text: Column, literal: Column, around: int = 50, most: int = 200) -> Column:
    """The first occurrence of a literal with some characters on both sides; null if there is none."""
    at = F.instr(text, literal)
    low = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.left(F.substr(text, low, at - low + F.length(literal) + around), F.lit(most)))


def context_category(heading: Column, text: Column) -> Column:
    t = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text))
    return F.coalesce(*(F.when(t.rlike("|".join(words)), name) for name, words in CATEGORIES), F.lit("body"))


def strip_html(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags, common entities restored, single blanks."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapse(t)


def html_title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def clean_pdf_text(text: Column) -> Column:
    """Blanks collapse first, so the later rules for line ends find none; page markers and joined hyphens go."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(text), r"--- Page \d+ ---", ""), r"(\w)- (\w)", "$1$2"))


def post_process_markdown(text: Column) -> Column:
    """At most two blank lines, single blanks, no empty headers or list items."""
    t = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^#{1,6} ?$", "")
    return F.trim(F.regexp_replace(t, r"(?m)^[-*] ?$", ""))


def clamp_headers(text: Column) -> Column:
    """Header levels that never rise by more than one: a fold over the lines."""
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("lines"))

    def step(state: Column, line: Column) -> Column:
        marks = F.length(F.regexp_extract(F.trim(line), r"^(#{1,6})", 1))
        level = F.least(marks, state["level"] + 1)
        out = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(F.regexp_replace(F.trim(line), r"^#{1,6}\s*", "")))
        return F.struct(F.when(marks > 0, level).otherwise(state["level"]).alias("level"), F.concat(state["lines"], F.array(F.when(marks > 0, out).otherwise(line))).alias("lines"))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["lines"]), "\n")


def text_to_markdown(text: Column) -> Column:
    """Lines of capitals and short title lines become headers, bullets and numbers list items, addresses links."""

    def line(raw: Column) -> Column:
        t = F.regexp_replace(raw, r"^\s+|\s+$", "")
        shout = (F.length(t) > 5) & (F.upper(t) == t) & (F.lower(t) != t) & ~t.rlike("[.,!?]")
        return (
            F.when(t == "", "")
            .when(shout, F.concat(F.lit("## "), F.initcap(t)))
            .when(t.rlike(r"^[A-Z][A-Za-z\s]+:?\s*$") & (F.length(t) < 50), F.concat(F.lit("### "), t))
            .when(t.rlike(r"^[-*•]\s+"), F.concat(F.lit("- "), F.regexp_replace(t, r"^[-*•]\s+", "")))
            .when(t.rlike(r"^\d+[.)]\s+"), F.concat(F.lit("1. "), F.regexp_replace(t, r"^\d+[.)]\s+", "")))
            .otherwise(F.regexp_replace(t, r"(https?://[^\s]+)", "[$1]($1)"))
        )

    joined = F.array_join(F.transform(F.split(text, "\n"), line), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def page_range(spec: Column) -> Column:
    """Page numbers of a list such as 1-3,5."""
    def one(p: Column) -> Column:
        low, high = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int")
        return F.when(low.isNull(), F.array().cast("array<int>")).when(high.isNull(), F.array(low)).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), one))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def smart_key(name: Column) -> Column:
    """What variants of a name share: lower case, with single blanks for underscores, hyphens, dots and blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"[_\-.\s]+", " "))
