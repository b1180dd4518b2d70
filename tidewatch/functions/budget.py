"""Texts cut to a budget of tokens, by what matters in them, and the rules for text of printed pages.

A cut depends on all lines taken before, so the cuts are plain functions on a text, which run in Arrow workers (`truncated`,
`prepared`); the other rules are column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import collapse

_PRIORITY = re.compile(P.PRIORITY_LINE)
_RELEVANCE = [(score, [re.compile(p) for p in found]) for score, found in P.RELEVANCE]
_FACTS = {name: re.compile(p) for name, p in P.SUMMARY_FACTS.items()}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: str) -> int:
    """As text.estimate_tokens."""
    t = " ".join(text.split())
    return int((len(t.split()) * 1.3 + len(t) / 3.5) / 2)


def relevance(text: str) -> int:
    """As classify.relevance."""
    return next((score for score, found in _RELEVANCE if any(p.search(text) for p in found)), 1)


def cut(text: str, most: int) -> str:
    """The first part of a text, by its share of tokens less five percent, back to the last blank if that is near."""
    n = tokens(text)
    if n <= most:
        return text
    size = int(len(text) * (most / n) * 0.95)
    part = text[:size]
    blank = part.rfind(" ")
    return part[:blank] if blank > size * 0.8 else part


def structured_cut(text: str, most: int) -> str:
    """Lines that are headers or hold an id, an actor, an address, a hash or a link first, then the others, each kind up to the first
    line that does not fit; with over 50 tokens left, of an other line that did not fit its own first part."""
    lines = [x for line in text.split("\n") if (x := line.strip())]
    strong = [bool(x.isupper() or _PRIORITY.search(x)) for x in lines]
    out, used = [], 0
    for wanted in (True, False):
        for line in (x for x, s in zip(lines, strong, strict=True) if s == wanted):
            n = tokens(line)
            if used + n > most:
                part = cut(line, most - used) if not wanted and most - used > 50 else ""
                out += [part + "..."] if part.strip() else []
                break
            out.append(line)
            used += n
    return "\n".join(out)


def truncate(text: str, most: int = 3000, structured: bool = True) -> str:
    """The text if it is within the budget or blank, else its structured or simple cut."""
    if not text.strip() or tokens(text) <= most:
        return text
    return structured_cut(text, most) if structured else cut(text, most)


def context_summary(text: str, most: int = 500) -> str:
    """A text of up to twice the budget as it is; of a longer one its title, the lists of SUMMARY_FACTS (sorted, without repeats), and an
    excerpt in what is left of the budget if that is over 100 tokens."""
    if tokens(text) <= 2 * most:
        return text
    first, out = text.split("\n")[0].strip(), []
    if len(first) < 200 and any(c.isupper() for c in first[:20]):
        out.append(f"Title: {first}")
    for name, pattern in _FACTS.items():
        if found := sorted({m[0] for m in pattern.finditer(text)}):
            out.append(f"{name}: {', '.join(found)}")
    left = most - tokens("\n".join(out))
    return "\n".join([*out, *([f"Content excerpt: {truncate(text, left)}"] if left > 100 else [])])


def paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs put together while their tokens stay within the budget; a longer paragraph goes by sentences."""
    out, now = [], ""

    def add(part: str, joint: str) -> None:
        nonlocal now
        both = now + joint + part if now else part
        if now and tokens(both) > most:
            out.append(now)
            now = part
        else:
            now = both

    for block in re.split(r"\n\s*\n", text):
        if not (block := block.strip()):
            continue
        if tokens(block) <= most:
            add(block, "\n\n")
        else:
            for sentence in block.split(". "):
                if sentence.strip():
                    add(sentence.strip().rstrip(".") + ".", " ")
    return [*out, now] if now else out


def relevant_text(chunks: list[str], least: int = 6, most: int = 3500) -> str:
    """The chunks rated relevant enough, put together; over the budget a summary of them; a fixed sentence if there are none."""
    kept = [c for c in chunks if relevance(c) >= least]
    joined = P.CHUNK_SEPARATOR.join(kept)
    return P.NO_RELEVANT if not kept else joined if tokens(joined) <= most else context_summary(joined, most)


def prepare(text: str | None, most: int, least: int = 6) -> tuple:
    """text, strategy, tokens before and after, chunks and relevant chunks: whole within the budget, cut up to half as much again, else
    in chunks of half the budget of which the relevant ones stay."""
    if not (text or "").strip():
        return "", "empty", 0, 0, 0, 0
    n = tokens(text)
    if n <= most:
        return text, "full", n, n, 1, 1
    if n <= 1.5 * most:
        out = structured_cut(text, most)
        return out, "truncated", n, tokens(out), 1, 1
    chunks = paragraphs(text, most // 2)
    out = relevant_text(chunks, least, most)
    return out, "chunked_classified_summarized", n, tokens(out), len(chunks), sum(relevance(c) >= least for c in chunks)


_PREPARED = "text string, processing_strategy string, original_tokens long, processed_tokens long, chunks int, relevant_chunks int"


def prepared(text: Column, most: int, least: int = 6) -> Column:
    """`prepare` of each text, as a struct. The threshold is 5 for the agents that summarise and rate, else 6."""

    @F.pandas_udf(_PREPARED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prepare(t, most, least) for t in texts], columns=[c.split()[0] for c in _PREPARED.split(", ")])

    return run(text)


def truncated(text: Column, most: int = 3000, structured: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncate(t, most, structured))

    return run(text)


def summarised(text: Column, most: int = 500) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else context_summary(t, most))

    return run(text)


def content_chunks(text: Column, size: int = 40000, most: int = 5) -> Column:
    """The first pieces of a fixed number of characters."""
    starts = F.slice(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)), 1, most)
    return F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(size)))


def cyber_input(title: Column, summary: Column, cves: Column, lists: dict[str, Column], techniques: Column, text: Column) -> Column:
    """What the relevance rule reads: title, summary, five CVE ids, counts of indicators and three techniques, as far as there are any; else
    the first 5000 characters of the text."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    counts = F.array_join(F.array(*(F.when(F.size(v) > 0, F.concat(F.size(v).cast("string"), F.lit(f" {k}"))) for k, v in lists.items())), ", ")
    parts = (
        F.concat(F.lit("Title: "), some(title)), F.concat(F.lit("Summary: "), some(summary)),
        F.when(F.size(cves) > 0, F.concat(F.lit("CVEs mentioned: "), F.array_join(F.slice(cves, 1, 5), ", "))),
        F.concat(F.lit("IOCs found: "), F.nullif(counts, F.lit(""))),
        F.when(F.size(techniques) > 0, F.concat(F.lit("MITRE TTPs: "), F.array_join(F.slice(techniques, 1, 3), ", "))),
    )
    whole = F.concat_ws("\n\n", *parts)
    short = F.when(F.length(text) > 5000, F.concat(F.left(text, F.lit(5000)), F.lit("... [truncated for analysis]"))).otherwise(text)
    return F.when(whole != "", whole).otherwise(F.coalesce(short, F.lit("")))


def pdf_page_markdown(text: Column) -> Column:
    """Markdown of a page's text: headers by their look, bullets and numbers as list items, other lines as they are."""

    def line(raw: Column) -> Column:
        t = _strip(raw)
        up = F.upper(t)
        header = (F.length(t) <= 100) & up.rlike(P.PDF_HEADER)
        shout = (up == t) & (F.lower(t) != t)
        level = F.when(up.rlike("EXECUTIVE|SUMMARY|CONCLUSION"), "## ").when(shout & (F.length(t) < 60), "### ").otherwise("#### ")
        return (
            F.when(t == "", "")
            .when(header, F.concat(level, t))
            .when(t.rlike(r"^[•·▪▫◦‣⁃\-*]"), F.concat(F.lit("- "), F.regexp_replace(t, r"^[•·▪▫◦‣⁃\-*]\s*", "")))
            .when(t.rlike(r"^\d+[.)]\s+"), F.concat(F.lit("1. "), F.regexp_replace(t, r"^\d+[.)]\s+", "")))
            .otherwise(t)
        )

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def pdf_document_text(pages: Column) -> Column:
    """Texts of pages put together behind their numbers, then cleaned: at most one empty line, single blanks, no page marks."""
    numbered = F.transform(pages, lambda p, i: F.concat(F.lit("\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p))
    t = F.regexp_replace(F.array_join(numbered, "\n"), r"\n\s*\n\s*\n", "\n\n")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n--- Page \d+ ---\n", "\n\n"))


def clean_pdf_markdown(text: Column) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?m)^#+\s*$", ""))


def decoded(content: Column) -> Column:
    """Text of base64 content: what is no UTF-8 is left out; null for what is no base64."""
    raw = F.try_to_binary(content, F.lit("base64"))
    return F.replace(F.decode(raw, "UTF-8"), F.lit("\ufffd"), F.lit(""))


def parsed_text(kind: Column, content: Column, parsers: dict, fallback) -> Column:
    """The text of a document by the parser of its kind; where that gives nothing, and for other kinds, the fallback."""
    own = F.lit(None).cast("string")
    for name, parser in parsers.items():
        own = F.when(kind == name, parser(content)).otherwise(own)
    return F.coalesce(F.nullif(_strip(own), F.lit("")), fallback(content))


def recommendations(sentences: Column) -> Column:
    """Sentences that tell the reader to do something, in the words that such texts use."""
    return F.filter(F.transform(sentences, collapse), lambda s: s.rlike(P.ADVICE))
