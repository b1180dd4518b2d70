"""Passages that support a finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def evidence(text: Column, found: tuple[str, ...], most: int = 3, around: int = 50, size: int = 240) -> Column:
    """Passages around the matches of patterns in the lower-cased text, some characters on both sides, with single blanks.

    Of each pattern the first `most` matches count. The total is soft: a pattern ends once that many passages are there, but the
    next pattern still adds one."""
    low = F.lower(text)
    out = F.array().cast("array<string>")
    for pattern in found:
        # places of the matches: the text is split at them, so each part's length and the match's own give the next place
        parts, hits = F.split(low, pattern), F.slice(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), 1, most)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spots"))
        lengths = F.zip_with(F.slice(parts, 1, most), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("size")))

        def step(state: Column, x: Column) -> Column:
            a = state["at"] + x["gap"]
            return F.struct((a + x["size"]).alias("at"), F.concat(state["spots"], F.array(F.struct(a.alias("a"), (a + x["size"]).alias("b")))).alias("spots"))

        spots = F.aggregate(F.filter(lengths, lambda x: x["size"].isNotNull() & x["gap"].isNotNull()), start, step, lambda s: s["spots"])
        mine = F.transform(spots, lambda s: _cut(_squeezed(F.substr(text, F.greatest(s["a"] - around, F.lit(0)) + 1, F.least(s["b"] + around, F.length(text)) - F.greatest(s["a"] - around, F.lit(0)))), size))
        room = F.greatest(F.lit(1), F.lit(most) - F.size(out))
        out = F.concat(out, F.slice(mine, F.lit(1), room))
    return out


def around_name(text: Column, name: Column, around: int = 50, size: int = 200) -> Column:
    """The first occurrence of a name, in any case, with some characters on both sides, after the name itself; null without one."""
    at = F.instr(F.lower(text), F.lower(name))
    low = F.greatest(at - around, F.lit(1))
    passage = _squeezed(F.substr(text, low, at - low + F.length(name) + around))
    return F.when(at > 0, F.concat(F.lit("[Entity: "), name, F.lit("] "), _cut(passage, size)))
