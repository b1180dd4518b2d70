"""Entity spans, overlap rules and token tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

_NAMES = lambda names: r"(?i)\b(" + "|".join(map(re.escape, names)) + r")\b"
SPAN_PATTERNS = {
    "CVE": r"(?i)\b(CVE-\d{4}-\d{4,7})\b",
    "IP": r"(?:\bIP[: ]+)?\b((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})\b",
    "DOMAIN": r"\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[A-Za-z]{2,63})\b",
    "MALWARE": _NAMES(P.MALWARE_NAMES),
    "THREAT_ACTOR": _NAMES(P.ACTOR_NAMES),
}
_COMPILED = {label: re.compile(p) for label, p in SPAN_PATTERNS.items()}
_OPEN, _CLOSE = "([{'\"", "`)]}',.;:"
Span = tuple[int, int, str]


def find_spans(text: str | None) -> list[Span]:
    """Start, end (code points) and label of all entities; of overlapping ones of a label the longer stays, else the earlier."""
    out: list[Span] = []
    for label, pattern in _COMPILED.items():
        kept: list[Span] = []
        for m in pattern.finditer(text or ""):
            low, high = m.span(1)
            while low < high and text[low] in _OPEN:
                low += 1
            while high > low and text[high - 1] in _CLOSE:
                high -= 1
            if low == high:
                continue
            hit = next((i for i, (a, b, _) in enumerate(kept) if low < b and a < high), None)
            if hit is None:
                kept.append((low, high, label))
            elif high - low > kept[hit][1] - kept[hit][0]:
                kept[hit] = (low, high, label)
        out += kept
    return sorted(out)


def without_overlaps(spans: list[Span]) -> list[Span]:
    """By start, each span that begins at or after the end of the last one kept."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: s[0]):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def tag_tokens(text: str | None) -> list[tuple[str, str]]:
    """Blank-separated tokens with B-, I- or O tags: of tokens inside a span, the one that starts it begins it."""
    spans = without_overlaps(find_spans(text))
    out = []
    for m in re.finditer(r"\S+", text or ""):
        tag = "O"
        for low, high, label in spans:
            if m.start() >= low and m.end() <= high:
                tag = ("B-" if m.start() == low else "I-") + label
                break
        out.append((m[0], tag))
    return out


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, start, stop, label, value of the entities of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b, label, t[a:b]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, label in find_spans(t)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, list(zip(*rows, strict=True)) or [[]] * 5, kinds)), names=["doc_id", "start", "stop", "label", "value"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start int, stop int, label string, value string")


def bio_sentences(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """Sentences of tagged lines (token, blank, tag): runs of lines between empty ones, within each group."""
    own = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("sentence", F.sum(F.when(F.trim(line) == "", 1).otherwise(0)).over(own))
    fields = F.split(F.trim(line), r"\s+")
    return marked.filter(F.size(fields) == 2).select(group, "sentence", F.col(order).alias("line_no"), fields[0].alias("token"), fields[1].alias("tag"))


def tag_ids(tags: DataFrame, tag: str) -> DataFrame:
    """A number from 0 for each tag, in order; the number of tags is small and fixed by the label set."""
    return tags.select(tag).distinct().withColumn("tag_id", F.row_number().over(Window.orderBy(tag)) - 1)


def align_labels(word_ids: list[int | None], labels: list[int]) -> list[int]:
    """A label for each sub-token: the word's on its first one, -100 on others and on special tokens."""
    out, last = [], None
    for word in word_ids:
        out.append(-100 if word is None or word == last else labels[word])
        last = word
    return out
