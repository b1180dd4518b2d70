"""Near-duplicate line removal by a deletion-neighbourhood join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, free, stage_table

#: Segments by which candidate lines are narrowed down to the part that differs.
SEGMENTS = 16


def _masked(c: str, q: str, segments: int) -> str:
    """Hash of a line without segment q, in the class of pairs whose shorter line has c characters."""
    low, high = f"int({q} * {c} div {segments})", f"int(({q} + 1) * {c} div {segments})"
    return f"xxhash64({c}, {q}, left(line, {low}), right(line, {c} - {high}))"


def _through_sieve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose h1 may be among those of wanted. The sieve is a table of SIEVE_BITS / 64 words at most, so it can be broadcast
    whatever the input; when it fills up it only lets more rows through."""
    bit = f"pmod(h1, {SIEVE_BITS})"
    words = wanted.groupBy(F.expr(f"{bit} div 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("mask"))
    return rows.withColumn("word", F.expr(f"{bit} div 64")).join(F.broadcast(words), "word").filter(f"(shiftright(mask, cast({bit} % 64 as int)) & 1) = 1").drop("word", "mask")


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows (h1, h2 and more) whose key occurs in another line too. The keys are a written table, so that Spark can split a hot one."""
    several = stage_table(keyed.groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1").select("key"), "keys")
    return keyed.join(several, "key", "left_semi")


def _as_bytes(line: str) -> str:
    """A line with a character for each byte of its UTF-8 form; lines of one-byte characters are left as they are."""
    return f"if(octet_length({line}) = char_length({line}), {line}, decode(encode({line}, 'UTF-8'), 'ISO-8859-1'))"


def duplicate_lines(documents: DataFrame, unit: str = "character") -> DataFrame:
    """doc_id, line_no of every line that an earlier line (by doc_id, then line_no) equals or is one edit away from.

    The bound is one insertion, deletion or substitution of a unit, whatever the length of the line: a character, or a `byte` of
    UTF-8 (what DuckDB's levenshtein counts: é and É differ in one byte, é and e in two). Blank lines are never duplicates. A
    null or empty text has none, nor has an empty table; other columns than doc_id and text are ignored.

    Equal lines are first reduced to their earliest place, with partial results in each task. Lines within one edit are equal
    but for one of 2, and one of SEGMENTS, segments: only lines that share such a masked key go on, and only positions in that
    segment count. There a line emits itself, and each string left by deleting one character, as hashed keys: a substitution
    makes equal (string, position) pairs, an insertion makes a string of the longer line equal to the shorter line. The
    members of a key are all within the bound of each other, or of its one whole line; so the key's earliest member is
    partner enough for each, no pairs within a key are formed, and no line with an earlier partner is missed. The edit
    distance of the texts is verified last."""
    if unit not in ("character", "byte"):
        raise ValueError(f"unit is character or byte, not {unit}")
    lines = (
        documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
        .filter("trim(line) <> ''")
        .withColumn("line", F.expr("line" if unit == "character" else _as_bytes("line")))
        .withColumns({"h1": F.expr("xxhash64(line)"), "h2": F.expr("xxhash64(7, line)"), "n": F.length("line")})
    )
    halves = F.expr(f"array({', '.join(_masked(c, q, 2) for c in ('n', '(n - 1)') for q in '01')})")
    places = stage_table(lines.select("h1", "h2", "n", F.struct("doc_id", "line_no").alias("place"), halves.alias("halves")), "places")
    first = stage_table(places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("halves").alias("halves")), "first-places")

    likely = _shared(first.select("h1", "h2", "first", F.explode("halves").alias("key"))).select("h1", "h2", "first").distinct()
    likely = stage_table(likely, "likely")
    some = _through_sieve(lines, likely).join(likely.withColumnRenamed("h2", "g2"), "h1").filter("h2 = g2 and doc_id <=> first.doc_id and line_no = first.line_no")
    texts = stage_table(some.select("h1", "h2", "first", "line", "n").dropDuplicates(["h1", "h2"]), "candidates")

    classes = texts.select("h1", "h2", "line", "n", F.explode(F.expr("array(n, n - 1)")).alias("c"))
    cut = classes.select("h1", "h2", "n", "c", "line", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("q"))
    cut = stage_table(_shared(cut.select("h1", "h2", "c", "q", F.expr(_masked("c", "q", SEGMENTS)).alias("key"))).select("h1", "h2", "c", "q"), "segments")
    where = cut.join(texts, ["h1", "h2"])
    low, high = f"int(q * c div {SEGMENTS})", f"int((q + 1) * c div {SEGMENTS})"
    at = where.withColumn("i", F.explode(F.expr(f"sequence({low}, if(c = n, greatest({low}, {high} - 1), {high}))"))).withColumn("rest", F.expr("concat(left(line, i), substr(line, i + 2))"))
    variants = at.select("h1", "h2", "first", F.expr("if(c = n, 'S', 'D')").alias("kind"), F.expr("if(c = n, xxhash64(rest, i), xxhash64(rest))").alias("key"))
    whole = where.filter("c = n").select("h1", "h2", "first", F.lit("W").alias("kind"), F.col("h1").alias("key")).distinct()
    keyed = stage_table(variants.distinct().unionByName(whole), "variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first"))).alias(kind)
    groups = keyed.groupBy("key").agg(least("S"), least("D"), least("W"), F.count("*").alias("n_key")).filter("n_key > 1").drop("n_key")
    groups = stage_table(groups, "partners")
    partner = F.when(F.col("kind") == "S", F.col("S")).when(F.col("kind") == "D", F.col("W")).otherwise(F.col("D"))
    pairs = keyed.join(groups, "key").select("h1", "h2", "first", partner.alias("partner")).filter("partner < first").distinct()
    mine = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"])
    both = mine.join(texts.select(F.col("first").alias("partner"), F.col("line").alias("other")), "partner")
    near = both.filter(F.levenshtein("line", "other", 1).between(0, 1)).select("h1", "h2").distinct()

    gone = stage_table(first.select("h1", "h2", "first").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left"), "gone")
    marked = places.select("h1", "h2", "place").join(gone, ["h1", "h2"])
    return marked.filter("near or place <> first").select("place.doc_id", "place.line_no")


def dedup_lines(documents: DataFrame, unit: str = "character") -> DataFrame:
    """The documents, all columns kept, without the lines that duplicate_lines names; and n_lines and n_dropped (these replace
    columns of the same name). Null texts stay null with one empty line. Rows that repeat a doc_id lose the same line numbers, and
    so do rows without doc_id. An empty table gives an empty result."""
    doc, numbers = free(documents, "doc_", "dropped_")
    dropped = duplicate_lines(documents, unit).groupBy("doc_id").agg(F.collect_set("line_no").alias(numbers)).withColumnRenamed("doc_id", doc)
    joined = documents.drop("n_lines", "n_dropped").join(dropped, F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    kept = F.transform(left, lambda i: F.get(lines, i))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(numbers), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(doc, numbers)
    )
