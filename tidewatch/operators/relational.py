"""Deduplication, upserts, anti-joins, backfills and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import severity_rank
from ..functions.text import smart_key


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest values of the columns `by` (ties: any; null keys form a key). One shuffle of a row a key and
    task, since the best row is aggregated in parts: a hot key is no single task's."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with rows of changes in place of those with the same key; changes must have one row a key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def replaced(rows: DataFrame, known: DataFrame, url: str = "url", digest: str = "sha256") -> DataFrame:
    """Known rows whose address came back with another digest: these are to be deleted."""
    now = rows.select(url, F.col(digest).alias("_now")).distinct()
    return known.join(now, url).filter(F.col(digest) != F.col("_now")).drop("_now").distinct()


def smart_distinct(rows: DataFrame, name: str, position: Column) -> DataFrame:
    """Variants of a name (see smart_key) merged: the longest, of equal ones the first, at the first one's position."""
    keyed = rows.filter(F.trim(name) != "").select(smart_key(F.col(name)).alias("name_key"), F.trim(name).alias("n"), position.alias("p"))
    return keyed.groupBy("name_key").agg(F.max_by("n", F.struct(F.length("n"), -F.col("p"))).alias(name), F.min("p").alias("position"), F.count("*").alias("variants"))


def smart_list(names: Column) -> Column:
    """A list with the variants of a name (see smart_key) merged: the longest, of equal ones the first, at the first one's place."""
    trimmed = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
    keyed = F.transform(trimmed, lambda n, i: F.struct(smart_key(n).alias("k"), F.length(n).alias("size"), (-i).alias("at"), n.alias("n")))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.transform(keys, lambda k: F.array_max(F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: F.struct(x["size"], x["at"], x["n"])))["n"])


def merge_lists(*lists: Column, normalise=lambda c: c) -> Column:
    """Lists put together in order, normalised, without repeats or empty entries."""
    joined = F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), normalise)
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != "")))


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Sets a column where it is null, and flags the rows that this changes as `updated`."""
    return rows.withColumn("updated", F.col(column).isNull() & value.isNotNull()).withColumn(column, F.coalesce(F.col(column), value))


def severity_rollup(rows: DataFrame, key: str) -> DataFrame:
    """Per key: whether any entry is exploited or patched, the greatest score, and the greatest known severity."""
    return rows.groupBy(key).agg(
        F.bool_or("exploited").alias("exploited"), F.bool_or("patched").alias("patched"), F.max("score").alias("score"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("n"))


def kev_enrich(found: DataFrame, catalogue: DataFrame, details: DataFrame) -> DataFrame:
    """CVE ids with catalogue membership and details: ids in the catalogue are exploited, at least HIGH and 7.5.

    Both dimensions are joined on the id; Spark broadcasts them only below its size threshold."""
    listed = catalogue.select("cve", F.lit(True).alias("listed")).distinct()
    out = found.join(listed, "cve", "left").join(details, "cve", "left")
    listed = F.coalesce("listed", F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    severity = F.coalesce("severity", F.lit("UNKNOWN"))
    raised = F.when(listed & (severity_rank(severity) < 4), "HIGH").otherwise(severity)
    return out.withColumn("exploited", listed).withColumn("score", F.when(listed, F.greatest(score, F.lit(7.5))).otherwise(score)).withColumn("severity", raised).drop("listed")


def totals(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """Sums and counts for each value of a column, and over all (null)."""
    return rows.rollup(by).agg(*(F.sum(v).alias(v) for v in values), F.count("*").alias("calls"))


def heal(rows: DataFrame, strings: list[str] = (), lists: list[str] = (), flags: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Columns brought to their type, with its empty value for null: lists from comma-separated strings too, trimmed and
    without repeats; flags from true, yes, 1 and on."""
    kinds = dict(rows.dtypes)
    out = {}
    for c in strings:
        out[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for c in lists:
        items = F.split(F.col(c), ",") if kinds[c] == "string" else F.col(c)
        out[c] = merge_lists(items, normalise=lambda x: F.trim(x))
    for c in flags:
        out[c] = F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "yes", "1", "on"), F.lit(False))
    for c in numbers:
        out[c] = F.coalesce(F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c).cast("double"), F.lit(0.0))
    return rows.withColumns(out)


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The share of columns that hold something, in percent, and the names of the others."""
    kinds = dict(rows.dtypes)
    filled = {c: F.size(c) > 0 if kinds[c].startswith(("array", "map")) else F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in columns}
    share = sum((F.when(f, 1).otherwise(0) for f in filled.values()), F.lit(0))
    missing = F.filter(F.array(*(F.when(~F.coalesce(f, F.lit(False)), c) for c, f in filled.items())), lambda x: x.isNotNull())
    return rows.withColumn("completeness", F.round(share * 100.0 / len(columns), 1)).withColumn("missing", missing)


def merge_sources(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Both tables' rows; ids of the second that are null or in the first become a digest of the row."""
    taken = first.select(F.col(key).alias("_taken")).distinct()
    fresh = F.sha2(F.to_json(F.struct(*second.columns)), 256)
    fixed = second.join(taken, F.col(key) == F.col("_taken"), "left").withColumn(key, F.when(F.col(key).isNull() | F.col("_taken").isNotNull(), fresh).otherwise(F.col(key))).drop("_taken")
    return first.unionByName(fixed, allowMissingColumns=True)


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows by key after a cursor (null: from the start)."""
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key and name for each name that occurs in a text, in any case. Names are a vocabulary: they are brought together as one sorted
    list (a row, whose size Spark reports) and looked for in each text, so texts are neither shuffled nor multiplied."""
    every = names.select(F.lower(name).alias("_n")).filter("_n <> ''").distinct().agg(F.array_sort(F.collect_list("_n")).alias("_names"))
    found = F.filter("_names", lambda n: F.contains(F.lower(F.col(text)), n))
    return rows.join(F.broadcast(every)).select(key, F.explode(found).alias(name))
