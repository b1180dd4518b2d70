"""Writers. Each writes partitioned files through Spark, so tasks that are run again replace their own output only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def default_path(sha256: Column, epoch: Column) -> Column:
    return F.when(F.coalesce(sha256, F.lit("")) != "", F.concat(sha256, F.lit(".json"))).otherwise(F.concat(F.lit("cti_"), epoch.cast("string"), F.lit(".json")))


def sorted_json(*columns: str) -> Column:
    """A JSON object with keys in order; null values are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select(sorted_json(*rows.columns).alias("value")).write.mode(mode).text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_bio(tagged: DataFrame, path: str, delimiter: str = " ") -> None:
    """A line per token, an empty line after each sentence; columns tokens (array of struct token, tag)."""
    lines = F.transform("tokens", lambda t: F.concat(t["token"], F.lit(delimiter), t["tag"]))
    tagged.select(F.explode(F.concat(lines, F.array(F.lit("")))).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, partition: list[str] = (), bloom: list[str] = ()) -> None:
    """Parquet with partition folders and Bloom filters on the columns that lookups use."""
    writer = rows.write.mode("overwrite")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
