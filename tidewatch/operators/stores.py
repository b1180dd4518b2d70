"""Tables that keep points, artifacts, indexes and runs: upserts by condition, memory reads, run accounts, emission."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import model_cost
from ..functions.text import uuid5


def set_payload(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The rows with these columns set where the condition holds, and `changed` to count them by."""
    hit = F.coalesce(where, F.lit(False))
    kept = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.withColumns({c: F.when(hit, v).otherwise(kept(c)) for c, v in values.items()} | {"changed": hit})


def ensure(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def recreate(spark: SparkSession, name: str, schema: str) -> None:
    """An empty table of this schema, whatever was there."""
    drop(spark, name)
    ensure(spark, name, schema)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def wipe(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def merge(index: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The index with one row a key: the last change by the order given, else the row there was. A hot key is aggregated in parts."""
    columns = [c for c in index.columns if c not in keys]
    both = index.withColumn("_o", F.lit(None).cast("long")).unionByName(changes.withColumn("_o", order.cast("long")).select(*index.columns, "_o"))
    last = F.max_by(F.struct(*columns), F.struct(F.col("_o").isNotNull(), "_o"))
    return both.groupBy(*keys).agg(last.alias("_v")).select(*keys, "_v.*").select(*index.columns)


def update_paths(contents: DataFrame, emitted: DataFrame) -> DataFrame:
    """Content rows (sha256, artifact_path) with the path of what was emitted under their digest."""
    new = emitted.groupBy("sha256").agg(F.max("path").alias("_path"))
    return contents.join(new, "sha256", "left").withColumn("artifact_path", F.coalesce("_path", "artifact_path")).drop("_path")


def by_kind(index: DataFrame, kind: str, value: str) -> DataFrame:
    """The distinct values of each kind, sorted, and their number."""
    once = index.select(kind, value).distinct()
    return once.groupBy(kind).agg(F.array_sort(F.collect_list(value)).alias("values"), F.count("*").alias("n"))


def memory_context(documents: DataFrame, artifacts: DataFrame, iocs: DataFrame, cves: DataFrame, url: str = "canonical_url") -> DataFrame:
    """For each document (canonical_url): the stored artifact of its address if there is one, and how many of each kind the indexes hold."""
    stored = artifacts.groupBy(url).agg(F.max("artifact").alias("existing"))
    totals = iocs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("ioc_index")) if "n" in iocs.columns else memory_context_counts(iocs)
    known = cves.agg(F.count_distinct("cve").alias("cve_index"))
    return documents.join(stored, url, "left").join(F.broadcast(totals)).join(F.broadcast(known))  # one row each


def memory_context_counts(iocs: DataFrame) -> DataFrame:
    counts = iocs.groupBy("kind").agg(F.count_distinct("value").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("ioc_index"))


def started(runs: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Runs (run_id, started_at, finished_at, status) with new ones under way."""
    new = ids.select("run_id", at.alias("started_at"), F.lit(None).cast(runs.schema["finished_at"].dataType).alias("finished_at"), F.lit("running").alias("status"))
    return runs.unionByName(new)


def finished(runs: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Runs with the end and status of those in results (run_id, status)."""
    done = results.select("run_id", F.col("status").alias("_status"))
    hit = F.col("_status").isNotNull()
    return runs.join(done, "run_id", "left").withColumns({"finished_at": F.when(hit, at).otherwise(F.col("finished_at")), "status": F.coalesce("_status", "status")}).drop("_status")


def run_totals(calls: DataFrame, by: str, model: Column, prompt: Column, completion: Column, ok: Column) -> DataFrame:
    """Calls, successes, errors, tokens and cost of each value of a column, and of all (null)."""
    rows = calls.select(F.col(by), prompt.alias("p"), completion.alias("c"), ok.alias("ok"), model_cost(model, prompt, completion).alias("cost"))
    return rows.rollup(by).agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors"),
        F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("cost").alias("cost"))


def result_line(*columns: str) -> Column:
    """A compact JSON line of the columns in the order given; null values are kept out."""
    return F.to_json(F.struct(*columns))


def feed_path(epoch: Column, index: Column) -> Column:
    return F.concat(F.lit("cti_"), epoch.cast("string"), F.lit("_"), index.cast("string"), F.lit(".json"))


def emit(rows: DataFrame, writers: list[Callable[[DataFrame], str | None]]) -> str | None:
    """Gives the rows to each writer in turn and returns the first locator that one gives; a writer that fails is passed over."""
    first = None
    for write in writers:
        try:
            first = write(rows) or first if first is None else (write(rows), first)[1]
        except Exception as e:  # noqa: BLE001  a sink that is down must not keep the others from theirs
            print(json.dumps({"sink": getattr(write, "__name__", str(write)), "error": str(e)}))
    return first


def chunk_ids(document: Column, index: Column) -> Column:
    """An id of a chunk that is the same whenever the chunk is made again."""
    return uuid5(F.concat(document.cast("string"), F.lit(":"), index.cast("string")))


def backup_vectors(points: DataFrame, path: str) -> None:
    points.select("id", "embedding").write.mode("overwrite").parquet(path)
