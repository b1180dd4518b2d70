"""Details of vulnerability ids: platforms, version bounds, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import cpe_fields

BOUNDS = ("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding")
MATCH = f"struct<criteria:string,{','.join(f'{b}:string' for b in BOUNDS)}>"
CONFIGURATIONS = f"array<struct<nodes:array<struct<cpeMatch:array<{MATCH}>>>>>"


def affected_versions(cves: DataFrame) -> DataFrame:
    """cve, vendor, product, version, update, vulnerable and the bounds of each platform that names a version.

    cves has cve, cpes (array of criteria, deprecated, vulnerable) and configurations (the tree of matches). The tree is flattened
    and looked up by the whole criteria within its own row, so nothing is joined; the last match that names a bound counts."""
    matches = F.flatten(F.transform(F.flatten(F.transform("configurations", lambda c: c["nodes"])), lambda n: n["cpeMatch"]))
    flat = cves.select("cve", F.explode("cpes").alias("p"), F.coalesce(matches, F.array().cast(f"array<{MATCH}>")).alias("matches"))
    rows = flat.withColumn("f", cpe_fields(F.col("p.criteria"), F.col("p.deprecated"))).filter("f is not null and f.version is not null")
    rows = rows.withColumn("own", F.filter("matches", lambda m: m["criteria"] == F.col("p.criteria")))
    last = lambda b: F.get(F.reverse(F.filter(F.transform("own", lambda m: m[b]), lambda x: x.isNotNull())), F.lit(0))
    return rows.select("cve", "f.vendor", "f.product", "f.version", "f.update", F.coalesce("p.vulnerable", F.lit(True)).alias("vulnerable"), *(last(b).alias(b) for b in BOUNDS))


def platform_names(cves: DataFrame) -> DataFrame:
    """cve and the readable names of its platforms, once each in order, deprecated ones and wildcards left out."""
    names = F.filter(F.transform("cpes", lambda p: cpe_fields(p["criteria"], p["deprecated"])["name"]), lambda n: n.isNotNull())
    return cves.select("cve", F.array_distinct(names).alias("products"))


def looked_up(found: DataFrame, details: DataFrame) -> DataFrame:
    """CVE ids with their row of the details (cve, score, severity, patched); ids without one are UNKNOWN, 0 and not patched. One
    look-up an id, however often it is found: the ids are made distinct first."""
    known = details.select("cve", F.col("score").alias("_score"), F.col("severity").alias("_severity"), F.col("patched").alias("_patched"))
    out = found.select("cve").distinct().join(known, "cve", "left")
    return out.select("cve", F.coalesce("_score", F.lit(0.0)).alias("score"), F.coalesce("_severity", F.lit("UNKNOWN")).alias("severity"), F.coalesce("_patched", F.lit(False)).alias("patched"), F.col("_severity").isNotNull().alias("found"))


def entity_table(rows: DataFrame, key: str, lists: dict[str, str], *more: str) -> DataFrame:
    """A row for each entity of each list column: kind, entity and further columns."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("entities")) for kind, c in lists.items()))
    return rows.select(key, *more, F.explode(pairs).alias("p")).select(key, *more, "p.kind", F.explode("p.entities").alias("entity"))
