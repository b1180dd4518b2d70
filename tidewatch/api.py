"""The service surface as functions over DataFrames, and the catalogue of tools by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import budget, candidates, classify, fields, indicators, network, text
from .functions import patterns as P
from .functions import text as text_functions
from .operators import parsing, relational, search
from .sources import readers, writers


def health() -> dict:
    return {"ok": True}


def version() -> dict:
    return {"name": "tidewatch", "version": __version__}


def ingest(table: DataFrame, records: DataFrame) -> DataFrame:
    """The table after records (id, text, metadata columns) took the place of those with the same point id, the last one of
    each id counting; ids become point ids."""
    keyed = records.withColumn("id", text.point_id(F.col("id").cast("string"))).withColumn("_n", F.monotonically_increasing_id())
    return relational.upsert(table, relational.latest(keyed, ["id"], ["_n"]).drop("_n"), "id")


def query(documents: DataFrame, q: str, limit: int = 5, least: float = 0.0, has_ioc: bool = False, vectors: DataFrame | None = None, **conditions) -> DataFrame:
    """Hybrid search under payload conditions: doc_id, score, stage. An empty query and a limit outside 1 to 50 are refused."""
    if not (q or "").strip():
        raise ValueError("the query is empty")
    if not 1 <= limit <= 50:
        raise ValueError("the limit is 1 to 50")
    return search.hybrid_search(documents.filter(search.payload_filter(**conditions)), q, limit, least, vectors, has_ioc)


def respond(documents: DataFrame, q: str, kinds: dict[str, str] | None = None, **how) -> DataFrame:
    """The answer to a search: text, score and tags (always a list) of the hits, best first."""
    hits = query(documents, q, **how)
    kind = dict(documents.dtypes).get("tags", "string")
    tags = fields.tag_list(F.col("tags") if "tags" in documents.columns else F.lit(None).cast("string"), kind)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tags.alias("tags")).join(F.broadcast(hits), "doc_id")
    return rows.orderBy("stage", F.desc("score"), "doc_id").select("text", "score", "tags")


def artifact_points(artifacts: DataFrame) -> DataFrame:
    """Point id, tenant, embedding text and flat payload of artifact records."""
    tenant = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.startswith(t, F.lit("tenant:")))
    lists = [F.coalesce(F.col(f"iocs.{k}"), F.array().cast("array<string>")) for k in ("urls", "domains", "ips", "hashes")]
    cves = F.transform(F.coalesce("cve.vulnerabilities", F.array()), lambda v: v["id"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return artifacts.select(
        F.sha2(F.concat(blank("source_url"), blank("content_sha256")), 256).alias("id"),
        F.when(F.size(tenant) > 0, F.split_part(tenant[0], F.lit(":"), F.lit(2))).otherwise("default").alias("tenant"),
        F.concat_ws("\n", blank("title"), blank("summary"), blank("markdown"), F.array_join(F.coalesce("mitre_ttps", F.array().cast("array<string>")), " "), F.array_join(F.concat(*lists), " "), F.array_join(cves, " ")).alias("text"),
        "source_url", "published_at", F.col("mitre_ttps").alias("ttps"), cves.alias("cves"),
        lists[1].alias("domains"), lists[2].alias("ips"), lists[3].alias("hashes"), F.col("cve.highest_severity").alias("sev"),
        F.coalesce("cve.active_exploitation", F.lit(False)).alias("kev"), F.col("cve.patch_availability").alias("patch_availability"),
    )


def by_cves(points: DataFrame, tenant: str = "default", cves: list[str] = (), most: int = 50) -> DataFrame:
    """Up to 50 points of a tenant, with the first of the CVE ids given."""
    rows = points.filter(F.col("tenant") == tenant)
    return (rows.filter(F.array_contains("cves", cves[0])) if cves else rows).limit(most)


def summarise(rows: DataFrame, text: str = "text") -> DataFrame:
    """Title, summary, flags and recommendations of texts by rule: the first line, the first 500 characters or the facts of a long text."""
    t = F.col(text)
    return rows.withColumns({
        "title": F.trim(F.split_part(t, F.lit("\n"), F.lit(1))), "summary": F.when(F.length(t) <= 500, t).otherwise(budget.summarised(t)),
        "zero_day_mention": classify.zero_day(t), "active_exploitation_mentioned": classify.actively_exploited(t), "recommendations_and_mitigations": budget.recommendations(text_functions.sentences(t)),
    })


def entities_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """malware and threat_actors by the fixed names, variants merged, generic words left out."""
    generic = lambda found: F.filter(found, lambda n: ~F.lower(n).isin(*P.NO_ENTITIES) & (F.length(n) > 1))
    found = lambda names: generic(indicators.distinct_matches(F.col(text), r"(?i)\b(?:" + "|".join(names) + r")\b"))
    return rows.withColumns({"malware": relational.smart_list(found(P.MALWARE_NAMES)), "threat_actors": relational.smart_list(found((*P.ACTOR_NAMES, r"(?:APT|UNC|TA)\d+")))})


def schemas() -> dict[str, dict]:
    """Name, summary and parameters of each tool, from its signature."""
    out = {}
    for name, tool in TOOLS.items():
        parameters = inspect.signature(tool).parameters.values()
        required = [p.name for p in parameters if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        properties = {p.name: {"type": getattr(p.annotation, "__name__", str(p.annotation)) if p.annotation is not p.empty else "any"} for p in parameters}
        out[name] = {"name": name, "description": (inspect.getdoc(tool) or "").split("\n")[0], "inputSchema": {"type": "object", "properties": properties, "required": required}}
    return out


def call(name: str, *args, **kwargs):
    """Calls a tool by its name; an unknown name is refused."""
    if name not in TOOLS:
        raise KeyError(f"no tool is called {name}")
    return TOOLS[name](*args, **kwargs)


#: What the stages of the document plan do, in the order in which they run.
CAPABILITIES = (
    "fetch", "detect_type", "parse_html", "parse_pdf", "parse_rss", "parse_json", "parse_misp", "parse_stix", "parse_text", "extract_iocs", "extract_cves", "map_techniques",
    "extract_entities", "summarize", "classify_geo_motivation", "classify_cyber", "validate", "store",
)


# Tools by the names under which callers know them: columns to a column, or frames to a frame.
TOOLS: dict[str, Callable] = {
    "http_fetch": readers.fetched,
    "detect_kind": classify.detect_kind,
    "misp_parse_event": parsing.misp_attributes,
    "stix_parse_bundle": parsing.stix_nodes,
    "rss_parse": parsing.feed_items,
    "html_to_markdown": parsing.html_markdown,
    "pdf_to_text": text.clean_pdf_text,
    "json_normalize": parsing.json_pairs,
    "extract_pdf_text_and_markup": budget.pdf_page_markdown,
    "summarize_threat": summarise,
    "extract_entities": entities_of,
    "classify_geo_scope": classify.geography,
    "classify_high_tension": classify.high_tension,
    "classify_motivation": classify.motivations,
    "is_cyber_related": classify.cyber_related,
    "extract_and_normalize": candidates.extract,
    "extract_from_text": indicators.loose_cves,
    "enrich": relational.kev_enrich,
    "classify_ip_addresses": network.classify_ipv4,
    "validate_and_heal": relational.heal,
    "store_emit": writers.write_json,
}


def register_all(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of the scalar tools, as SQL expressions that the optimiser sees through."""
    made = {
        "refang": "replace(replace(replace(replace(x, 'hxxp', 'http'), '[.]', '.'), '[:]', ':'), '[@]', '@')",
        "fingerprint": "concat('md5:', md5(left(x, 512)))",
        "normalize_hash": "lower(trim(x))",
        "normalize_cve": "if(upper(trim(x)) LIKE 'CVE-%', upper(trim(x)), concat('CVE-', upper(trim(x))))",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return list(made)
