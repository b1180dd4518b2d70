"""The registered queries, each beside the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, fields, indicators, network, text, urls
from ..functions import patterns as P
from ..operators import chunking, entities, parsing, relational, search, stores
from ..sources import readers, writers
from ..streaming import feeds
from .artifacts import artifacts
from .register import ORACLES, QUERIES, _all, _join, _q, labelled, query

# Derived texts: the same expression in both engines.
ADVISORY = (
    "concat('Advisory CVE-', CAST(year(l_shipdate) AS STRING), '-', lpad(CAST(l_partkey AS STRING), 5, '0'), ' uses MITRE technique T', CAST(1000 + l_suppkey % 700 AS STRING), "
    "'.00', CAST(l_linenumber AS STRING), ' via phishing; host 10.', CAST(l_partkey % 256 AS STRING), '.', CAST(l_suppkey % 256 AS STRING), '.', CAST(l_linenumber AS STRING), "
    "' and hxxp://evil', CAST(l_suppkey AS STRING), '[.]com/a?id=', CAST(l_partkey AS STRING), ' dropped svc', CAST(l_partkey AS STRING), '.exe, actively exploited zero-day, patch ', CAST(l_orderkey AS STRING))"
)
LOOSE = "concat('ref ', CAST(year(l_shipdate) AS STRING), '-', lpad(CAST(l_partkey AS STRING), 5, '0'), ' and cve-', CAST(year(l_shipdate) AS STRING), '-', CAST(10000 + l_suppkey AS STRING), ' end')"
HOST = (
    "concat('ran C:\\\\Users', CAST(p_partkey AS STRING), '\\\\app', CAST(p_size AS STRING), '.dll then powershell -enc ', repeat('QUJD', 6), ' in /tmp/x', CAST(p_partkey AS STRING), '/run.sh')"
)
ADDRESS = "concat(CAST(o_orderkey % 256 AS STRING), '.', CAST(o_custkey % 256 AS STRING), '.', CAST(o_orderkey % 7 AS STRING), '.', CAST(o_custkey % 99 AS STRING))"


@query(f"SELECT source, 'cve' AS kind, count(*) AS n FROM (SELECT source, unnest(list_distinct({_all(P.CVE)})) FROM documents) GROUP BY ALL "
       f"UNION ALL SELECT source, 'ip', count(*) FROM (SELECT source, unnest(list_distinct({_all(P.IPV4)})) FROM documents) GROUP BY ALL "
       f"UNION ALL SELECT source, 'domain', count(*) FROM (SELECT source, unnest(list_distinct({_all(P.DOMAIN_PAIR)})) FROM documents) GROUP BY ALL "
       f"UNION ALL SELECT source, 'hash', count(*) FROM (SELECT source, unnest(list_distinct({_all(P.HASH)})) FROM documents) GROUP BY ALL")  # fmt: skip
def ioc_counts_by_source(t) -> DataFrame:
    found = indicators.indicators(F.col("text"))
    pairs = labelled({"cve": found["cves"], "ip": found["ips"], "domain": found["domains"], "hash": found["hashes"]})
    return t("documents").select("source", F.explode(pairs).alias("p")).select("source", "p.kind").groupBy("source", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, 'ip' AS kind, unnest(list_distinct({_all(P.IPV4)})) AS value FROM documents "
       f"UNION ALL SELECT doc_id, 'email', unnest(list_distinct(list_transform({_all(P.EMAIL)}, lambda x: lower(x)))) FROM documents "
       f"UNION ALL SELECT doc_id, 'hash', unnest(list_distinct(list_transform({_all(P.HASH_EXACT)}, lambda x: lower(x)))) FROM documents")  # fmt: skip
def ioc_long_table(t) -> DataFrame:
    x = F.col("text")
    lists = {"ip": indicators.distinct_matches(x, P.IPV4), "email": indicators.emails(x), "hash": indicators.hashes(x)}
    return t("documents").select("doc_id", F.explode(labelled(lists)).alias("p")).select("doc_id", "p.kind", "p.value")


@query(f"""SELECT doc_id, kind, value FROM (SELECT doc_id, CASE WHEN c <> '' THEN 'cve' WHEN i <> '' THEN 'ip' WHEN d <> '' THEN 'domain' WHEN h <> '' THEN 'hash' END AS kind,
        coalesce(nullif(upper(c), ''), nullif(i, ''), nullif(lower(d), ''), nullif(lower(h), '')) AS value FROM (SELECT doc_id, regexp_extract(text, '(?i)\\bCVE-\\d{{4}}-\\d{{4,7}}\\b') AS c,
        regexp_extract(text, {_q(P.IPV4)}) AS i, regexp_extract(text, {_q(P.DOMAIN_PAIR)}) AS d, regexp_extract(text, {_q(P.HASH)}) AS h FROM documents)) WHERE kind IS NOT NULL""")
def ioc_first_match(t) -> DataFrame:
    return t("documents").select("doc_id", indicators.first_indicator(F.col("text")).alias("f")).filter("f is not null").select("doc_id", "f.kind", "f.value")


@query(f"SELECT doc_id, len({_all(P.IPV4_OCTETS)}) AS ips, len({_all(P.SHA256)}) AS hashes, coalesce(array_to_string({_all(P.IPV4_OCTETS)}, '|'), '') AS ip_list FROM documents")
def api_ioc_detect(t) -> DataFrame:
    f = indicators.query_indicators(F.col("text"))
    return t("documents").select("doc_id", F.size(f["ips"]).cast("long").alias("ips"), F.size(f["hashes"]).cast("long").alias("hashes"), F.array_join(f["ips"], "|").alias("ip_list"))


@query(f"SELECT email, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform({_all(P.EMAIL)}, lambda x: lower(x)))) AS email FROM documents) GROUP BY email")
def emails_normalized(t) -> DataFrame:
    return t("documents").select(F.explode(indicators.emails(F.col("text"))).alias("email")).groupBy("email").agg(F.count("*").alias("n"))


@query(f"SELECT length(h) AS size, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform({_all(P.HASH_EXACT)}, lambda x: lower(x)))) AS h FROM documents) WHERE replace(h, h[1], '') <> '' GROUP BY 1")
def hash_lengths(t) -> DataFrame:
    return t("documents").select(F.explode(indicators.hashes(F.col("text"))).alias("h")).groupBy(F.length("h").cast("long").alias("size")).agg(F.count("*").alias("n"))


def _block_case(number: str) -> str:
    out = []
    for first, length, reason, kind in P.IPV4_BLOCKS:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out.append(f"WHEN {number} BETWEEN {low} AND {low + (1 << (32 - length)) - 1} THEN '{kind}'")
    return f"CASE {' '.join(out)} ELSE 'Public' END"


_NUMBER = "((CAST(split_part(ip, '.', 1) AS BIGINT) * 256 + CAST(split_part(ip, '.', 2) AS BIGINT)) * 256 + CAST(split_part(ip, '.', 3) AS BIGINT)) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT)"


@query(f"SELECT kind, count(*) AS n, count(DISTINCT ip) AS ips FROM (SELECT ip, {_block_case(_NUMBER)} AS kind FROM (SELECT {ADDRESS} AS ip FROM orders)) GROUP BY kind")
def ipv4_classify(t) -> DataFrame:
    rows = t("orders").select(F.expr(ADDRESS).alias("ip"))
    return rows.withColumn("kind", network.classify_ipv4(F.col("ip"))["kind"]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips"))


@query(f"""SELECT doc_id, ip, regexp_matches(lower(substr(text, greatest(instr(text, ip) - 100, 1), length(ip) + 200)), 'malware|c2|command|control|beacon|callback|threat|attack|compromise|infrastructure') AS threat
        FROM (SELECT doc_id, text, unnest(list_distinct({_all(P.IPV4)})) AS ip FROM documents)""")
def ip_private_context(t) -> DataFrame:
    rows = t("documents").select("doc_id", "text", F.explode(indicators.distinct_matches(F.col("text"), P.IPV4)).alias("ip"))
    return rows.select("doc_id", "ip", network.private_needs_context(F.col("ip"), F.col("text")).alias("threat"))


_SUFFIXES = ", ".join(f"'{s}'" for s in P.FILE_SUFFIXES)


@query(f"""SELECT doc_id, d AS domain, regexp_matches(d, '^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,63}}$') AND split_part(d, '.', -1) NOT IN ({_SUFFIXES}) AND NOT regexp_matches(d, '^\\d+\\.[A-Za-z]+$') AS valid,
        regexp_replace(lower(d), '^www\\.', '') AS normalised FROM (SELECT doc_id, unnest(list_distinct({_all(P.DOMAIN_PAIR)})) AS d FROM documents)""")
def domain_valid(t) -> DataFrame:
    rows = t("documents").select("doc_id", F.explode(indicators.distinct_matches(F.col("text"), P.DOMAIN_PAIR)).alias("domain"))
    return rows.select("doc_id", "domain", network.valid_domain(F.col("domain")).alias("valid"), network.normalise_domain(F.col("domain")).alias("normalised"))


@query(f"SELECT ip, replace(ip, '.', '[.]') AS defanged, ip AS refanged, count(*) AS n FROM (SELECT unnest({_all(P.IPV4)}) AS ip FROM documents) GROUP BY ip")
def defang_refang(t) -> DataFrame:
    rows = t("documents").select(F.explode(indicators.matches(F.col("text"), P.IPV4)).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    return rows.select("ip", indicators.defang(F.col("ip")).alias("defanged"), indicators.refang(indicators.defang(F.col("ip"))).alias("refanged"), "n")


_TRACK = ", ".join(f"'{p}'" for p in P.TRACKING_PARAMETERS)
_CANON = f"""SELECT page_id, url, scheme || '://' || name || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS canonical_url, name AS host FROM (
    SELECT page_id, url, scheme, regexp_replace(name, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '') AS name,
    CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') WHEN path = '' THEN '/' ELSE path END AS path, frag,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]+=.+$') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK}))), '&') AS q
    FROM (SELECT page_id, url, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) = 'http' THEN 'http' ELSE 'https' END AS scheme, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') AS name,
    regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages))"""


@query(f"SELECT page_id, canonical_url FROM ({_CANON})")
def url_canonical(t) -> DataFrame:
    return t("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS clean_url FROM (SELECT page_id, url, regexp_extract(url, '#(.*)$', 1) AS frag,
        array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), 'utm_source|utm_medium|utm_campaign|utm_content|utm_term|fbclid|gclid|ref|source|campaign')), '&') AS q FROM pages)""")
def url_clean_tracking(t) -> DataFrame:
    return t("pages").select("page_id", urls.clean_link(F.col("url")).alias("clean_url"))


@query(f"SELECT host, count(*) AS n, count(DISTINCT canonical_url) AS urls FROM ({_CANON}) GROUP BY host")
def page_host_counts(t) -> DataFrame:
    rows = t("pages").select(urls.host(F.col("url")).alias("host"), urls.canonical_url(F.col("url")).alias("u"))
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("u").alias("urls"))


@query(f"""WITH h AS (SELECT DISTINCT host FROM ({_CANON}) WHERE page_id % 2 = 0) SELECT p.page_id, p.host FROM ({_CANON}) p WHERE p.host NOT IN (SELECT host FROM h)""")
def source_domain_exclusion(t) -> DataFrame:
    rows = t("pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return relational.unseen(rows, rows.filter("page_id % 2 = 0"), "host").select("page_id", "host")


_ADV = f"(SELECT l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax, {ADVISORY} AS text FROM lineitem)"


def advisories(t) -> DataFrame:
    return t("lineitem").withColumn("text", F.expr(ADVISORY))


@query(f"SELECT cve, count(*) AS n FROM (SELECT unnest(list_distinct({_all(P.CVE)})) AS cve FROM {_ADV}) GROUP BY cve")
def cve_extract_strict(t) -> DataFrame:
    return advisories(t).select(F.explode(indicators.distinct_matches(F.col("text"), P.CVE)).alias("cve")).groupBy("cve").agg(F.count("*").alias("n"))


@query(f"""SELECT cve, count(*) AS n FROM (SELECT unnest([concat('CVE-', y, '-', lpad(CAST(p AS VARCHAR), 5, '0')), concat('CVE-', y, '-', 10000 + s)]) AS cve
        FROM (SELECT year(l_shipdate) AS y, l_partkey AS p, l_suppkey AS s FROM lineitem)) GROUP BY cve""")
def cve_extract_loose(t) -> DataFrame:
    return t("lineitem").select(F.explode(indicators.loose_cve_mentions(F.expr(LOOSE))).alias("cve")).groupBy("cve").agg(F.count("*").alias("n"))


_CVES = f"SELECT DISTINCT regexp_extract(text, {_q(P.CVE)}) AS cve, l_suppkey FROM {_ADV}"
_DIM = f"SELECT regexp_extract(text, {_q(P.CVE)}) AS cve, max(l_discount * 100) AS score FROM {_ADV} GROUP BY 1"
_SEVERITY = "CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'UNKNOWN' END"


@query(f"""WITH c AS (SELECT DISTINCT cve FROM ({_CVES})), k AS (SELECT DISTINCT cve FROM ({_CVES}) WHERE l_suppkey % 7 = 0), d AS (SELECT cve, score, {_SEVERITY} AS severity FROM ({_DIM}))
        SELECT c.cve, k.cve IS NOT NULL AS exploited, round(CASE WHEN k.cve IS NOT NULL THEN greatest(d.score, 7.5) ELSE d.score END, 6) AS score,
        CASE WHEN k.cve IS NOT NULL AND d.severity NOT IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE d.severity END AS severity FROM c LEFT JOIN k USING (cve) LEFT JOIN d USING (cve)""")
def cve_kev_join(t) -> DataFrame:
    found = advisories(t).select(F.regexp_extract("text", P.CVE, 0).alias("cve"), "l_suppkey", (F.col("l_discount") * 100).alias("score"))
    details = found.groupBy("cve").agg(F.max("score").alias("score")).withColumn("severity", classify.severity(F.col("score")))
    out = relational.kev_enrich(found.select("cve").distinct(), found.filter("l_suppkey % 7 = 0"), details)
    return out.select("cve", "exploited", F.round("score", 6).alias("score"), "severity")


@query(f"""SELECT supplier, bool_or(exploited) AS exploited, bool_or(patched) AS patched, max(score) AS score, arg_max(severity, list_position(['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS severity, count(*) AS n
        FROM (SELECT *, {_SEVERITY} AS severity FROM (SELECT l_suppkey AS supplier, l_returnflag = 'R' AND l_quantity > 45 AS exploited, l_linestatus = 'F' AND l_quantity < 3 AS patched, round(l_discount * 100, 6) AS score FROM lineitem)) GROUP BY supplier""")
def cve_severity_rollup(t) -> DataFrame:
    rows = t("lineitem").select(F.col("l_suppkey").alias("supplier"), F.expr("l_returnflag = 'R' AND l_quantity > 45").alias("exploited"), F.expr("l_linestatus = 'F' AND l_quantity < 3").alias("patched"), F.expr("round(l_discount * 100, 6)").alias("score"))
    return relational.severity_rollup(rows.withColumn("severity", classify.severity(F.col("score"))), "supplier")


_CPE = "concat('cpe:2.3:a:', lower(replace(p_brand, '#', '_')), ':', replace(lower(p_type), ' ', '_'), ':', CAST(p_size AS STRING), ':*:*:*:*:*:*:*')"


@query(f"SELECT vendor, product, count(*) AS n, count(DISTINCT version) AS versions, min(version) AS low, max(version) AS high FROM (SELECT split_part(c, ':', 4) AS vendor, split_part(c, ':', 5) AS product, CAST(split_part(c, ':', 6) AS INTEGER) AS version FROM (SELECT {_CPE} AS c FROM part)) WHERE vendor <> '*' AND product <> '*' GROUP BY 1, 2")
def cpe_products(t) -> DataFrame:
    c = F.expr(_CPE)
    part = lambda k: F.split_part(c, F.lit(":"), F.lit(k))
    rows = t("part").select(part(4).alias("vendor"), part(5).alias("product"), part(6).try_cast("int").alias("version")).filter("vendor <> '*' AND product <> '*'")
    return rows.groupBy("vendor", "product").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), F.min("version").alias("low"), F.max("version").alias("high"))


_FIXED = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, CAST(pos AS INTEGER) AS offset_start, s AS text FROM (
    SELECT doc_id, pos, regexp_replace(substr(text, pos + 1, 2048), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1536)) AS pos FROM documents)) WHERE s <> ''"""


@query(f"SELECT doc_id, chunk_index, offset_start, length(text) AS size, md5(text) AS digest FROM ({_FIXED})")
def chunk_fixed(t) -> DataFrame:
    return chunking.fixed_chunks(t("documents")).select("doc_id", "chunk_index", "offset_start", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SENTENCES = r"""WITH RECURSIVE w AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0),
    c AS (SELECT doc_id, t, n, 0 AS k, 0 AS i, CASE WHEN p IS NULL OR p < 600 THEN least(n, 1200) ELSE p + 1 END AS cut
          FROM (SELECT *, CASE WHEN strpos(substr(t, 1, 1200), '. ') = 0 THEN NULL ELSE least(n, 1200) - 1 - strpos(reverse(substr(t, 1, 1200)), ' .') END AS p FROM w)
          UNION ALL SELECT doc_id, t, n, k + 1, ni, CASE WHEN p IS NULL OR p - ni < 600 THEN least(n, ni + 1200) ELSE p + 1 END
          FROM (SELECT *, CASE WHEN strpos(seg, '. ') = 0 THEN NULL ELSE ni + length(seg) - 1 - strpos(reverse(seg), ' .') END AS p
                FROM (SELECT doc_id, t, n, k, greatest(cut - 150, i + 1) AS ni, substr(t, greatest(cut - 150, i + 1) + 1, 1200) AS seg FROM c WHERE cut < n)))
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(i AS INTEGER) AS offset_start, CAST(cut AS INTEGER) AS offset_end, trim(substr(t, i + 1, cut - i)) AS text FROM c"""


@query(f"SELECT doc_id, chunk_index, offset_start, offset_end, md5(text) AS digest, count(*) OVER (PARTITION BY doc_id) AS chunk_total, CASE WHEN chunk_index > 0 THEN doc_id || ':' || (chunk_index - 1) END AS prev_chunk_id FROM ({_SENTENCES})")
def chunk_sentence(t) -> DataFrame:
    rows = chunking.with_neighbours(chunking.sentence_chunks(t("documents")))
    return rows.select("doc_id", "chunk_index", "offset_start", "offset_end", F.md5(F.col("text").cast("binary")).alias("digest"), "chunk_total", "prev_chunk_id")


@query(f"""SELECT doc_id, chunk_index, length(text) AS char_count, 'md5:' || md5(left(text, 512)) AS fingerprint, len(list_distinct({_all(P.IPV4)})) > 0 OR len({_all(P.CVE)}) > 0 OR len({_all(P.DOMAIN_PAIR)}) > 0 OR len({_all(P.HASH)}) > 0 AS has_ioc,
        count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM ({_FIXED})""")
def chunk_payload(t) -> DataFrame:
    found = indicators.indicators(F.col("text"))
    rows = chunking.with_neighbours(chunking.fixed_chunks(t("documents")))
    return rows.select("doc_id", "chunk_index", F.length("text").cast("long").alias("char_count"), text.fingerprint(F.col("text")).alias("fingerprint"), indicators.has_indicator(found, F.array().cast("array<string>")).alias("has_ioc"), "chunk_total")


@query(f"SELECT fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, 'md5:' || md5(left(text, 512)) AS fingerprint FROM ({_FIXED})) GROUP BY 1 HAVING count(*) > 1")
def chunk_fingerprint_dups(t) -> DataFrame:
    rows = chunking.fixed_chunks(t("documents")).select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("""SELECT context_category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'out-of-band|patch|workaround|mitigation') THEN 'mitigation' WHEN regexp_matches(t, 'exploited in the wild|actively exploited') THEN 'observed_in_wild'
        WHEN contains(t, 'ioc') THEN 'ioc' WHEN regexp_matches(t, 'exploit|rce|poc|weaponized') THEN 'exploit' ELSE 'body' END AS context_category FROM (SELECT lower('body ' || text) AS t FROM documents)) GROUP BY 1""")
def context_category(t) -> DataFrame:
    return t("documents").groupBy(text.context_category(F.lit("body"), F.col("text")).alias("context_category")).agg(F.count("*").alias("n"))


@query(f"SELECT technique, count(*) AS n FROM (SELECT unnest(list_distinct({_all(P.TECHNIQUE)})) AS technique FROM {_ADV}) GROUP BY technique")
def ttp_explicit(t) -> DataFrame:
    return advisories(t).select(F.explode(classify.explicit_techniques(F.col("text"))).alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))


@query(f"SELECT technique, count(*) AS n FROM (SELECT unnest(list_concat(['T1566.001', 'T1566.002'], CASE WHEN contains(lower(text), 'c2') THEN ['T1071.001', 'T1102'] ELSE [] END)) AS technique FROM {_ADV}) GROUP BY 1")
def ttp_behaviour(t) -> DataFrame:
    return advisories(t).select(F.explode(classify.behaviour_techniques(F.col("text"))).alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))


@query(f"SELECT regexp_matches(text, {_q(P.ZERO_DAY)}) AS zero_day, regexp_matches(text, {_q(P.EXPLOITED)}) AS exploited, count(*) AS n FROM {_ADV} GROUP BY 1, 2")
def zero_day_flags(t) -> DataFrame:
    return advisories(t).groupBy(classify.zero_day(F.col("text")).alias("zero_day"), classify.actively_exploited(F.col("text")).alias("exploited")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(t) -> DataFrame:
    return t("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT name_key, arg_max(name, length(name) * 1000000000 - pos) AS name, min(pos) AS position, count(*) AS variants FROM (
        SELECT trim(regexp_replace(lower(name), '[_\\-.\\s]+', ' ', 'g')) AS name_key, name, pos FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', '-') || CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END END AS name, p_partkey AS pos FROM part)) GROUP BY 1""")
def smart_dedup_names(t) -> DataFrame:
    name = F.expr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', '-') || CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END END")
    return relational.smart_distinct(t("part").select(name.alias("name"), "p_partkey"), "name", F.col("p_partkey"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([lower(p_brand), lower(split_part(p_type, ' ', 1)), lower(split_part(p_type, ' ', 2))], lambda x: x <> ''))), '|') AS tags FROM part")
def merge_dedup_lists(t) -> DataFrame:
    merged = relational.merge_lists(F.array("p_brand"), F.slice(F.split("p_type", " "), 1, 2), F.array("p_brand"), normalise=F.lower)
    return t("part").select("p_partkey", F.array_join(F.array_sort(merged), "|").alias("tags"))


_TOKENS = "CAST(floor((len(list_filter(string_split(t, ' '), lambda w: w <> '')) * 1.3 + length(t) / 3.5) / 2) AS BIGINT)"


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def token_estimate(t) -> DataFrame:
    return t("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT CASE WHEN n <= 1000 THEN 'full' WHEN n <= 1500 THEN 'truncate' ELSE 'chunk' END AS strategy, count(*) AS n FROM (SELECT {_TOKENS} AS n FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)) GROUP BY 1")
def llm_strategy(t) -> DataFrame:
    return t("documents").groupBy(text.input_strategy(F.col("text")).alias("strategy")).agg(F.count("*").alias("n"))


def _matches(found, column: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(p)})" for p in found) + ")"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_matches(found)} THEN {score}" for score, found in P.RELEVANCE) + " ELSE 1 END AS relevance FROM documents")
def relevance_score(t) -> DataFrame:
    return t("documents").select("doc_id", classify.relevance(F.col("text")).alias("relevance"))


@query("SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['unknown'] ELSE l END) AS label FROM (SELECT list_filter([" + ", ".join(f"CASE WHEN {_matches(found, 't')} THEN '{k}' END" for k, found in P.MOTIVATIONS.items())
       + "], lambda x: x IS NOT NULL) AS l FROM (SELECT lower(text) AS t FROM documents))) GROUP BY label")
def motivation_labels(t) -> DataFrame:
    return t("documents").select(F.explode(classify.motivations(F.col("text"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT {_matches(P.TENSION, 'lower(text)')} AS high_tension, count(*) AS n FROM documents GROUP BY 1")
def high_tension(t) -> DataFrame:
    return t("documents").groupBy(classify.high_tension(F.col("text")).alias("high_tension")).agg(F.count("*").alias("n"))


@query(f"SELECT role, regexp_matches(text, {_q(P.CYBER_WORDS)}) AS cyber_related, count(*) AS n FROM conversations GROUP BY 1, 2")
def cyber_related(t) -> DataFrame:
    return t("conversations").groupBy("role", classify.cyber_related(F.col("text")).alias("cyber_related")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_join(_all(P.SUMMARY_FACTS['Cves']))} AS cves, {_join(_all(P.SUMMARY_FACTS['Iocs']))} AS iocs, {_join(_all(P.SUMMARY_FACTS['Techniques']))} AS techniques FROM documents")
def text_summary_facts(t) -> DataFrame:
    facts = classify.summary_facts(F.col("text"))
    return t("documents").select("doc_id", *(F.array_join(facts[i]["found"], "|").alias(name) for i, name in ((2, "cves"), (3, "iocs"), (4, "techniques"))))


@query(f"SELECT doc_id, ip, left(substr(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1) + length(ip) + 50), 200) AS snippet FROM (SELECT doc_id, text, ip, instr(text, ip) AS pos FROM (SELECT doc_id, text, unnest(list_distinct({_all(P.IPV4)})) AS ip FROM documents))")
def evidence_snippets(t) -> DataFrame:
    rows = t("documents").select("doc_id", "text", F.explode(indicators.distinct_matches(F.col("text"), P.IPV4)).alias("ip"))
    return rows.select("doc_id", "ip", text.snippet(F.col("text"), F.col("ip")).alias("snippet"))


@query("SELECT doc_id, w AS entity FROM documents, (SELECT unnest(['the', 'der', 'que', 'les', 'tion', 'clown']) AS w) WHERE contains(lower(text), w)")
def entity_containment(t) -> DataFrame:
    words = F.array(*map(F.lit, ("the", "der", "que", "les", "tion", "clown")))
    return t("documents").select("doc_id", F.explode(F.filter(words, lambda w: F.contains(F.lower("text"), w))).alias("entity"))


def _mod(digest: str, digits: int) -> str:
    """A hexadecimal digest modulo 384, by limbs of seven digits."""
    out = "0"
    for at in range(0, digits, 7):
        size = min(7, digits - at)
        out = f"(({out}) * {16**size % 384} + CAST('0x' || substr({digest}, {at + 1}, {size}) AS BIGINT)) % 384"
    return out


@query(f"""WITH k AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_q(search.TOKEN)})) AS token FROM documents) GROUP BY ALL),
        d AS (SELECT token, md5(token) AS m, sha1(token) AS s FROM (SELECT DISTINCT token FROM k)),
        h AS (SELECT token, {_mod('m', 32)} AS b1, {_mod('s', 40)} AS b2, CASE WHEN CAST('0x' || m[32] AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w1, CASE WHEN CAST('0x' || s[40] AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w2 FROM d),
        v AS (SELECT doc_id, b, sum(w) AS w FROM (SELECT doc_id, b1 AS b, w1 * n AS w FROM k JOIN h USING (token) UNION ALL SELECT doc_id, b2, w2 * n FROM k JOIN h USING (token)) GROUP BY ALL HAVING sum(w) <> 0)
        SELECT doc_id, count(*) AS buckets, CAST(round(sum(b * w)) AS BIGINT) AS checksum, CAST(round(sum(w * w)) AS BIGINT) AS square FROM v GROUP BY doc_id""")
def embed_feature_hash(t) -> DataFrame:
    v = search.weights(t("documents"), "doc_id", "text")
    sums = v.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum(F.col("bucket") * F.col("w")).alias("c"), F.sum(F.col("w") * F.col("w")).alias("s"))
    return sums.select("doc_id", "buckets", F.round("c").cast("long").alias("checksum"), F.round("s").cast("long").alias("square"))


_TOP = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings"


def _top(t, **kinds) -> DataFrame:
    e = t("embeddings")
    return search.search_vectors(e, e.filter("vec_id = 0"), **kinds).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({_TOP}) ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk(t) -> DataFrame:
    return _top(t, k=10)


@query(f"SELECT * FROM ({_TOP} WHERE label = 3) ORDER BY score DESC, vec_id LIMIT 5")
def vec_topk_filtered(t) -> DataFrame:
    return _top(t, k=5, where=F.col("label") == 3)


@query(f"SELECT * FROM ({_TOP}) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 50")
def vec_threshold(t) -> DataFrame:
    return _top(t, k=50, least=0.2)


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vec_dim_guard(t) -> DataFrame:
    size = F.size(fields.checked_vector(F.col("embedding"), 64)).cast("long")
    return t("embeddings").groupBy(size.alias("dim")).agg(F.count("*").alias("n"))


_VECTORS = f"""k AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_q(search.TOKEN)})) AS token FROM x) GROUP BY ALL),
        d AS (SELECT token, md5(token) AS m, sha1(token) AS s FROM (SELECT DISTINCT token FROM k)),
        h AS (SELECT token, {_mod('m', 32)} AS b1, {_mod('s', 40)} AS b2, CASE WHEN CAST('0x' || m[32] AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w1, CASE WHEN CAST('0x' || s[40] AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w2 FROM d),
        v AS (SELECT doc_id, b, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT doc_id, b1 AS b, w1 * n AS w FROM k JOIN h USING (token) UNION ALL SELECT doc_id, b2, w2 * n FROM k JOIN h USING (token)) GROUP BY ALL HAVING sum(w) <> 0)"""
_TERMS = "the clown at 227.5.221.1"


@query(f"""WITH x AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{_TERMS}'), {_VECTORS}, n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1), q AS (SELECT b, w / norm AS q FROM v JOIN n USING (doc_id) WHERE doc_id = -1),
        e AS (SELECT doc_id FROM documents WHERE contains(upper(text), '227.5.221.1')), s AS (SELECT v.doc_id, sum(w / norm * q) AS score FROM v JOIN n USING (doc_id) JOIN q USING (b) WHERE v.doc_id <> -1 GROUP BY 1)
        SELECT doc_id, CAST(stage AS INTEGER) AS stage, round(score, 6) AS score FROM (SELECT doc_id, 0 AS stage, CAST(1.5 AS DOUBLE) AS score FROM e UNION ALL SELECT doc_id, 1, score FROM s WHERE score >= 0 AND doc_id NOT IN (SELECT doc_id FROM e))
        ORDER BY stage, round(score, 9) DESC, doc_id LIMIT 10""")
def search_hybrid(t) -> DataFrame:
    return search.hybrid_search(t("documents"), _TERMS).select("doc_id", "stage", F.round("score", 6).alias("score"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_metadata(t) -> DataFrame:
    return t("pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM pages""")
def html_text(t) -> DataFrame:
    return t("pages").select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("digest"))


def _weight(kind: str, column: str) -> str:
    w, found = P.KIND_PATTERNS[kind]
    return "least(1.0, round(" + " + ".join(f"CASE WHEN regexp_matches({column}, {_q(p)}) THEN {w} ELSE 0 END" for p in found) + ", 2))"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN greatest(s, m, r, h, j) < 0.2 THEN 'TEXT' WHEN s >= greatest(m, r, h, j) THEN 'STIX' WHEN m >= greatest(r, h, j) THEN 'MISP' WHEN r >= greatest(h, j) THEN 'RSS' WHEN h >= j THEN 'HTML' ELSE 'JSON' END AS kind
        FROM (SELECT {_weight('STIX', 'x')} AS s, {_weight('MISP', 'left(x, 2048)')} AS m, {_weight('RSS', 'left(x, 2048)')} AS r, {_weight('HTML', 'left(x, 2048)')} AS h, CASE WHEN x LIKE '{{%' AND json_valid(x) THEN 0.3 ELSE 0 END AS j
        FROM (SELECT html AS x FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT text FROM documents))) GROUP BY kind""")
def detect_kind(t) -> DataFrame:
    x = t("pages").select(F.col("html").alias("x")).unionAll(t("events").select("props")).unionAll(t("documents").select("text"))
    return x.groupBy(classify.detect_kind(F.col("x"), F.lit(""))["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props_flatten(t) -> DataFrame:
    return parsing.json_pairs(t("events"), "event_id", "props")


@query()
def html_to_markdown(t) -> DataFrame:
    return parsing.html_markdown(t("pages"))


_TITLED = "array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_MARKDOWN_LINE = f"""CASE WHEN t = '' THEN '' WHEN length(t) > 5 AND upper(t) = t AND lower(t) <> t AND NOT regexp_matches(t, '[.,!?]') THEN '## ' || {_TITLED} WHEN regexp_matches(t, '^[A-Z][A-Za-z\\s]+:?\\s*$') AND length(t) < 50 THEN '### ' || t
    WHEN regexp_matches(t, '^[-*•]\\s+') THEN '- ' || regexp_replace(t, '^[-*•]\\s+', '') WHEN regexp_matches(t, '^\\d+[.)]\\s+') THEN '1. ' || regexp_replace(t, '^\\d+[.)]\\s+', '') ELSE regexp_replace(t, '(https?://[^\\s]+)', '[\\1](\\1)', 'g') END"""


@query(f"""WITH l AS (SELECT doc_id, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
        j AS (SELECT doc_id, string_agg({_MARKDOWN_LINE}, chr(10) ORDER BY i) AS m FROM l GROUP BY doc_id)
        SELECT doc_id, md5(regexp_replace(regexp_replace(m, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM j""")
def text_to_markdown(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5(text.text_to_markdown(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.source = 'src0' AND d.n_chars BETWEEN 500 AND 5000 AND l.toxic = 0")
def payload_filter_and(t) -> DataFrame:
    rows = t("documents").withColumn("tags", F.array("lang")).withColumn("published_at_ts", F.col("n_chars"))
    return rows.filter(search.payload_filter(source="src0", after=500, before=5000)).join(t("labels").filter("toxic = 0"), "doc_id").select("doc_id", "quality")


@query(f"SELECT l_orderkey, l_linenumber, cve FROM (SELECT l_orderkey, l_linenumber, l_suppkey, regexp_extract(text, {_q(P.CVE)}) AS cve FROM {_ADV}) WHERE l_suppkey % 5 = 1 AND cve = (SELECT min(regexp_extract(text, {_q(P.CVE)})) FROM {_ADV} WHERE l_suppkey % 5 = 1)")
def by_tenant_first_cve(t) -> DataFrame:
    rows = advisories(t).filter("l_suppkey % 5 = 1").select("l_orderkey", "l_linenumber", F.regexp_extract("text", P.CVE, 0).alias("cve"))
    return rows.join(F.broadcast(rows.agg(F.min("cve").alias("first_cve"))), F.col("cve") == F.col("first_cve")).drop("first_cve")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS late FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25' GROUP BY event_type")
def time_range_count(t) -> DataFrame:
    rows = t("events").filter("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25'")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("late"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1")
def last_seven_days(t) -> DataFrame:
    return t("events").filter("ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) ELSE 0 END AS published_ts, event_id % 3 = 0 AS updated FROM events")
def backfill_null_ts(t) -> DataFrame:
    rows = t("events").withColumn("published_ts", F.when(F.col("event_id") % 3 != 0, F.lit(0).cast("long")))
    return relational.backfill(rows, "published_ts", F.unix_timestamp("ts")).select("event_id", "published_ts", "updated")


@query("SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'reviewed' ELSE 'open' END AS state, count(*) AS n FROM orders GROUP BY 1, 2")
def set_payload_by_filter(t) -> DataFrame:
    rows = stores.set_payload(t("orders").withColumn("state", F.lit("open")), F.col("o_totalprice") > 200000, state=F.lit("reviewed"))
    return rows.groupBy("o_orderstatus", "state").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(t) -> DataFrame:
    return relational.latest(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"WITH u AS ({_CANON}) SELECT page_id, canonical_url FROM u WHERE canonical_url NOT IN (SELECT canonical_url FROM u WHERE page_id % 3 = 0)")
def skip_processed_urls(t) -> DataFrame:
    rows = t("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return relational.unseen(rows, rows.filter("page_id % 3 = 0"), "canonical_url").select("page_id", "canonical_url")


@query("""WITH a AS (SELECT CAST(c_custkey AS STRING) AS id, c_name AS name FROM customer), b AS (SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name FROM supplier)
        SELECT name, length(id) = 64 AS renamed FROM (SELECT id, name FROM a UNION ALL SELECT CASE WHEN b.id IN (SELECT id FROM a) THEN repeat('x', 64) ELSE b.id END, name FROM b)""")
def merge_sources_fix_ids(t) -> DataFrame:
    a = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    b = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return relational.merge_sources(a, b).select("name", (F.length("id") == 64).alias("renamed"))


@query("""SELECT d.doc_id, coalesce(d.source, '') AS source, coalesce(l.quality = 1, false) AS good, coalesce(CAST(l.toxic AS DOUBLE), 0.0) AS toxic,
        round((CASE WHEN d.source <> '' THEN 1 ELSE 0 END + CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l.toxic IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / 3, 1) AS completeness FROM documents d LEFT JOIN labels l USING (doc_id)""")
def heal_artifacts(t) -> DataFrame:
    rows = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    rated = relational.completeness(rows, ["source", "quality", "toxic"]).withColumn("good", F.col("quality"))
    return relational.heal(rated, strings=["source"], flags=["good"], numbers=["toxic"]).select("doc_id", "source", "good", "toxic", F.col("completeness").cast("double").alias("completeness"))


@query("SELECT event_type AS agent, CAST(sum(user_id) AS BIGINT) AS prompt, round(sum(value), 4) AS cost, count(*) AS calls FROM events GROUP BY ROLLUP (event_type)")
def token_usage_rollup(t) -> DataFrame:
    rows = t("events").select(F.col("event_type").alias("agent"), F.col("user_id").alias("prompt"), F.col("value").alias("cost"))
    return relational.totals(rows, "agent", "prompt", "cost").withColumn("cost", F.round("cost", 4))


@query("SELECT model, count(*) AS calls, round(sum(tokens * CASE WHEN model LIKE '%mini%' THEN 0.15 WHEN model LIKE '%4o%' THEN 2.5 ELSE 1.0 END / 1000000), 9) AS cost FROM (SELECT CASE event_type WHEN 'click' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-4o-mini' ELSE 'other' END AS model, user_id AS tokens FROM events) GROUP BY model")
def run_cost(t) -> DataFrame:
    rows = t("events").select(F.when(F.col("event_type") == "click", "gpt-4o").when(F.col("event_type") == "view", "gpt-4o-mini").otherwise("other").alias("model"), F.col("user_id").alias("tokens"))
    price = F.when(F.contains("model", F.lit("mini")), 0.15).when(F.contains("model", F.lit("4o")), 2.5).otherwise(1.0)
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("tokens") * price / 1000000), 9).alias("cost"))


_BIO = "CASE WHEN turn % 3 = 2 THEN '' ELSE concat(split_part(text, ' ', 1), ' ', CASE WHEN turn % 2 = 0 THEN 'B-X' ELSE 'O' END) END"


@query(f"""SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, turn AS line_no, string_split_regex(trim(line), '\\s+')[1] AS token, string_split_regex(trim(line), '\\s+')[2] AS tag FROM (SELECT conv_id, turn, line, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sentence
        FROM (SELECT conv_id, turn, {_BIO} AS line FROM conversations)) WHERE len(string_split_regex(trim(line), '\\s+')) = 2""")
def bio_sentences(t) -> DataFrame:
    return entities.bio_sentences(t("conversations").select("conv_id", "turn", F.expr(_BIO).alias("line")), "conv_id", "turn", "line")


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
        FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents)""")
def points_id_uuid5(t) -> DataFrame:
    return t("documents").select("doc_id", text.point_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_dedup_counts(t) -> DataFrame:
    return feeds.window_counts(t("events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _spans(label: str) -> str:
    """Places of a pattern's matches: the text is split at them, so the parts before a match and the matches before it give its start."""
    pattern = _q(entities.SPAN_PATTERNS[label].replace("(?:\\bIP[: ]+)?", ""))
    start = "CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER)"
    return f"""SELECT doc_id, {start} AS start, {start} + CAST(length(m[i]) AS INTEGER) AS stop, '{label}' AS label, m[i] AS value FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}) AS m FROM documents))"""


@query(" UNION ALL ".join(map(_spans, entities.SPAN_PATTERNS)))
def ner_spans(t) -> DataFrame:
    return entities.spans(t("documents"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p, unnest(range(len(string_split_regex(text, '\\n\\s*\\n')))) AS i FROM documents),
        w AS (SELECT doc_id, list_filter(list_transform(flatten(list(CASE WHEN length(p) // 4 <= 400 THEN [p] ELSE string_split(regexp_replace(p, '\\.\\s+', '.' || chr(1), 'g'), chr(1)) END ORDER BY i)), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM b GROUP BY doc_id),
        r AS (SELECT doc_id, parts, CAST(1 AS BIGINT) AS i, parts[1] AS opened, CAST(NULL AS VARCHAR) AS done FROM w WHERE len(parts) > 0
              UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN i + 1 > len(parts) THEN NULL WHEN fits THEN opened || chr(10) || chr(10) || parts[i + 1] ELSE parts[i + 1] END, CASE WHEN i + 1 > len(parts) OR NOT fits THEN opened END
              FROM (SELECT *, coalesce(length(opened || chr(10) || chr(10) || parts[i + 1]) // 4 <= 400, false) AS fits FROM r WHERE opened IS NOT NULL))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(length(done) AS INTEGER) AS size, md5(done) AS digest FROM r WHERE done IS NOT NULL""")
def paragraph_chunks(t) -> DataFrame:
    rows = t("documents").select("doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"))).alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split('### ' || text, chr(10))) AS line, unnest(range(len(string_split('### ' || text, chr(10))))) AS i FROM documents),
        m AS (SELECT *, length(regexp_extract(trim(line, ' '), '^(#{1,6})', 1)) AS marks FROM l),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE marks > 0),
        c AS (SELECT doc_id, i, line, CAST(min(marks - k) OVER (PARTITION BY doc_id ORDER BY k) + k AS BIGINT) AS run, k, marks FROM h),
        o AS (SELECT m.doc_id, m.i, CASE WHEN c.i IS NULL THEN m.line ELSE repeat('#', CAST(least(c.marks, least(c.run, c.k)) AS BIGINT)) || ' ' || trim(regexp_replace(trim(m.line, ' '), '^#{1,6}\\s*', ''), ' ') END AS line FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.i = m.i)
        SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM o GROUP BY doc_id""")
def markdown_headers(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5(text.clamp_headers(F.concat(F.lit("### "), F.col("text"))).cast("binary")).alias("digest"))


@query(f"""SELECT p_partkey, 'C:\\Users' || p_partkey || '\\app' || p_size || '.dll' AS path, 'powershell -enc ' || repeat('QUJD', 6) || ' in /tmp/x' || p_partkey || '/run.sh' AS command FROM part""")
def host_indicators(t) -> DataFrame:
    x = F.expr(HOST)
    paths = F.filter(indicators.file_paths(x), lambda p: p.startswith("C:") & p.endswith(".dll"))
    return t("part").select("p_partkey", paths[0].alias("path"), indicators.commands(x)[0].alias("command"))


_STIX = """concat('{"type":"bundle","id":"b', CAST(o_orderkey AS STRING), '","objects":[{"type":"malware","id":"m","name":"m', CAST(o_custkey AS STRING), '"},{"type":"report","id":"r","name":"', o_orderpriority, '"},{"type":"relationship","id":"e","relationship_type":"', o_orderstatus, '","source_ref":"r","target_ref":"m"}]}')"""


@query("SELECT relationship_type, source_name, count(*) AS n, count(DISTINCT target_name) AS targets FROM (SELECT o_orderstatus AS relationship_type, o_orderpriority AS source_name, 'm' || o_custkey AS target_name FROM orders) GROUP BY 1, 2")
def stix_graph(t) -> DataFrame:
    edges = parsing.stix_graph(t("orders").select("o_orderkey", F.expr(_STIX).alias("x")), "o_orderkey", "x")
    return edges.groupBy("relationship_type", "source_name").agg(F.count("*").alias("n"), F.countDistinct("target_name").alias("targets"))


_MISP = """concat('{"Event":{"info":"', c_name, '","Attribute":[{"type":"ip-dst","value":"10.0.0.', CAST(c_custkey % 250 AS STRING), '","to_ids":true}],"Object":[{"name":"file","Attribute":[{"type":"md5","value":"', md5(c_name), '"}]}]}}')"""


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS object_name, 'ip-dst' AS type, '10.0.0.' || c_custkey % 250 AS value FROM customer UNION ALL SELECT c_custkey, 'file', 'md5', md5(c_name) FROM customer")
def misp_attributes(t) -> DataFrame:
    return parsing.misp_attributes(t("customer").select("c_custkey", F.expr(_MISP).alias("x")), "c_custkey", "x").select("c_custkey", "object_name", "type", "value")


_RSS = "concat('<rss version=\"2.0\"><channel><title>', s_name, '</title><link>http://h/</link><item><title>A', CAST(s_suppkey AS STRING), '</title><link>http://h/', CAST(s_suppkey AS STRING), '</link><description>x</description></item><item><title>B</title><description>no link</description></item></channel></rss>')"


@query("SELECT s_suppkey, s_name AS feed_title, 'A' || s_suppkey AS title, 'http://h/' || s_suppkey AS link FROM supplier")
def rss_items(t) -> DataFrame:
    return parsing.feed_items(t("supplier").select("s_suppkey", F.expr(_RSS).alias("x")), "s_suppkey", "x").select("s_suppkey", "feed_title", "title", "link")


_LINE = """CASE WHEN event_id % 3 = 0 THEN concat('{"_id":"e', CAST(event_id AS STRING), '","text":"', event_type, '"}') WHEN event_id % 3 = 1 THEN concat('plain ', event_type) ELSE '' END"""


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE 'string-' || event_id END AS record_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'plain ' || event_type END AS text FROM events WHERE event_id % 3 < 2")
def json_records(t) -> DataFrame:
    return readers.json_records(t("events").select("event_id", F.expr(_LINE).alias("line")), "event_id", "line").select("record_id", "text")


@query("SELECT event_id, event_id % 2 = 0 AS fixed FROM events")
def repair_json_lines(t) -> DataFrame:
    line = F.expr("concat(CASE WHEN event_id % 2 = 0 THEN '{name: \"' ELSE '{name \"' END, event_type, '\", seen: True, none: None,} # note')")
    return t("events").select("event_id", F.try_parse_json(readers.repair_json(line)).isNotNull().alias("fixed"))


@query("SELECT page_id, 'text/html' AS mime, octet_length(encode(html)) AS n_bytes, sha256(html) AS sha256 FROM pages")
def fetched_pages(t) -> DataFrame:
    got = readers.fetched(F.col("html"))
    return t("pages").select("page_id", readers.media_type(F.col("html"), F.lit("text/html; charset=utf-8"), F.col("url")).alias("mime"), got["n_bytes"].cast("long").alias("n_bytes"), got["sha256"].alias("sha256"))


@query("SELECT n.n_nationkey AS id, 'cti_' || n.n_nationkey || '.json' AS path FROM nation n")
def artifact_paths(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("id"), writers.default_path(F.lit(""), F.col("n_nationkey")).alias("path"))


@query("SELECT r_regionkey, len(generate_series(1, r_regionkey + 1)) + 1 AS pages FROM region")
def page_ranges(t) -> DataFrame:
    spec = F.concat(F.lit("1-"), (F.col("r_regionkey") + 1).cast("string"), F.lit(",9"))
    return t("region").select("r_regionkey", F.size(text.page_range(spec)).cast("long").alias("pages"))


@query("SELECT doc_id, CASE WHEN doc_id >= 100 THEN 0 ELSE 1 END AS pass FROM documents")
def resume_scan(t) -> DataFrame:
    return readers.resume(t("documents"), "doc_id", 100).select("doc_id", "pass")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def scroll_page(t) -> DataFrame:
    return relational.page(t("events").select("event_id", "event_type"), "event_id", 500, 50)


def _clean(listed: str) -> str:
    """What healing makes of a list: trimmed, without repeats and empty entries, joined."""
    return f"coalesce(array_to_string(list_filter(list_distinct(list_transform({listed}, lambda x: trim(x, ' '))), lambda x: x <> ''), chr(10)), '')"


def _ordered(listed: str) -> str:
    """The distinct entries of a list by their first place, joined."""
    return f"array_to_string(list_filter({listed}, lambda x, i: list_position({listed}, x) = i), chr(10))"


_KIND = f"""CASE WHEN greatest(s, m, r, h, j) < 0.2 THEN 'TEXT' WHEN s >= greatest(m, r, h, j) THEN 'STIX' WHEN m >= greatest(r, h, j) THEN 'MISP' WHEN r >= greatest(h, j) THEN 'RSS' WHEN h >= j THEN 'HTML' ELSE 'JSON' END"""
_WEIGHTS = f"{_weight('STIX', 'text')} AS s, {_weight('MISP', 'left(text, 2048)')} AS m, {_weight('RSS', 'left(text, 2048)')} AS r, {_weight('HTML', 'left(text, 2048)')} AS h, 0 AS j"
_URLS = f"list_filter(list_transform({_all(P.URL)}, lambda u: regexp_replace(u, '[.,;:!?)]+$', '')), lambda u: length(u) > 10 AND NOT regexp_matches(lower(u), '^https?://(?:www\\.)?(?:example\\.com|test\\.com|localhost)(?:[/:?#]|$)'))"
_LISTED = {
    "cves": _ordered(_all(P.CVE)), "ips": _ordered(_all(P.IPV4)), "domains": _ordered(_all(P.DOMAIN_PAIR)), "hashes": _ordered(f"list_filter(list_transform({_all(P.HASH_EXACT)}, lambda x: lower(x)), lambda x: replace(x, x[1], '') <> '')"),
    "urls": _ordered(_URLS), "emails": _ordered(f"list_transform({_all(P.EMAIL)}, lambda x: lower(x))"), "techniques": _join(_all(P.TECHNIQUE)).replace("'|'", "chr(10)"),
    "motivations": "array_to_string(CASE WHEN len(l) = 0 THEN ['unknown'] ELSE l END, chr(10))",
}
_MOTIVES = "list_filter([" + ", ".join(f"CASE WHEN {_matches(found, 'lower(text)')} THEN '{k}' END" for k, found in P.MOTIVATIONS.items()) + "], lambda x: x IS NOT NULL)"
_FIELDS = ("title", *_LISTED)


def _wide(pattern: str) -> str:
    """A pattern whose word boundaries know all letters; DuckDB's own know ASCII ones alone."""
    other = r"[^\p{L}\p{N}_]"
    return re.sub(r"\\b(?=[A-Za-z(])", lambda _: f"(?:^|{other})", pattern).replace(r"\b", f"(?:$|{other})")


_GEO = [f"regexp_matches(text, {_q(_wide(p))})" for p in (P.GEO_SINGAPORE, P.GEO_ASEAN)]


@query(f"""SELECT * EXCLUDE (fields), round(len(list_filter(fields, lambda f: f <> '')) * 100.0 / {len(_FIELDS)}, 1) AS completeness, array_to_string(list_filter(list_transform(range(1, {len(_FIELDS) + 1}), lambda i: CASE WHEN fields[i] = '' THEN [{", ".join(f"'{f}'" for f in _FIELDS)}][i] END), lambda x: x IS NOT NULL), ',') AS missing FROM (
        SELECT *, [{", ".join(_FIELDS)}] AS fields FROM (
        SELECT doc_id, coalesce(source, '') AS source, sha256(text) AS content_sha256, has_text, {_KIND} AS kind, split_part(text, chr(10), 1) AS title, {", ".join(f"{v} AS {k}" for k, v in _LISTED.items())},
        {_matches(P.TENSION, 'lower(text)')} AS high_tension_event, regexp_matches(text, {_q(P.CYBER_WORDS)}) AS cyber_related, regexp_matches(text, {_q(P.ZERO_DAY)}) AS zero_day_mention, regexp_matches(text, {_q(P.EXPLOITED)}) AS active_exploitation,
        {_GEO[0]} AS affects_singapore, {_GEO[0]} OR {_GEO[1]} AS affects_asean,
        CASE {" ".join(f"WHEN {_matches(found)} THEN {score}" for score, found in P.RELEVANCE)} ELSE 1 END AS relevance, (SELECT {_TOKENS} FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t)) AS tokens
        FROM (SELECT *, {_WEIGHTS}, {_MOTIVES} AS l FROM (SELECT doc_id, source, coalesce(text, '') AS text, length(text) > 0 AS has_text FROM documents))))""")
def artifacts_pipeline(t) -> DataFrame:
    """Every column of the plan, lists put together, so that nothing of it can be pruned."""
    rows = artifacts(t("documents"))
    return rows.select(*(F.array_join(c, "," if c == "missing" else "\n").alias(c) if kind.startswith("array") else F.col(c).cast("double").alias(c) if c == "completeness" else c for c, kind in rows.dtypes))


@query()
def artifacts_columns(t) -> DataFrame:
    """Every column of the plan, lists as their size and digest."""
    rows = artifacts(t("documents"))
    lists = [c for c, kind in rows.dtypes if kind.startswith("array")]
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in lists]
    return rows.select(*(F.sha2(F.array_join(c, "\n").cast("binary"), 256).alias(c) if c in lists else c for c in rows.columns), *sizes)


from . import extended  # noqa: E402  registers its queries too

__all__ = ["ORACLES", "QUERIES", "extended"]
