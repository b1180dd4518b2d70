"""Further registered queries: links, evidence, budgets, feeds, stores, look-ups and the service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import budget, candidates, classify, evidence, fields, indicators, links, network, text
from ..functions import patterns as P
from ..operators import addresses, chunking, cves, parsing, relational, search, stores
from ..sources import readers, writers
from .artifacts import assembled
from .register import _all, _q, query

# Derived texts: the same expression in both engines, with a branch by key.
LINKS = (
    "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('see hxxp://Evil', CAST(p_size AS STRING), '[.]com/a?b=2&utm_source=x&a=', CAST(p_size AS STRING), '. now') "
    "WHEN 1 THEN concat('get https://www.bad', CAST(p_size AS STRING), '.org//x/, or http://test.com/q and more') "
    "WHEN 2 THEN concat('block 10.0.', CAST(p_size % 250 AS STRING), '.7/24 and http://10.1.2.3/24 there') "
    "WHEN 3 THEN concat('path evil', CAST(p_size AS STRING), '.net/index.php?z=1) end') "
    "WHEN 4 THEN concat('at login-mail', CAST(p_size AS STRING), '.co/x http://short') ELSE 'nothing to see' END"
)
LINKS_FOUND = (
    "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('http://evil', CAST(p_size AS STRING), '.com/a?a=', CAST(p_size AS STRING), '&b=2') WHEN 1 THEN concat('https://bad', CAST(p_size AS STRING), '.org//x') "
    "WHEN 3 THEN concat('https://evil', CAST(p_size AS STRING), '.net/index.php?z=1') WHEN 4 THEN concat('https://login-mail', CAST(p_size AS STRING), '.co/x') ELSE '' END"
)


@query(f"SELECT p_partkey, {LINKS_FOUND} AS urls FROM part")
def url_candidates(t) -> DataFrame:
    found = links.url_candidates(F.expr(LINKS), candidates.valid_url)
    return t("part").select("p_partkey", F.array_join(found, "|").alias("urls"))


@query("SELECT p_partkey, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'http://evil' || p_size || '.com:8080/x,y|https://evil' || p_size || '.com:8080/x' WHEN 1 THEN 'https://a' || p_size || '.tk' ELSE '' END AS urls FROM part")
def legacy_urls(t) -> DataFrame:
    line = F.expr("CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN concat('(http://evil', CAST(p_size AS STRING), '.com:8080/x,y)') WHEN 1 THEN concat('visit a', CAST(p_size AS STRING), '.tk') ELSE 'http://1.2.3.4/24 me@b.com hello.php' END")
    found = links.legacy_urls(line, candidates.valid_url, lambda u, x: F.lit(True))
    return t("part").select("p_partkey", F.array_join(found, "|").alias("urls"))


@query("SELECT s_suppkey, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'host' || s_suppkey || '.example.org' WHEN 1 THEN 'bad' || s_suppkey || '.com' ELSE '' END AS domains FROM supplier")
def legacy_domains(t) -> DataFrame:
    line = F.expr("CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('ends with www.host', CAST(s_suppkey AS STRING), '.example.org') WHEN 1 THEN concat('ends with bad', CAST(s_suppkey AS STRING), '[.]com') ELSE concat('other', CAST(s_suppkey AS STRING), '.com is followed by text') END")
    return t("supplier").select("s_suppkey", F.array_join(links.legacy_domains(line, lambda d, x: F.lit(True)), "|").alias("domains"))


@query("""SELECT s_suppkey, '203.0.' || s_suppkey % 250 || '.0/24' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '|10.1.1.1' END || '|8.8.' || s_suppkey % 250 || '.9' AS ips,
        CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS private FROM supplier""")
def ip_candidates(t) -> DataFrame:
    line = F.expr("concat('net 203.0.', CAST(s_suppkey % 250 AS STRING), '.0/24 base 203.0.', CAST(s_suppkey % 250 AS STRING), '.0 host 8.8.', CAST(s_suppkey % 250 AS STRING), '[.]9 serial 4c:b:1d:19:74:86:a7:66 mac 00:11:22:33:44:55 ', repeat('.', 120), CASE WHEN s_suppkey % 2 = 0 THEN ' lan 10.1.1.1 ' ELSE ' beacon 10.1.1.1 ' END)")
    line = F.regexp_replace(line, r"8\.8\.(\d+)\[\.\]9", "8[.]8[.]$1[.]9")
    found = candidates.ip_candidates(line)
    return t("supplier").select("s_suppkey", F.array_join(found, "|").alias("ips"), F.size(F.filter(found, lambda i: i.startswith("10."))).alias("private"))


_IOC = "concat('report of indicators. host evil', CAST(c_custkey AS STRING), '.com at 45.', CAST(c_nationkey % 250 AS STRING), '.7.', CAST(c_custkey % 250 AS STRING), ' hash ', md5(c_mktsegment), ' mail a', CAST(c_nationkey AS STRING), '@corp.org STIX_INDICATOR_PATTERN: [ipv4-addr:value = ''9.9.9.', CAST(c_nationkey % 250 AS STRING), '''] STIX_INDICATOR_PATTERN: [x509-certificate:serial_number = ''4c:b:1d:19:74:86:a7:66'']')"


@query("""SELECT c_custkey, 'corp.org|evil' || c_custkey || '.com' AS domains, array_to_string(list_sort(['45.' || c_nationkey % 250 || '.7.' || c_custkey % 250, '9.9.9.' || c_nationkey % 250]), '|') AS ips,
        md5(c_mktsegment) AS hashes, 'a' || c_nationkey || '@corp.org' AS emails FROM customer""")
def extract_indicators(t) -> DataFrame:
    rows = candidates.extract(t("customer").select("c_custkey", F.expr(_IOC).alias("text")))
    return rows.select("c_custkey", *(F.array_join(k, "|").alias(k) for k in ("domains", "ips", "hashes", "emails")))


@query(f"""SELECT kind, count(*) AS n, count(*) FILTER (good) AS valid FROM (SELECT 'ip' AS kind, regexp_matches(v, '^(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)$') AS good FROM (SELECT unnest({_all(P.IPV4)}) AS v FROM documents)
        UNION ALL SELECT 'hash', length(v) IN (32, 40, 64, 128) FROM (SELECT unnest({_all(P.HASH)}) AS v FROM documents)) GROUP BY kind""")
def validate_indicators(t) -> DataFrame:
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), indicators.matches(F.col("text"), p).alias("v")) for k, p in (("ip", P.IPV4), ("hash", P.HASH)))))
    rows = t("documents").select(found.alias("p")).select("p.kind", F.explode("p.v").alias("v"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(candidates.valid_indicator(F.col("kind"), F.col("v"))).alias("valid"))


@query("""SELECT page_id, CASE WHEN regexp_matches(host, '[a-z0-9]{10,}\\.com') THEN true ELSE false END AS accepted FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host FROM pages)""")
def fallback_verdict(t) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "//([^/?#]*)", 1))
    return t("pages").select("page_id", candidates.accept(host, F.lit("no such words here")).alias("accepted"))


@query(f"SELECT c_custkey, kind, value FROM (SELECT c_custkey, unnest(['ipv4', 'md5', 'excluded']) AS kind, unnest(['9.9.9.' || c_custkey % 250, md5(c_name), '00:11:22:33:44:55']) AS value FROM customer)")
def stix_patterns(t) -> DataFrame:
    line = F.expr("concat('STIX_INDICATOR_PATTERN: [ipv4-addr:value = ''9.9.9.', CAST(c_custkey % 250 AS STRING), '''] STIX_INDICATOR_PATTERN:  [file:hashes.MD5 = ''', md5(c_name), ''' OR ethernet-addr:value = ''00:11:22:33:44:55'']')")
    return t("customer").select("c_custkey", F.explode(indicators.stix_pattern_values(line)).alias("v")).select("c_custkey", "v.kind", "v.value")


@query("SELECT p_partkey, 'https://' || lower(replace(p_brand, '#', '')) || '.com/' || p_size AS url FROM part")
def ioc_url_form(t) -> DataFrame:
    raw = F.expr("concat('  ', CASE WHEN p_partkey % 2 = 0 THEN 'https://' ELSE '' END, lower(replace(p_brand, '#', '')), '.com/', CAST(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.;' ELSE '' END, ' ')")
    return t("part").select("p_partkey", links.ioc_url(raw).alias("url"))


_META = """concat('<html><head><meta charset="utf-8"><title> T', CAST(c_custkey AS STRING), ' </title>', CASE WHEN c_custkey % 2 = 0 THEN concat('<meta name="author" content="A', c_name, '"><META property="og:site_name" content=''S''>') ELSE
    concat('<script type="application/ld+json">{"headline":"H","author":{"name":"J', c_name, '"},"datePublished":"2024-01-0', CAST(1 + c_custkey % 9 AS STRING), '"}</script>') END, '<meta property="og:description" content="D1"><meta content="D', c_mktsegment, '" name="description"></head></html>')"""


@query("""SELECT c_custkey, 'T' || c_custkey AS title, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'J' END || c_name AS author, 'D' || c_mktsegment AS description,
        CASE WHEN c_custkey % 2 = 1 THEN '2024-01-0' || (1 + c_custkey % 9) END AS published_date, CASE WHEN c_custkey % 2 = 0 THEN 'S' END AS site_name FROM customer""")
def page_metadata(t) -> DataFrame:
    return t("customer").select("c_custkey", links.page_metadata(F.expr(_META)).alias("m")).select("c_custkey", "m.*")


_TAG = "lower(text)"


@query(f"""SELECT doc_id, len(l) AS passages, coalesce(l[1], '') AS first FROM (SELECT doc_id, list_transform(list_filter([instr(lower(text), 'tion')], lambda p: p > 0),
        lambda p: trim(regexp_replace(substr(text, greatest(p - 50, 1), least(p + 3 + 50, length(text)) - greatest(p - 51, 0)), '\\s+', ' ', 'g'))) AS l FROM documents)""")
def pattern_evidence(t) -> DataFrame:
    found = evidence.evidence(F.col("text"), ("tion",), most=1)
    return t("documents").select("doc_id", F.size(found).cast("long").alias("passages"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"))


@query("""SELECT doc_id, CASE WHEN p > 0 THEN '[Entity: Clown] ' || trim(regexp_replace(substr(text, greatest(p - 50, 1), p - greatest(p - 50, 1) + 5 + 50), '\\s+', ' ', 'g')) END AS passage FROM (SELECT doc_id, text, instr(lower(text), 'clown') AS p FROM documents)""")
def entity_evidence(t) -> DataFrame:
    return t("documents").select("doc_id", evidence.around_name(F.col("text"), F.lit("Clown")).alias("passage"))


@query("""SELECT doc_id, entity FROM documents JOIN (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS entity FROM part UNION SELECT 'tion' UNION SELECT 'der') ON contains(lower(text), entity)""")
def entity_join(t) -> DataFrame:
    names = t("part").select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("entity")).unionAll(t("region").limit(1).select(F.explode(F.array(F.lit("tion"), F.lit("der")))))
    return relational.mentions(t("documents"), "doc_id", "text", names, "entity")


_ADVICE = "concat('APT29 used T1001 (', repeat('x', 30), ') MITRE ATT&CK technique seen T1059.001 file /tmp/T1234.txt Model T1566 ', repeat('y', CAST(60 + p_size % 7 AS INT)), ' T1', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), ' employs it')"


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(['T1001', 'T1059.001', 'T1' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')])), '|') AS techniques FROM part""")
def technique_contexts(t) -> DataFrame:
    return t("part").select("p_partkey", F.array_join(classify.explicit_techniques(F.expr(_ADVICE)), "|").alias("techniques"))


@query("""SELECT doc AS doc, technique, confidence, source, mentions FROM (SELECT l_orderkey AS doc, 'T' || (1000 + l_suppkey % 5) AS technique, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN l_partkey % 2 = 0 THEN 'explicit' ELSE 'behavioral' END AS source, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 5) AS mentions, l_linenumber AS ln, l_partkey FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY doc, technique ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, source <> 'explicit', CAST(ln AS VARCHAR)) = 1""")
def technique_dedup(t) -> DataFrame:
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("doc"), F.expr("concat('T', CAST(1000 + l_suppkey % 5 AS STRING))").alias("technique"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("confidence"),
        F.expr("CASE WHEN l_partkey % 2 = 0 THEN 'explicit' ELSE 'behavioral' END").alias("source"), F.col("l_linenumber").cast("string").alias("evidence"))
    return classify.best_techniques(rows, "doc").select("doc", "technique", "confidence", "source", "mentions")


@query("SELECT band, severity, count(*) AS n FROM (SELECT CASE WHEN l_discount >= 0.095 THEN 'primary' WHEN l_discount >= 0.07 THEN 'related' WHEN l_discount >= 0.03 THEN 'contextual' ELSE 'reference' END AS band, CASE WHEN l_discount * 10 >= 0.5 THEN l_returnflag ELSE 'NOT_ENRICHED' END AS severity FROM lineitem) GROUP BY ALL")
def relevance_bands(t) -> DataFrame:
    score = F.col("l_discount") * 10
    exact = F.round(score, 6)
    return t("lineitem").groupBy(fields.relevance_band(exact).alias("band"), fields.enriched(exact, F.col("l_returnflag")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT event_id, list_contains(['click', 'view'], event_type) AS scalar_hit, event_type = 'click' OR user_id % 2 = 0 AS list_hit FROM events")
def match_any(t) -> DataFrame:
    tags = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return t("events").select("event_id", fields.match_any(F.col("event_type"), ["click", "view"], False).alias("scalar_hit"), fields.match_any(tags, ["click", "even"], True).alias("list_hit"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"ingested_at_ts\":1,\"note\":null}' ELSE '{\"ingested_at_ts\":1,\"published_at_ts\":2,\"note\":null}' END AS payload FROM events")
def clock_guard(t) -> DataFrame:
    payload = F.create_map(F.lit("ingested_at_ts"), F.lit(1), F.lit("published_at_ts"), F.when(F.col("event_id") % 2 == 1, 2), F.lit("note"), F.lit(None).cast("int"))
    return t("events").select("event_id", F.to_json(fields.without_null_times(payload), {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT p_partkey, p_brand AS one, p_brand || '|' || p_size AS many FROM part")
def tag_lists(t) -> DataFrame:
    both = F.array(F.col("p_brand"), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", F.array_join(fields.tag_list(F.col("p_brand"), "string"), "|").alias("one"), F.array_join(fields.tag_list(both, "array<string>"), "|").alias("many"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'left' END AS a, 'left' AS b, n_name AS c FROM nation")
def map_right_wins(t) -> DataFrame:
    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.col("n_name"), F.lit("c"), F.col("n_name"))).otherwise(F.create_map(F.lit("c"), F.col("n_name")))
    m = fields.map_update(left, right)
    return t("nation").select("n_nationkey", *(m[k].alias(k) for k in "abc"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(v || ' ' || pr, '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS name, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS VARCHAR) END AS version
        FROM (SELECT p_partkey, p_size, lower(replace(p_brand, '#', '_')) AS v, replace(lower(p_type), ' ', '_') AS pr FROM part WHERE p_partkey % 4 > 0)""")
def cpe_names(t) -> DataFrame:
    criteria = F.expr("concat('cpe:2.3:a:', lower(replace(p_brand, '#', '_')), ':', replace(lower(p_type), ' ', '_'), ':', CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS STRING) ELSE '*' END, ':*:*:*:*:*:*:*')")
    rows = t("part").select("p_partkey", fields.cpe_fields(criteria, F.col("p_partkey") % 4 == 0).alias("f"))
    return rows.filter("f is not null").select("p_partkey", "f.name", "f.version")


_CRITERIA = "concat('cpe:2.3:a:v:p', CAST(l_suppkey % 9 AS STRING), ':', CAST(l_linenumber AS STRING), ':*:*:*:*:*:*:*')"


@query("""SELECT l_orderkey AS cve, 'p' || l_suppkey % 9 AS product, CAST(l_linenumber AS VARCHAR) AS version, CASE WHEN l_linenumber % 2 = 0 THEN '1.' || l_linenumber END AS low, CASE WHEN l_linenumber % 2 = 0 THEN '9' END AS high FROM lineitem""")
def cpe_version_bounds(t) -> DataFrame:
    """Platforms of an order's lines against the tree of matches that its even lines give."""
    one = F.struct(F.expr(_CRITERIA).alias("criteria"), F.lit(False).alias("deprecated"), F.lit(None).cast("boolean").alias("vulnerable"))
    none = F.lit(None).cast("string")
    match = F.struct(F.expr(_CRITERIA).alias("criteria"), F.concat(F.lit("1."), F.col("l_linenumber").cast("string")).alias("versionStartIncluding"), none.alias("versionStartExcluding"), none.alias("versionEndIncluding"), F.lit("9").alias("versionEndExcluding"))
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("cve")).agg(F.collect_list(one).alias("cpes"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, match)).alias("m"))
    rows = rows.withColumn("configurations", F.array(F.struct(F.array(F.struct(F.col("m").alias("cpeMatch"))).alias("nodes"))))
    return cves.affected_versions(rows).select("cve", "product", "version", F.col("versionStartIncluding").alias("low"), F.col("versionEndExcluding").alias("high"))


@query("SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') // 86400 > 30 AS patched FROM orders")
def patch_heuristic(t) -> DataFrame:
    return t("orders").select("o_orderkey", fields.patch_likely(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("patched"))


@query("""SELECT severity, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 0.0 END AS score, CASE WHEN a > 0 THEN CASE WHEN a >= 9 THEN 'CRITICAL' WHEN a >= 7 THEN 'HIGH' WHEN a >= 4 THEN 'MEDIUM' ELSE 'LOW' END
        WHEN b > 0 THEN CASE WHEN b >= 7 THEN 'HIGH' WHEN b >= 4 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'UNKNOWN' END AS severity FROM (SELECT round(l_discount * 100, 6) AS a, round(l_tax * 100, 6) AS b FROM lineitem)) GROUP BY severity""")
def cvss_versions(t) -> DataFrame:
    a, b = F.expr("round(l_discount * 100, 6)"), F.expr("round(l_tax * 100, 6)")
    got = fields.cvss(F.lit(None).cast("double"), F.lit(None).cast("string"), a, F.lit("?"), b)
    rows = t("lineitem").select(got.alias("c")).select("c.*")
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("""SELECT o_custkey % 50 AS cve_no, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END), 0.0) AS score, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) IS NOT NULL AS found FROM orders GROUP BY 1""")
def cve_lookup(t) -> DataFrame:
    ids = t("orders").select((F.col("o_custkey") % 50).cast("string").alias("cve"), "o_totalprice", "o_orderkey")
    details = ids.filter("o_orderkey % 3 = 0").groupBy("cve").agg(F.max("o_totalprice").alias("score")).withColumns({"severity": F.lit("HIGH"), "patched": F.lit(True)})
    return cves.looked_up(ids, details).select(F.col("cve").cast("long").alias("cve_no"), "score", "found")


@query("""SELECT 'CVE-2024-' || (10000 + n_nationkey) AS cve FROM nation UNION SELECT 'CVE-2023-' || (20000 + n_regionkey) FROM nation""")
def kev_catalogue(t) -> DataFrame:
    line = F.expr("concat('{\"vulnerabilities\":[{\"cveID\":\"cve-2024-', CAST(10000 + n_nationkey AS STRING), '\"},{\"cveID\":\" 2023-', CAST(20000 + n_regionkey AS STRING), ' \"}]}')")
    return readers.kev_ids(t("nation").select(line.alias("value")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events")
def epoch_variants(t) -> DataFrame:
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(event_id * CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1 END AS STRING) WHEN 1 THEN concat(replace(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', 'T'), 'Z') ELSE '14 November' END")
    return t("events").select("event_id", fields.epoch_seconds(raw).alias("seconds"))


@query("""SELECT event_type AS agent, count(*) AS calls, count(*) FILTER (value >= 0) AS successes, count(*) FILTER (value < 0) AS errors, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 100) AS BIGINT) AS completion_tokens,
        round(sum(CASE WHEN user_id % 2 = 0 THEN user_id * 0.00015 + (event_id % 100) * 0.0006 ELSE user_id * 0.005 + (event_id % 100) * 0.015 END / 1000), 4) AS cost FROM events GROUP BY ROLLUP (event_type)""")
def run_account(t) -> DataFrame:
    rows = t("events").withColumn("agent", F.col("event_type"))
    model = F.when(F.col("user_id") % 2 == 0, "GPT-4o-mini-2024").otherwise("gpt-4o")
    out = stores.run_totals(rows, "agent", model, F.col("user_id"), F.col("event_id") % 100, F.col("value") >= 0)
    return out.withColumn("cost", F.round("cost", 4))


@query("SELECT o_orderstatus, state, count(*) AS n, count(*) FILTER (changed) AS changed FROM (SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'reviewed' ELSE 'open' END AS state, o_totalprice > 200000 AS changed FROM orders) GROUP BY 1, 2")
def set_payload(t) -> DataFrame:
    rows = stores.set_payload(t("orders").withColumn("state", F.lit("open")), F.col("o_totalprice") > 200000, state=F.lit("reviewed"))
    return rows.groupBy("o_orderstatus", "state").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("""SELECT user_id, value FROM (SELECT user_id, value, event_id, 1 AS s FROM events WHERE event_id % 4 = 0 UNION ALL SELECT DISTINCT user_id, -1.0, NULL, 0 FROM events WHERE user_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) = 1""")
def index_merge(t) -> DataFrame:
    index = t("events").filter("user_id % 3 = 0").select("user_id", F.lit(-1.0).alias("value")).distinct()
    return stores.merge(index, t("events").filter("event_id % 4 = 0"), ["user_id"], F.col("event_id"))


@query("SELECT event_type AS kind, array_to_string(list_sort(list_distinct(list(CAST(user_id % 40 AS VARCHAR)))), ',') AS values, count(DISTINCT user_id % 40) AS n FROM events GROUP BY 1")
def index_by_kind(t) -> DataFrame:
    rows = t("events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 40).cast("string").alias("value"))
    return stores.by_kind(rows, "kind", "value").withColumn("values", F.array_join("values", ","))


@query("""SELECT page_id, page_id % 2 = 0 AS existing, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'click') AS clicks, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS cve_index FROM pages""")
def memory_context(t) -> DataFrame:
    docs = t("pages").select("page_id", F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("canonical_url"))
    stored = docs.filter("page_id % 2 = 0").select("canonical_url", F.lit("{}").alias("artifact"))
    iocs = t("events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("value"))
    out = stores.memory_context(docs, stored, iocs, t("lineitem").select(F.col("l_suppkey").cast("string").alias("cve")))
    return out.select("page_id", F.col("existing").isNotNull().alias("existing"), F.col("ioc_index")["click"].alias("clicks"), "cve_index")


@query("SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'running' END AS status, c_custkey % 3 = 0 AS ended FROM customer")
def run_tracking(t) -> DataFrame:
    ids = t("customer").select(F.col("c_custkey").alias("run_id"))
    none = ids.limit(0).select("run_id", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("").alias("status"))
    now = F.lit("2024-01-01").cast("timestamp")
    out = stores.finished(stores.started(none, ids, now), ids.filter("run_id % 3 = 0").withColumn("status", F.lit("done")), now)
    return out.select("run_id", "status", F.col("finished_at").isNotNull().alias("ended"))


@query("SELECT s_suppkey, 'cti_' || (1700000000 + s_suppkey) || '_' || s_suppkey % 7 || '.json' AS path, CASE WHEN s_suppkey % 2 = 0 THEN sha256(s_name) || '.json' ELSE 'cti_5.json' END AS own FROM supplier")
def emission_paths(t) -> DataFrame:
    return t("supplier").select(
        "s_suppkey", stores.feed_path(F.col("s_suppkey") + 1700000000, F.col("s_suppkey") % 7).alias("path"),
        writers.default_path(F.when(F.col("s_suppkey") % 2 == 0, F.sha2(F.col("s_name").cast("binary"), 256)), F.lit(5)).alias("own"))


@query("SELECT page_id AS sha, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'old' END AS artifact_path FROM pages")
def artifact_path_update(t) -> DataFrame:
    rows = t("pages").select(F.col("page_id").cast("string").alias("sha256"), F.lit("old").alias("artifact_path"))
    emitted = rows.filter("cast(sha256 as long) % 3 = 0").select("sha256", F.concat(F.lit("p"), F.col("sha256")).alias("path"))
    return stores.update_paths(rows, emitted).select(F.col("sha256").cast("long").alias("sha"), "artifact_path")


_FEED = """CASE WHEN s_suppkey % 2 = 0 THEN concat('<rss version="2.0"><channel><title>R</title><description>d <b>x</b></description><item><title>A', CAST(s_suppkey AS STRING), '</title><link>http://h/', CAST(s_suppkey AS STRING), '</link><description>s &lt;b&gt;q&lt;/b&gt;</description><pubDate>P</pubDate></item><item><title>B</title></item></channel></rss>')
    ELSE concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><subtitle>d x</subtitle><entry><title>A', CAST(s_suppkey AS STRING), '</title><link rel="self" href="http://s/"/><link href="http://h/', CAST(s_suppkey AS STRING), '"/><summary>s q</summary><updated>P</updated></entry><entry><title>B</title></entry></feed>') END"""


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'F' END AS feed_title, 'd x' AS feed_description, 'A' || s_suppkey AS title, 'http://h/' || s_suppkey AS link, 's q' AS summary, 'P' AS published, 's q' AS content FROM supplier
        UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'F' END, 'd x', 'B', NULL, NULL, NULL, NULL FROM supplier""")
def feed_entries(t) -> DataFrame:
    return parsing.feed_entries(t("supplier").select("s_suppkey", F.expr(_FEED).alias("x")), "s_suppkey", "x")


_EVENTS = """CASE c_custkey % 3 WHEN 0 THEN concat('{"Event":{"info":"', c_name, '","Tag":[{"name":"t', CAST(c_custkey AS STRING), '"}],"EventTag":[{"Tag":{"name":"e"}}],"Attribute":[{"value":"v"}]}}') WHEN 1 THEN concat('{"events":[{"info":"', c_name, '","Attribute":[{"value":"v"}]},{"info":"no"}]}')
    ELSE concat('{"info":"', c_name, '","Attribute":[{"value":"v","comment":"c"}]}') END"""


@query("""SELECT c_custkey, c_name || chr(10) || 'v' || CASE WHEN c_custkey % 3 = 2 THEN chr(10) || 'c' ELSE '' END AS text, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey || '|e' ELSE '' END AS tags FROM customer""")
def misp_forms(t) -> DataFrame:
    x = F.expr(_EVENTS)
    return t("customer").select("c_custkey", parsing.misp_text(x).alias("text"), F.array_join(parsing.misp_tags(x), "|").alias("tags"))


_BUNDLE = """concat(CASE WHEN o_orderkey % 2 = 0 THEN '{"type":"bundle","objects":[' ELSE '[' END, '{"type":"malware","id":"m","name":"M', CAST(o_custkey AS STRING), '","is_family":true,"malware_types":["rat"]},{"type":"report","id":"r1","name":"R","published":"p"},{"type":"report","id":"r2","name":"S"},{"type":"x-other","id":"o"},{"type":"indicator","id":"i","name":"I","pattern":"[x]","indicator_types":["c2"]}', CASE WHEN o_orderkey % 2 = 0 THEN ']}' ELSE ']' END)"""


@query("""SELECT o_orderkey, type, id, CASE WHEN type = 'malware' THEN true END AS is_family, CASE WHEN type = 'indicator' THEN '[x]' END AS pattern, CASE WHEN id = 'r1' THEN 'p' END AS published, id = 'r1' AS main_report, CASE type WHEN 'malware' THEN 'M' || o_custkey WHEN 'indicator' THEN 'I' ELSE CASE id WHEN 'r1' THEN 'R' ELSE 'S' END END AS name
        FROM (SELECT o_orderkey, o_custkey, unnest(['malware', 'report', 'report', 'indicator']) AS type, unnest(['m', 'r1', 'r2', 'i']) AS id FROM orders)""")
def stix_objects(t) -> DataFrame:
    rows = parsing.stix_nodes(t("orders").select("o_orderkey", F.expr(_BUNDLE).alias("x")), "o_orderkey", "x")
    return rows.select("o_orderkey", "type", "id", "is_family", "pattern", "published", "main_report", "name")


@query("""SELECT event_id, 'Summary: type: ' || event_type || chr(10) || chr(10) || '{' || chr(10) || '  type: "' || event_type || '"' || chr(10) || '  v: [' || chr(10) || '    [0]: ' || user_id || chr(10) || '    [1]: null' || chr(10) || '  ]' || chr(10) || '  e: {}' || chr(10) || '}' AS text, 3 AS leaves FROM events""")
def json_readable(t) -> DataFrame:
    line = F.expr("concat('{\"type\":\"', event_type, '\",\"v\":[', CAST(user_id AS STRING), ',null],\"e\":{}}')")
    return parsing.json_normalised(t("events").select("event_id", line.alias("x")), "event_id", "x").select("event_id", "text", F.size("flat").alias("leaves"))


@query("SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b FROM orders")
def array_records(t) -> DataFrame:
    line = F.expr("concat('[{\"a\":\"', o_orderpriority, '\"},[{\"b\":\"', o_orderstatus, '\"},7],\"text\",null]')")
    r = readers.array_records(line)
    return t("orders").select("o_orderkey", F.get_json_object(F.get(r, F.lit(0)), "$.a").alias("a"), F.get_json_object(F.get(r, F.lit(1)), "$.b").alias("b"))


@query("SELECT event_id, event_type AS name FROM events WHERE event_id % 4 < 2")
def repaired_records(t) -> DataFrame:
    line = F.expr("CASE event_id % 4 WHEN 0 THEN concat('{name: \"', event_type, '\", seen: True,} # note') WHEN 1 THEN concat('{''name'': ''', event_type, ''', ''t'': (1, 2)}') WHEN 2 THEN '{}' ELSE 'no record at all' END")
    rows = readers.repaired_records(t("events").select("event_id", line.alias("line")), "line")
    return rows.select("event_id", F.get_json_object("record", "$.name").alias("name"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/xml' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages""")
def media_types(t) -> DataFrame:
    k = F.col("page_id") % 4
    header, url = F.when(k == 0, "application/xml; charset=x").otherwise(""), F.when(k == 1, "http://h/a.json?x=1").otherwise("http://h.com/")
    return t("pages").select("page_id", readers.media_type(F.when(k == 3, "plain words").otherwise(F.left("html", F.lit(200))), header, url).alias("mime"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'fallback' END AS text FROM documents")
def parser_dispatch(t) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "TEXT").when(F.col("doc_id") % 3 == 0, "PDF").otherwise("ODD")
    parsers = {"TEXT": lambda c: budget.decoded(c), "PDF": lambda c: F.lit("  ")}
    content = F.base64(F.col("text").cast("binary"))
    rows = t("documents").withColumn("c", content)
    out = budget.parsed_text(kind, F.col("c"), parsers, lambda c: F.lit("fallback"))
    return rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.when(out == F.regexp_replace("text", r"^\s+|\s+$", ""), F.col("text")).otherwise(out)).otherwise(out).alias("text"))


@query("SELECT doc_id, CAST(least(5, greatest(1, ceil(length(text) / 4000.0))) AS INTEGER) AS chunks, md5(substr(text, 4001, 4000)) AS second FROM documents")
def content_chunks(t) -> DataFrame:
    c = budget.content_chunks(F.col("text"), 4000)
    return t("documents").select("doc_id", F.size(c).alias("chunks"), F.md5(F.coalesce(F.get(c, F.lit(1)), F.lit("")).cast("binary")).alias("second"))


@query("""SELECT conv_id, turn, '## EXECUTIVE VIEW' || chr(10) || '### LONG HEADER' || chr(10) || '- item' || chr(10) || '1. step' || chr(10) || chr(10) || trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS markdown FROM conversations WHERE length(text) > 120""")
def pdf_page_rules(t) -> DataFrame:
    lines = F.concat_ws("\n", F.lit("EXECUTIVE VIEW"), F.lit("  LONG HEADER "), F.lit("• item"), F.lit("2) step"), F.lit(""), F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"\s+", " ")))
    return t("conversations").filter("length(text) > 120").select("conv_id", "turn", budget.pdf_page_markdown(lines).alias("markdown"))


@query("SELECT conv_id, count(*) AS pages, string_agg(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def pdf_document(t) -> DataFrame:
    """Pages of one line each put together behind their numbers, which the cleaning takes away again."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    pages = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", flat.alias("x")))).alias("p"), F.count("*").alias("pages"))
    return pages.select("conv_id", "pages", F.regexp_replace(budget.pdf_document_text(F.transform("p", lambda p: p["x"])), r"\n{3,}", "\n\n").alias("text"))


@query("""SELECT doc_id, CAST(n AS BIGINT) AS n, first FROM (SELECT doc_id, len(l) AS n, l[1] AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE length(text) BETWEEN 1 AND 1500))""")
def budget_whole(t) -> DataFrame:
    """A long last line that does not fit: the structured cut has every line before it, and the first part of this one."""
    rows = t("documents").filter("length(text) between 1 and 1500").select("doc_id", "text", F.split(budget.truncated(F.concat(F.col("text"), F.lit("\n" + "word " * 4000)), 4000), "\n").alias("l"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    same = F.size(F.array_except(lines, F.col("l"))) == 0
    return rows.select("doc_id", F.when(same, F.size(lines)).cast("long").alias("n"), F.get(lines, F.lit(0)).alias("first"))


@query("""SELECT doc_id, strategy, CASE WHEN strategy = 'full' THEN text END AS whole FROM (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 'empty' WHEN n <= 400 THEN 'full' WHEN n <= 600 THEN 'truncated' ELSE 'chunked_classified_summarized' END AS strategy
        FROM (SELECT doc_id, text, CAST(floor((len(list_filter(string_split(t, ' '), lambda w: w <> '')) * 1.3 + length(t) / 3.5) / 2) AS BIGINT) AS n FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)))""")
def prepared_input(t) -> DataFrame:
    p = budget.prepared(F.col("text"), 400)
    rows = t("documents").select("doc_id", p.alias("p"))
    return rows.select("doc_id", F.col("p.processing_strategy").alias("strategy"), F.when(F.col("p.processing_strategy") == "full", F.col("p.text")).alias("whole"))


@query("""SELECT o_orderkey, 'Title: ' || o_orderpriority || chr(10) || chr(10) || 'CVEs mentioned: CVE-1, CVE-2' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'IOCs found: 2 URLs, 1 IPs' ELSE '' END AS text FROM orders WHERE o_orderkey % 3 > 0
        UNION ALL SELECT o_orderkey, repeat('x', 5000) || '... [truncated for analysis]' FROM orders WHERE o_orderkey % 3 = 0""")
def cyber_input(t) -> DataFrame:
    rows = t("orders").withColumn("k", F.col("o_orderkey") % 3 > 0).withColumn("e", F.col("o_orderkey") % 2 == 0)
    some = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    none = F.array().cast("array<string>")
    lists = {"URLs": F.when(F.col("k") & F.col("e"), some("a", "b")).otherwise(none), "domains": none, "hashes": none, "IPs": F.when(F.col("k") & F.col("e"), some("c")).otherwise(none)}
    out = budget.cyber_input(F.when(F.col("k"), F.col("o_orderpriority")), F.lit(""), F.when(F.col("k"), some("CVE-1", "CVE-2")).otherwise(none), lists, none, F.lit("x" * 6000))
    return rows.select("o_orderkey", out.alias("text"))


@query("SELECT event_id, user_id, fmod(user_id, 2) = 0 AS even, 64 AS size FROM events JOIN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64) ON vec_id = event_id")
def checked_vectors(t) -> DataFrame:
    good = t("embeddings").select("vec_id", fields.checked_vector(F.col("embedding"), 64).alias("v")).filter(F.size("v") == 64)
    return t("events").join(good, F.col("vec_id") == F.col("event_id")).select("event_id", "user_id", (F.col("user_id") % 2 == 0).alias("even"), F.size("v").alias("size"))


@query("SELECT page_id, 384 AS size, CAST(0 AS DOUBLE) AS norm FROM pages")
def stub_vectors(t) -> DataFrame:
    return t("pages").select("page_id", fields.zero_vector(384).alias("v")).select("page_id", F.size("v").alias("size"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))


@query("""SELECT doc_id, kind, entity FROM (SELECT doc_id, 'ip' AS kind, unnest(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')) AS entity FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents)""")
def entity_table(t) -> DataFrame:
    rows = t("documents").select("doc_id", indicators.matches(F.col("text"), P.IPV4).alias("ips"), F.array("lang").alias("langs"))
    return cves.entity_table(rows, "doc_id", {"ip": "ips", "lang": "langs"})


@query("""SELECT event_id, regexp_replace(CASE event_id % 3 WHEN 0 THEN '2001:db8::' || event_id % 9 ELSE 'fe80::1' END, '::0$', '::') AS ip, CASE WHEN event_id % 3 = 0 THEN 'Documentation' ELSE 'Link-local' END AS kind FROM events WHERE event_id % 3 < 2""")
def ipv6_kinds(t) -> DataFrame:
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat('2001:0db8:0:0:0:0:0:', CAST(event_id % 9 AS STRING)) ELSE 'FE80:0000::0001' END")
    rows = t("events").filter("event_id % 3 < 2").withColumn("x", raw)
    return rows.select("event_id", addresses.compress_ipv6("x").alias("ip"), addresses.classify_ipv6("x")["kind"].alias("kind"))


@query("""SELECT p_partkey, p_name AS title, 'http://h/' || p_partkey AS url, lower(p_brand) || '|b' AS threat_actors, '' AS malware, 'UNKNOWN' AS highest_severity, true AS cyber_related, p_partkey % 2 = 0 AS zero_day_mention, 29 AS fields FROM part""")
def validator_assembly(t) -> DataFrame:
    rows = t("part").select(
        "p_partkey", F.col("p_name").alias("title"), F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 2 == 0, "Yes").alias("zero_day_mention"),
        F.array(F.lower("p_brand"), F.concat(F.lit(" "), F.lower("p_brand")), F.lit("b"), F.lit(" ")).alias("threat_actors"))
    out = assembled(rows, "p_partkey")
    return out.select("p_partkey", "title", "url", F.array_join("threat_actors", "|").alias("threat_actors"), F.array_join("malware", "|").alias("malware"), F.col("cve.highest_severity").alias("highest_severity"), "cyber_related", "zero_day_mention", F.lit(len(out.columns) - 1).alias("fields"))


@query("""SELECT page_id, 'Update the firmware now.' AS advice, CASE WHEN page_id % 2 = 0 THEN 'destabilization' ELSE 'unknown' END AS motive FROM pages""")
def advice_and_motives(t) -> DataFrame:
    sentences = text.sentences(F.lit("The actor left. Update the firmware now. It was late."))
    return t("pages").select("page_id", F.array_join(budget.recommendations(sentences), "|").alias("advice"), fields.known(F.when(F.col("page_id") % 2 == 0, " Destabilization ").otherwise("fun"), P.MOTIVES, "unknown").alias("motive"))


@query("""SELECT doc_id, stage, round(score, 6) AS score FROM (SELECT doc_id, 0 AS stage, 1.5 AS score FROM documents WHERE contains(upper(text), '227.5.221.1') UNION ALL
        SELECT doc_id, 1, CAST(k AS DOUBLE) / n FROM (SELECT doc_id, len(list_filter(w, lambda x: x = 'clown')) AS k, len(w) AS n FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents) WHERE list_contains(w, 'clown'))
        WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE contains(upper(text), '227.5.221.1'))) ORDER BY stage, round(score, 9) DESC, doc_id LIMIT 20""")
def search_merge(t) -> DataFrame:
    """The merge of exact and scored hits, with a score that SQL has too: the share of a word."""
    docs = t("documents")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    k = F.size(F.filter(words, lambda x: x == "clown"))
    scored = docs.select("doc_id", F.when(k > 0, k / F.size(words)).alias("score")).filter("score > 0")  # a text without words has no share
    return search.merged(docs, "the clown at 227.5.221.1", scored, 20).select("doc_id", "stage", F.round("score", 6).alias("score"))
