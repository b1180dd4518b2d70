import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import classify, indicators, network, text, urls


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80/Path/?b=2&utm_source=x&a=1#Frag", "http://example.com/Path?a=1&b=2#Frag"),
        ("https://h/p?x=", "https://h/p"),
        ("ftp://h", "https://h/"),
        ("https://h:443/", "https://h/"),
        (None, None),
    ],
)
def test_canonical_url(value, url, want):
    assert value(urls.canonical_url(F.lit(url).cast("string"))) == want


def test_clean_link(value):
    assert value(urls.clean_link(F.lit("https://h/p?preference=1&id=2#x"))) == "https://h/p?id=2#x"


@pytest.mark.parametrize(
    ("ip", "kind"),
    [("10.1.2.3", "Private"), ("172.32.0.1", "Public"), ("100.64.0.1", "Shared"), ("255.255.255.255", "Reserved"), ("8.8.8.8", "Public"), ("203.0.113.9", "Documentation"), ("1.2.3", "Invalid"), ("256.1.1.1", "Invalid"), ("192.168.1.77/24", "Private"), ("9.255.0.0/6", "Public"), ("1.1.1.1/40", "Invalid")],
)
def test_classify_ipv4(value, ip, kind):
    assert value(network.classify_ipv4(F.lit(ip)))["kind"] == kind


def test_addresses_and_hosts(value):
    assert value(network.normalise_ipv4(F.lit("010.001.2.3"))) == "10.1.2.3"
    assert value(network.normalise_domain(F.lit(" .WWW.Evil.Com. "))) == "evil.com"
    assert [value(network.valid_domain(F.lit(x))) for x in ("evil.com", "setup.exe", "a-.com", "12.com", "x" * 64 + ".com", "one")] == [True, False, False, False, False, False]


def test_indicators(value):
    t = F.lit("cve-2021-44228 at 203.0.113.10, User[@]mail[.]com hxxp://bad[.]site/a. " + "a" * 32 + " " + "AB" * 20 + " md5: " + "0f" * 16)
    assert value(indicators.indicators(t))["cves"] == ["cve-2021-44228"]
    assert value(indicators.first_indicator(t)).asDict() == {"kind": "cve", "value": "CVE-2021-44228"}
    assert value(indicators.emails(t)) == ["user@mail.com"]
    assert value(indicators.hashes(t)) == ["ab" * 20, "0f" * 16]
    assert value(indicators.labelled_hashes(t)) == ["0f" * 16]
    assert value(indicators.urls(t)) == ["http://bad.site/a"]
    assert value(indicators.loose_cves(F.lit("2021-2023 and CVE-2020-12345 but x2024-1234 no"))) == ["CVE-2021-2023", "CVE-2020-12345"]
    assert value(indicators.matches(F.lit(None).cast("string"), "a")) == []


def test_host_indicators(value):
    t = F.lit("run evil-tool.exe via cmd /c whoami && del and HKLM\\Software\\Run")
    assert value(indicators.processes(t)) == ["evil-tool.exe"]
    assert value(indicators.registry_keys(F.lit("HKLM\\Software\\Run"))) == ["HKLM\\Software\\Run"]
    assert value(indicators.registry_keys(F.lit("HKXX\\Other\\Run"))) == []
    assert value(indicators.registry_keys(F.lit("at SOFTWARE\\Vendor"))) == ["SOFTWARE\\Vendor"]
    assert value(indicators.file_paths(F.lit("%TEMP%\\a.bin"))) == ["%TEMP%\\a.bin"]
    assert value(indicators.file_paths(F.lit("see /tmp/x1/run.sh"))) == ["/tmp/x1/run.sh", "/x1/run.sh"]
    assert value(indicators.commands(F.lit("certutil -urlcache -split -f http://x/y"))) == ["certutil -urlcache -split -f http://x/y"]
    assert value(indicators.commands(F.lit("the malware uses powershell -enc " + "QUJD" * 8))) == ["powershell -enc " + "QUJD" * 8, "-enc " + "QUJD" * 8]


def test_stix_values(value):
    got = value(indicators.stix_pattern_values(F.lit("STIX_INDICATOR_PATTERN: [domain-name:value = 'a.b'] x STIX_INDICATOR_PATTERN: [file:hashes.'MD5' = 'ff']")))
    assert [(r["kind"], r["value"]) for r in got] == [("domain", "a.b"), ("md5", "ff")]


def test_text(value):
    assert value(text.point_id(F.lit("0042"))) == "42"
    assert value(text.point_id(F.lit("doc:0"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:0"))
    assert value(text.iso_seconds(F.lit("2024-01-02T03:04:05Z"))) == 1704164645
    assert value(text.iso_seconds(F.lit("14 November 2023"))) is None
    assert value(text.page_range(F.lit("1-3, 5,x"))) == [1, 2, 3, 5]
    assert value(text.clamp_headers(F.lit("### a\n# b\n### c\nd"))) == "# a\n# b\n## c\nd"
    assert value(text.text_to_markdown(F.lit("BIG NEWS\n- x\n2) y\nsee http://h"))) == "## Big News\n- x\n1. y\nsee [http://h](http://h)"
    assert value(text.context_category(F.lit(None).cast("string"), F.lit("biochemistry"))) == "ioc"
    assert value(text.context_category(F.lit("body"), F.lit("an epoch"))) == "exploit"
    assert value(text.snippet(F.lit("x" * 60 + "HIT" + "y" * 60), F.lit("HIT"))) == "x" * 50 + "HIT" + "y" * 50
    assert value(text.strip_html(F.lit("<p>a&amp;b<script>x</script> <!-- c --><b>d</b></p>"))) == "a&b d"


def test_classifiers(value):
    assert value(classify.motivations(F.lit("ransom paid in bitcoin to restore"))) == ["financial", "extortion"]
    assert value(classify.motivations(F.lit("nothing"))) == ["unknown"]
    assert value(classify.high_tension(F.lit("a massive breach"))) is True
    assert [value(classify.relevance(F.lit(x))) for x in ("CVE-2020-1", "phishing", "cyber", "tea")] == [8, 6, 4, 1]
    assert value(classify.explicit_techniques(F.lit("MITRE technique T1055 " + "." * 80 + " model T1000"))) == ["T1055"]
    assert value(classify.geography(F.lit("in Singapore"))).asDict() == {"affects_singapore": True, "affects_asean": True}
    assert [value(classify.severity(F.lit(x))) for x in (9.0, 7.0, 4.0, 0.1, 0.0)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]


@pytest.mark.parametrize(
    ("body", "mime", "kind"),
    [("plain", "", "TEXT"), ("x", "text/html", "HTML"), ("%PDF-1.7", "", "PDF"), ('{"a":1}', "", "JSON"), ('{"type":"bundle","objects":[{"type":"malware"}]}', "", "STIX"), ('{"Event":{"Attribute":[{"category":"Artifacts"}]}}', "", "MISP"), ("<rss version='2'><channel><item><title>a</title>", "", "RSS")],
)
def test_detect_kind(value, body, mime, kind):
    assert value(classify.detect_kind(F.lit(body), F.lit(mime)))["kind"] == kind
