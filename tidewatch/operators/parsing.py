"""Parsers of exchanged documents: threat-sharing JSON, feeds, pages and free JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import IMPORTANT_KEYS, KEY_FIELDS

ATTRIBUTE = "struct<category:string,type:string,value:string,comment:string,to_ids:boolean,uuid:string,timestamp:string,object_relation:string>"
_OBJECT = f"struct<name:string,Attribute:array<{ATTRIBUTE}>>"
_EVENT = f"info:string,comment:string,uuid:string,threat_level_id:string,Attribute:array<{ATTRIBUTE}>,Object:array<{_OBJECT}>,Tag:array<struct<name:string>>,EventTag:array<struct<Tag:struct<name:string>>>"
MISP = f"struct<Event:struct<{_EVENT}>,events:array<struct<{_EVENT}>>,{_EVENT}>"
_REFERENCE = "struct<source_name:string,external_id:string,url:string>"
STIX_OBJECT = (
    "struct<type:string,id:string,created:string,modified:string,name:string,description:string,labels:array<string>,pattern:string,indicator_types:array<string>,is_family:boolean,malware_types:array<string>,"
    "threat_actor_types:array<string>,sophistication:string,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_id:string,published:string,object_refs:array<string>,"
    f"external_references:array<{_REFERENCE}>,object_marking_refs:array<string>,relationship_type:string,source_ref:string,target_ref:string>"
)
STIX = f"struct<type:string,id:string,objects:array<{STIX_OBJECT}>>"
# Object types that the fallback keeps as nodes, and fields that only objects of one type have.
STIX_NODES = ("attack-pattern", "campaign", "course-of-action", "grouping", "identity", "indicator", "infrastructure", "intrusion-set", "location", "malware", "malware-analysis", "note", "observed-data", "opinion", "report", "threat-actor", "tool", "vulnerability")
STIX_FIELDS = {
    "indicator": ("pattern", "indicator_types"), "malware": ("is_family", "malware_types"), "threat-actor": ("threat_actor_types", "sophistication"),
    "attack-pattern": ("kill_chain_phases", "x_mitre_id"), "report": ("published", "object_refs"),
}
RSS = "channel struct<title string, description string, link string, language string, generator string, lastBuildDate string, item array<struct<title string, link string, description string, pubDate string, `content:encoded` string>>>"
ATOM = "title string, subtitle string, updated string, generator string, link array<struct<_href string, _rel string>>, entry array<struct<title string, link array<struct<_href string, _rel string>>, summary string, content array<string>, published string, updated string>>"


def misp_event(text: Column) -> Column:
    """The event of a MISP text: under Event, the first of events, or the text's root; null for what is no JSON object."""
    e = F.from_json(text, MISP)
    fields = [f.split(":")[0] for f in ("info", "comment", "uuid", "threat_level_id", "Attribute", "Object", "Tag", "EventTag")]
    root = F.struct(*(e[f].alias(f) for f in fields))
    return F.when(e["Event"].isNotNull(), e["Event"]).when(F.size(e["events"]) > 0, F.get(e["events"], F.lit(0))).when(e.isNotNull() & F.trim(text).startswith("{"), root)


def misp_attributes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, info, object_name and the attributes of events, those inside objects too. Texts that are no event have none."""
    none = F.lit(None).cast("string")
    event = rows.select(key, misp_event(F.col(text)).alias("e")).filter("e is not null")
    own = F.transform(F.coalesce("e.Attribute", F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: F.struct(none.alias("object_name"), a.alias("a")))
    inner = F.flatten(F.transform(F.coalesce("e.Object", F.array().cast(f"array<{_OBJECT}>")), lambda o: F.transform(F.coalesce(o["Attribute"], F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: F.struct(o["name"].alias("object_name"), a.alias("a")))))
    return event.select(key, F.col("e.info").alias("info"), F.explode(F.concat(own, inner)).alias("x")).select(key, "info", "x.object_name", "x.a.*")


def misp_tags(text: Column) -> Column:
    """Names of an event's tags, those of Tag before those of EventTag."""
    e = misp_event(text)
    names = F.concat(F.coalesce(F.transform(e["Tag"], lambda t: t["name"]), F.array().cast("array<string>")), F.coalesce(F.transform(e["EventTag"], lambda t: t["Tag"]["name"]), F.array().cast("array<string>")))
    return F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")


def misp_text(text: Column) -> Column:
    """Title, values and comments, a line each."""
    e = misp_event(text)
    every = F.concat(F.coalesce(e["Attribute"], F.array().cast(f"array<{ATTRIBUTE}>")), F.coalesce(F.flatten(F.transform(e["Object"], lambda o: o["Attribute"])), F.array().cast(f"array<{ATTRIBUTE}>")))
    lines = F.concat(F.array(e["info"]), F.flatten(F.transform(every, lambda a: F.array(a["value"], a["comment"]))))
    return F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def stix_objects(text: Column) -> Column:
    """The objects of a bundle, of a list of objects, or the single object that a text is."""
    t = F.trim(text)
    whole = F.when(t.startswith("["), F.concat(F.lit('{"objects":'), t, F.lit("}"))).when(F.get_json_object(t, "$.objects").isNull(), F.concat(F.lit('{"objects":['), t, F.lit("]}"))).otherwise(t)
    return F.filter(F.from_json(whole, STIX)["objects"], lambda o: o["type"].isNotNull())


def stix_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The domain objects, with the fields that objects of their type have; the first report of a bundle is its main one."""
    parsed = rows.select(key, stix_objects(F.col(text)).alias("objects")).withColumn("main", F.get(F.filter("objects", lambda o: o["type"] == "report"), F.lit(0))["id"])
    objects = parsed.select(key, "main", F.explode("objects").alias("o")).filter(F.col("o.type").isin(*STIX_NODES))
    common = ("type", "id", "created", "modified", "name", "description", "labels")
    own = [F.when(F.col("o.type") == kind, F.col(f"o.{f}")).alias(f) for kind, fields in STIX_FIELDS.items() for f in fields]
    return objects.select(key, *(f"o.{f}" for f in common), *own, "o.external_references", "o.object_marking_refs", ((F.col("o.type") == "report") & (F.col("o.id") == F.col("main"))).alias("main_report"))


def stix_edges(rows: DataFrame, key: str, text: str) -> DataFrame:
    objects = rows.select(key, F.explode(stix_objects(F.col(text))).alias("o"))
    return objects.filter("o.type = 'relationship'").select(key, "o.id", "o.relationship_type", "o.source_ref", "o.target_ref")


def stix_graph(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Edges with the names of both ends. A bundle is parsed once; its ends are found in a map of its own nodes, so nothing is joined."""
    parsed = rows.select(key, stix_objects(F.col(text)).alias("objects"))
    nodes = F.transform(F.filter("objects", lambda o: o["type"].isin(*STIX_NODES) & o["id"].isNotNull()), lambda o: F.struct(o["id"].alias("id"), o["name"].alias("name")))
    first = lambda m, n: F.when(F.map_contains_key(m, n["id"]), m).otherwise(F.map_concat(m, F.create_map(n["id"], n["name"])))
    ids = F.transform("nodes", lambda n: n["id"])
    names = F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.map_from_entries("nodes")).otherwise(F.aggregate("nodes", F.create_map().cast("map<string,string>"), first))
    edges = F.explode(F.filter("objects", lambda o: o["type"] == "relationship")).alias("o")
    found = parsed.withColumn("nodes", nodes).withColumn("names", names).select(key, "names", edges)
    end = lambda ref: F.element_at("names", F.col(f"o.{ref}"))
    return found.select(key, "o.id", "o.relationship_type", "o.source_ref", "o.target_ref", end("source_ref").alias("source_name"), end("target_ref").alias("target_name"))


def stix_text(text: Column) -> Column:
    """Names, descriptions and pattern lines of a bundle's objects."""
    def lines(o: Column) -> Column:
        return F.array(o["name"], o["description"], F.when(o["pattern"].isNotNull(), F.concat(F.lit("STIX_INDICATOR_PATTERN: "), o["pattern"])))

    return F.array_join(F.filter(F.flatten(F.transform(stix_objects(text), lines)), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def _untagged(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def feed_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, feed_title, feed_description, title, link, summary, published, content of the items of RSS and Atom feeds, those without a link
    too. Tags are stripped; an Atom entry's link is the alternate one, else the first; published falls back to updated, content to
    the summary; content of several parts is put together."""
    t = F.col(text)
    rss = F.from_xml(F.when(F.contains(t, F.lit("<rss")), t), RSS, {"rowTag": "rss"})["channel"]
    atom = F.from_xml(F.when(F.contains(t, F.lit("<feed")), t), ATOM, {"rowTag": "feed"})
    kind = "array<struct<title:string,link:string,summary:string,published:string,content:string>>"

    def item(i: Column) -> Column:
        summary = _untagged(i["description"])
        return F.struct(i["title"].alias("title"), F.trim(i["link"]).alias("link"), summary.alias("summary"), i["pubDate"].alias("published"), F.coalesce(_untagged(i["content:encoded"]), summary).alias("content"))

    def entry(e: Column) -> Column:
        alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
        summary = _untagged(e["summary"])
        parts = F.array_join(F.transform(e["content"], _untagged), "\n\n")
        return F.struct(e["title"].alias("title"), link.alias("link"), summary.alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published"), F.coalesce(F.nullif(parts, F.lit("")), summary).alias("content"))

    feed = rows.select(key, rss.alias("r"), atom.alias("a"))
    items = F.concat(F.coalesce(F.transform("r.item", item), F.array().cast(kind)), F.coalesce(F.transform("a.entry", entry), F.array().cast(kind)))
    found = feed.select(key, F.coalesce("r.title", "a.title").alias("feed_title"), _untagged(F.coalesce("r.description", "a.subtitle")).alias("feed_description"), F.explode(items).alias("i"))
    return found.select(key, "feed_title", "feed_description", F.coalesce("i.title", F.lit("Untitled")).alias("title"), "i.link", "i.summary", "i.published", "i.content")


def feed_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The items of feeds that have a link, with the feed's title."""
    return feed_entries(rows, key, text).filter("trim(link) <> ''")


def flatten_json(root) -> list[tuple[str, object]]:
    """Dotted paths and values of a parsed JSON text, however deep; list positions are keys; empty containers vanish."""
    out, stack = [], [("", root)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict | list):
            pairs = value.items() if isinstance(value, dict) else enumerate(value)
            stack += reversed([(f"{path}.{k}" if path else str(k), v) for k, v in pairs])
        else:
            out.append((path, value))
    return out


def limit_keys(pairs: list[tuple], important: tuple[str, ...] = IMPORTANT_KEYS, most: int = 1000) -> list[tuple]:
    """Of more than `most` pairs, the first half of that many whose path holds an important word and the first half of the others."""
    if len(pairs) <= most:
        return pairs
    first = [p for p in pairs if any(w in p[0].lower() for w in important)]
    rest = [p for p in pairs if not any(w in p[0].lower() for w in important)]
    return first[: most // 2] + rest[: most // 2]


def readable_json(value, depth: int = 0, deepest: int = 10) -> str:
    """An indented rendering: 51 entries of an object, ten of a list of over 20, 200 characters of a string, ten levels."""
    if depth > deepest:
        return "[Max depth reached]"
    pad = "  " * depth
    inner = lambda v: readable_json(v, depth + 1, deepest)
    if isinstance(value, dict):
        if not value:
            return "{}"
        shown = [f"{pad}  {k}: {inner(v)}" for k, v in list(value.items())[:51]]
        more = [f"{pad}  ... ({len(value) - 50} more items)"] if len(value) > 51 else []
        return "\n".join(["{", *shown, *more, f"{pad}}}"])
    if isinstance(value, list):
        if not value:
            return "[]"
        long = len(value) > 20
        shown = [f"{pad}  [{i}]: {inner(v)}" for i, v in enumerate(value[: 10 if long else 20])]
        if long:
            return "\n".join([f"[Array with {len(value)} items, showing first 10:]", *shown, f"{pad}  ... {len(value) - 10} more items"])
        return "\n".join(["[", *shown, f"{pad}]"])
    if isinstance(value, str):
        return f'"{value[:200]}..."' if len(value) > 200 else f'"{value}"'
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def key_facts(value) -> str:
    """What a JSON text is about: its first telling key, its type and count, or the length and kind of a list; empty if nothing says."""
    out = []
    if isinstance(value, dict):
        telling = next((k for k in KEY_FIELDS if isinstance(value.get(k), str) and value[k].strip()), None)
        out += [f"{telling}: {value[telling][:100]}..."] if telling else []
        out += [f"type: {value['type']}"] if "type" in value else []
        out += [f"count: {value.get('count', value.get('length'))}"] if "count" in value or "length" in value else []
    elif isinstance(value, list):
        out.append(f"Array with {len(value)} items")
        out += [f"items of type: {value[0]['type']}"] if value and isinstance(value[0], dict) and "type" in value[0] else []
    return " | ".join(out)


def normalised_json(text: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """Readable text (behind its facts) and the limited flat pairs of a JSON text; null if it is none."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return None
    facts = key_facts(root)
    flat = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in limit_keys(flatten_json(root))]
    return (f"Summary: {facts}\n\n" if facts else "") + readable_json(root), flat


def json_normalised(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and flat (a map of paths to values) of JSON texts; other texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, m) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (m := normalised_json(t))]
            flat = pa.array([m[1] for _, m in made], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([m[0] for _, m in made], pa.string()), flat], names=[key, "text", "flat"])

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, text string, flat map<string,string>")


def json_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value of the leaves of JSON texts (see limit_keys for very many)."""
    return json_normalised(rows, key, text).select(key, F.explode("flat").alias("path", "value"))


class _Markdown(HTMLParser):
    """Markdown of a page's body: headers, paragraphs, list items, links and emphasis; scripts, styles and navigation left out."""

    SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe", "svg", "button"))
    BLOCKS = frozenset(("p", "div", "section", "article", "tr", "ul", "ol", "table", "blockquote", "pre"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped, self.title, self.in_title = 0, "", False
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag == "title":
            self.in_title = True
        elif self.skipped:
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.parts.append("[")
        elif tag in self.BLOCKS:
            self.parts.append("\n\n")
        elif tag in ("b", "strong"):
            self.parts.append("**")

    def handle_endtag(self, tag) -> None:
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif self.skipped:
            return
        elif tag == "a" and self.links:
            self.parts.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in self.BLOCKS or (len(tag) == 2 and tag[0] == "h"):
            self.parts.append("\n\n")

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.parts.append(" ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else " ")


def page_markdown(html: str | None) -> tuple[str, str]:
    """Title and markdown of a page."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [" ".join(line.split(" ")).strip() for line in "".join(parser.parts).split("\n")]
    out, blank = [], 0
    for line in lines:
        blank = blank + 1 if not line else 0
        if blank <= 1:
            out.append(line)
    return " ".join(parser.title.split()), "\n".join(out).strip()


def html_markdown(pages: DataFrame) -> DataFrame:
    """page_id, title, markdown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_markdown(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["page_id", "title", "markdown"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, title string, markdown string")
