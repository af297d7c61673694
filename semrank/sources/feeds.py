"""Feeds as rows of entries: RSS, Atom and RDF bytes, and JSON of a news search.

Bytes to raw entries is the small Python part (broken XML needs repair before a parser takes it); titles, links, dates,
snippets and identities are Columns over the raw entries.
"""

from __future__ import annotations

import html.entities
import re
from urllib.parse import urljoin, urlsplit
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.constants import SNIPPET_CHARS, TITLE_CHARS
from semrank.functions.dates import feed_seconds, not_future
from semrank.functions.text import collapse, plain_text, snippet, truncate, without_boilerplate
from semrank.functions.urls import bare_host, without_campaign

# Namespaces of feeds and the names that are read, as field, in the order of trust.
SPACES = {
    "http://www.w3.org/2005/Atom": "atom", "http://purl.org/atom/ns#": "atom", "http://purl.org/rss/1.0/": "", "http://my.netscape.com/rdf/simple/0.9/": "",
    "http://purl.org/rss/1.0/modules/content/": "content", "http://search.yahoo.com/mrss/": "media", "http://search.yahoo.com/mrss": "media",
    "http://purl.org/dc/elements/1.1/": "dc", "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
}
FIELDS = {
    "title": "title", "atom:title": "title", "dc:title": "title", "link": "link", "guid": "guid", "atom:id": "guid", "dc:identifier": "guid",
    "pubDate": "published", "dc:date": "published", "atom:published": "published", "atom:issued": "published", "atom:created": "published",
    "atom:updated": "updated", "atom:modified": "updated", "description": "summary", "atom:summary": "summary", "content:encoded": "content",
    "atom:content": "content", "media:description": "media_description", "media:title": "media_title",
}
DIALECTS = {"rss": "rss", "rdf": "rdf", "feed": "atom"}
ELSEWHERE = {"self", "enclosure", "replies", "edit", "hub", "license", "next", "previous"}
RAW = ("about", "guid", "link", "title", "media_title", "published", "updated", "summary", "media_description", "content")

_REFERENCE = re.compile(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|&(#x?[0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]{0,11});|&|[\x00-\x08\x0b\x0c\x0e-\x1f]", re.S)


def looks_like_feed(body: Column) -> Column:
    """Whether a feed's root element comes in the first 4 KB, before any page's."""
    head = F.lower(F.substring(body, 1, 4096))
    root = F.regexp_instr(head, F.lit(r"<(?:rss|feed|[a-z]+:rdf|rdf)[\s>]"))
    page = F.regexp_instr(head, F.lit(r"<(?:html|body)[\s>]"))
    return (root > 0) & ((page == 0) | (root < page))


def decoded(data: bytes, charset: str | None = None) -> str:
    """By byte-order mark, XML declaration, the given charset, UTF-8 and Windows-1252, in this order."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    said = re.search(rb"""<\?xml[^>]*?encoding\s*=\s*["']([^"']+)""", data[:256], re.I)
    name = said[1].decode("ascii", "replace") if said else charset
    if name:
        try:
            return data.decode(name, "replace" if name.lower().replace("-", "") == "utf8" else "strict")
        except (LookupError, UnicodeDecodeError):
            pass  # the next of the ladder
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def repaired(text: str) -> str:
    """XML that a parser takes: no declaration, named entities as numbers, bare ampersands escaped, control characters gone."""

    def mend(m: re.Match) -> str:
        whole, name = m[0], m[1]
        if whole.startswith("<![CDATA["):
            return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", whole)
        if whole == "&":
            return "&amp;"
        if not name:
            return ""
        if name in ("amp", "lt", "gt", "quot", "apos"):
            return whole
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" and len(name) > 2 else int(name[1:]) if name[1:].isdigit() else 0
        else:
            code = html.entities.name2codepoint.get(name, -1)
        if code < 0:
            return "&amp;" + whole[1:]
        return f"&#{code};" if code in (9, 10, 13) or 32 <= code < 0xD800 or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000 else ""

    start = text.find("<")
    text = re.sub(r"^<\?xml.*?\?>", "", text[max(start, 0) :], flags=re.S)
    return _REFERENCE.sub(mend, text)


class Reader:
    """Entries of one feed; those read before an error are kept."""

    def __init__(self, text: str, base: str):
        self.base, self.entries, self.path, self.prefix = base, [], [], {}
        self.feed: dict = {"links": [], "permalink": False, "dialect": None}
        self.entry = self.field = self.bare_atom = None
        self.kind, self.parts, self.depth, self.markup = "", [], 0, False
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        try:
            p.Parse(repaired(text).encode("utf-8", "replace"), True)
        except expat.ExpatError:
            pass  # a truncated feed has the entries so far

    def name(self, written: str) -> str:
        lead, _, local = written.rpartition(":")
        space = self.prefix.get(lead)
        if space is not None:
            known = SPACES.get(space, "unknown")
            return f"{known}:{local}" if known else local
        return f"atom:{written}" if self.bare_atom and not lead else written

    def start(self, written, attrs):
        for k, v in attrs.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                self.prefix[k[6:]] = v
        if not self.path:
            root = written.split(":")[-1].lower()
            if root not in DIALECTS:
                raise expat.ExpatError("no feed")
            self.bare_atom = root == "feed" and "" not in self.prefix
            self.feed["dialect"] = DIALECTS[root]
        name = self.name(written)
        self.path.append(name)
        if self.field:
            if not self.markup:
                self.parts, self.markup = [self.escape("".join(self.parts))], True
            self.parts.append(f"<{written}{''.join(f' {k}="{self.escape(v)}"' for k, v in sorted(attrs.items()) if not k.startswith('xmlns'))}>")
        elif self.entry is not None:
            self.child(name, attrs)
        elif name in ("item", "atom:entry"):
            self.entry, self.depth = {"about": attrs.get("rdf:about"), "permalink": True, "links": []}, len(self.path)
        elif self.path[-2:-1] == ["channel"] and name in ("title", "link"):
            self.begin(name, "html" if name == "title" else "plain")
        elif self.path[:-1] == ["atom:feed"] and name == "atom:title":
            self.begin("title", (attrs.get("type") or "text").lower())
        elif self.path[:-1] == ["atom:feed"] and name == "atom:link":
            self.linked(self.feed, attrs)

    def begin(self, field: str, kind: str):
        """The text of the element that is open is a value of the field, as HTML or as it stands."""
        self.field, self.parts, self.markup, self.at = field, [], False, len(self.path)
        self.kind = "html" if "html" in kind else "plain"

    @staticmethod
    def linked(held: dict, attrs: dict):
        if attrs.get("href"):
            held["links"].append((attrs["href"], (attrs.get("rel") or "alternate").lower(), (attrs.get("type") or "").lower()))

    def child(self, name, attrs):
        below = len(self.path) - self.depth
        if below != 1 and not (below == 2 and self.path[-2] == "media:group"):
            return
        kind = (attrs.get("type") or "text").lower()
        if name == "atom:link":
            self.linked(self.entry, attrs)
        elif name in FIELDS and not (name == "atom:content" and not (kind == "text" or "html" in kind or kind.startswith("text/"))):
            self.begin(FIELDS[name], "html" if name in ("description", "content:encoded", "title") else kind)
            if name == "guid":
                self.entry["permalink"] = (attrs.get("isPermaLink") or "").lower() != "false"

    @staticmethod
    def escape(t: str) -> str:
        return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def data(self, text):
        if self.field:
            self.parts.append(self.escape(text) if self.markup else text)

    def end(self, written):
        if self.field and len(self.path) == self.at:
            text, held = "".join(self.parts), self.feed if self.entry is None else self.entry
            if text.strip() and held.get(self.field) is None:
                held[self.field] = text.strip()
                held[f"{self.field}_html"] = self.markup or self.kind == "html"
            self.field = None
        elif self.field:
            self.parts.append(f"</{written}>")
        elif self.entry is not None and len(self.path) == self.depth:
            self.entries.append(self.entry)
            self.entry = None
        self.path.pop()

    def address(self, e: dict) -> str | None:
        """Link text, alternate link, other link, permalink, rdf:about: the first that is a web address."""
        alternates = [x for x in e["links"] if x[1] == "alternate"]
        linked = next((x for x in alternates if not x[2] or "html" in x[2]), None) or next(iter(alternates), None) or next((x for x in e["links"] if x[1] not in ELSEWHERE), None)
        guid = e.get("guid")
        for ref in (e.get("link"), linked and linked[0], guid if e["permalink"] and (guid or "").lower().startswith("http") else None, e.get("about")):
            if ref:
                full = urljoin(self.base, ref.strip())
                if urlsplit(full).scheme.lower() in ("http", "https") and urlsplit(full).netloc:
                    return full
        return None


def raw_rows(feeds: DataFrame) -> DataFrame:
    """feeds (source_id, url, body binary, charset) read once: a row of the feed itself (`dialect`, without position) and one of each
    entry (with position); source_id, address, the fields of RAW, and whether three of them are HTML. A feed without a body, and
    what is no feed, has no row.
    """
    flags = ("title_html", "summary_html", "content_html")

    def row(r: Reader, source, position, e: dict) -> tuple:
        return (source, e.get("dialect"), position, r.address(e), *(e.get(k) for k in RAW), *(bool(e.get(k)) for k in flags))

    def run(frames):
        for pdf in frames:
            rows = []
            for source, url, body, charset in zip(pdf.source_id, pdf.url, pdf.body, pdf.charset, strict=True):
                r = Reader(decoded(bytes(body), charset), url or "") if body is not None else None
                if r and r.feed["dialect"]:
                    rows += [row(r, source, None, r.feed), *(row(r, source, i, e) for i, e in enumerate(r.entries))]
            yield pd.DataFrame(rows, columns=["source_id", "dialect", "position", "address", *RAW, *flags]).astype({"position": "Int64"})

    schema = "source_id long, dialect string, position long, address string, " + ", ".join(f"{k} string" for k in RAW) + ", " + ", ".join(f"{k} boolean" for k in flags)
    return feeds.select("source_id", "url", "body", "charset").mapInPandas(run, schema)


def raw_entries(feeds: DataFrame) -> DataFrame:
    """Entries of raw_rows()."""
    return raw_rows(feeds).where("position is not null").drop("dialect")


def feed_rows(rows: DataFrame) -> DataFrame:
    """source_id, dialect, title, link and number of entries of each feed of raw_rows(), which is read twice."""
    title = F.when(F.col("title_html"), plain_text(F.col("title"))).otherwise(collapse(F.col("title")))
    feeds = rows.where("position is null").select("source_id", "dialect", F.nullif(title, F.lit("")).alias("title"), F.col("address").alias("link"))
    counts = rows.groupBy("source_id").agg(F.count("position").alias("entries"))
    return feeds.join(counts, "source_id")


def built(entries: DataFrame, now: Column) -> DataFrame:
    """raw_entries() as items: source_id, position, guid, url, title, snippet, content, published (seconds). now: seconds."""
    blank = lambda c: F.nullif(c, F.lit(""))
    read = lambda c, flag: F.when(F.col(flag), plain_text(F.col(c))).otherwise(collapse(F.col(c)))
    body = F.coalesce("summary", "media_description", "content")
    is_html = F.when(F.col("summary").isNotNull(), F.col("summary_html")).when(F.col("media_description").isNotNull(), F.lit(False)).otherwise(F.col("content_html"))
    text = F.when(is_html, plain_text(body)).otherwise(collapse(body))
    # One column per step: expressions that use a text several times then have it as a column, not as a copy of its expression.
    rows = entries.withColumn("_flat", collapse(without_boilerplate(text))).withColumn("snippet", F.coalesce(truncate(F.col("_flat"), SNIPPET_CHARS), F.lit("")))
    rows = rows.withColumn("url", without_campaign(F.col("address"))).withColumn("_title", read("title", "title_html")).withColumn("_media", collapse(F.col("media_title")))
    rows = rows.withColumn("_published", feed_seconds(F.col("published"))).withColumn("_updated", feed_seconds(F.col("updated")))
    host_path = F.concat(bare_host(F.col("url")), F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1))
    title = F.coalesce(blank(F.col("_title")), blank(F.col("_media")), blank(truncate(F.col("snippet"), TITLE_CHARS)), blank(host_path))
    rows = rows.withColumn("title", title).where("title is not null")
    seconds = not_future(F.coalesce("_published", "_updated"), now).cast("long")
    longest = F.array_sort(F.array_compact(F.array("content", "summary", "media_description")), lambda a, b: F.length(b) - F.length(a))
    full = F.get(longest, 0)
    guid = F.coalesce(blank(F.col("guid")), blank(F.col("about")), "url", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", "title", F.coalesce(F.col("seconds").cast("string"), F.lit(""))), 256)))
    rows = rows.withColumn("seconds", seconds)
    return rows.select("source_id", "position", guid.alias("guid"), "url", "title", "snippet", F.when(F.length(plain_text(full)) > F.length("snippet"), full).alias("content"), F.col("seconds").alias("published"))


HITS = "struct<hits:array<struct<objectID:string,title:string,url:string,story_text:string,created_at_i:bigint>>>"


def search_hits(responses: DataFrame) -> DataFrame:
    """responses (source_id, body): a news search's JSON as items; untitled hits go, the snippet of a link is its host."""
    hit = responses.select("source_id", F.posexplode(F.from_json("body", HITS)["hits"]).alias("position", "h")).select("source_id", "position", "h.*")
    title, link = collapse(F.coalesce("title", F.lit(""))), F.nullif(F.trim("url"), F.lit(""))
    words = F.nullif(snippet(plain_text(F.col("story_text"))), F.lit(""))
    own = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID"))
    rows = hit.where(title != "")
    return rows.select("source_id", F.col("position").cast("long").alias("position"), F.col("objectID").alias("guid"), F.coalesce(link, own).alias("url"), title.alias("title"),
                       F.coalesce(F.when(link.isNotNull(), bare_host(link)), words, F.lit("news.ycombinator.com")).alias("snippet"), F.col("story_text").alias("content"), F.col("created_at_i").alias("published"))
