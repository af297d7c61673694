"""Queries of extraction and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.functions import entities
from semrank.functions import pages as P
from semrank.operators import reader
from semrank.plans.base import query
from semrank.sources import feeds, html_blocks
from semrank.sources.scratch import written
from semrank.sources.tables import table


def _titled(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html", P.title(F.col("html")).alias("title"))


#: The tables' pages have one form: furniture, a loose label, and an article of a heading and paragraphs, which broken markup ends anyhow.
_PLAIN = "trim(regexp_replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
BLOCKS_SQL = f"""WITH a AS (
  SELECT page_id AS item_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS body FROM pages
), b AS (
  SELECT item_id, 0 AS part, 0 AS place, 0 AS tag, {_PLAIN.format(x="ad")} AS text FROM a UNION ALL SELECT item_id, 1, 0, 1, {_PLAIN.format(x="head")} FROM a
  UNION ALL SELECT item_id, 1, place, 2, {_PLAIN.format(x="replace(replace(t, '<b>', ''), '</b>', '')")} FROM (SELECT item_id, generate_subscripts(string_split(body, '<p>'), 1) AS place, unnest(string_split(body, '<p>')) AS t FROM a) WHERE place > 1
), k AS (
  SELECT *, CASE WHEN tag = 1 AND length(text) <= 200 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN length(text) >= 40 AND NOT (tag = 1 AND length(text) <= 200) THEN length(text) ELSE 0 END AS weight
  FROM b WHERE text <> '' AND (tag <> 0 OR length(replace(text, ' ', '')) >= 40) AND (tag <> 1 OR length(text) >= 2)
), w AS (SELECT item_id, coalesce(sum(weight) FILTER (part = 1), 0) AS art, coalesce(sum(weight) FILTER (part = 0), 0) AS ad FROM k GROUP BY item_id
), c AS (SELECT item_id, CASE WHEN art >= 900 AND 4 * art >= art + ad OR art > 0 AND art >= 0.7 * (art + ad) THEN 1 WHEN ad > 0 AND ad >= 0.7 * (art + ad) THEN 0 END AS part FROM w
)"""


@query("extract_blocks", f"{BLOCKS_SQL} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY k.part, place) - 1 AS idx, kind, CASE WHEN kind = 'heading' THEN 1 END AS level, text FROM k JOIN c USING (item_id) WHERE c.part IS NULL OR c.part = k.part")
def extract_blocks(spark, sf):
    return html_blocks.extract(_titled(spark, sf), merged=False)


@query("extract_passages")
def extract_passages(spark, sf):
    """Passages of every page with their sections, without empty ones, what is beyond the cap, and sections that the cap emptied."""
    whole = reader.without_empty_sections(html_blocks.extract(_titled(spark, sf)))
    return reader.sections(reader.without_empty_sections(reader.capped(whole)))


_RSS = """<rss version="2.0"><channel><title>T</title><item><title>A &amp; {n}</title><link>/p/{n}?utm_source=x</link><description>&lt;p&gt;Hello&amp;nbsp;{n}&lt;/p&gt;</description><pubDate>Tue, 05 Mar 2024 10:20:30 GMT</pubDate></item></channel></rss>"""


@query("feed_parse", "SELECT page_id AS source_id, 0::BIGINT AS position, 'https://f.example/p/' || page_id AS guid, 'https://f.example/p/' || page_id AS url, 'A & ' || page_id AS title, 'Hello ' || page_id AS snippet, 1709634030::BIGINT AS published FROM pages")
def feed_parse(spark, sf):
    """A feed for each page, read and built."""
    body = F.encode(F.replace(F.lit(_RSS), F.lit("{n}"), F.col("page_id").cast("string")), "UTF-8")
    made = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.lit("https://f.example/feed.xml").alias("url"), body.alias("body"), F.lit(None).cast("string").alias("charset"))
    return feeds.built(feeds.raw_entries(made), F.lit(1_710_000_000)).drop("content")


_EMBEDDED = "CASE WHEN page_id % 5 = 0 THEN '<script type=\"application/ld+json\">{\"articleBody\": \"' || repeat('Part ' || page_id || ' text. ', 60) || '\"}</script>' ELSE '' END"
_THIN = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?s)(<h1>.*?</h1><p>[^<]*<b>[^<]*<br>).*(</article>)', '{one}1<p>A short rest of this page, some ten words long.</p>{two}2') ELSE html END"


@query("article_stages", f"""{BLOCKS_SQL.replace("FROM pages", "FROM (SELECT page_id, " + _THIN.replace("{one}", chr(92)).replace("{two}", chr(92)) + " AS html FROM pages) pages")}, h AS (
  SELECT item_id, bool_or(part = 0) AS ad, coalesce(max(length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) FILTER (kind = 'heading'), 0) < 8 AS head, min(place) FILTER (part = 1 AND kind = 'paragraph' AND length(text) >= 40) AS begin_at FROM k GROUP BY item_id
), t AS (
  -- Before the first full passage short paragraphs go, unless a heading that isn't the title, or the label, stands before them.
  SELECT k.*, c.part AS chosen, h.ad, k.part = 0 OR begin_at IS NULL OR h.head OR place >= begin_at AS late FROM k JOIN c USING (item_id) JOIN h USING (item_id) WHERE kind = 'paragraph'
), v AS (
  SELECT item_id, part, any_value(chosen) AS chosen, any_value(ad) AS ad, CASE WHEN sum(length(text) + 1) - 1 >= 40 THEN sum(len(string_split(text, ' '))) ELSE 0 END AS every,
    CASE WHEN sum(length(text) + 1) FILTER (late) - 1 >= 40 THEN sum(len(string_split(text, ' '))) FILTER (late) ELSE 0 END AS after FROM t GROUP BY item_id, part
), n AS (
  SELECT item_id, coalesce(sum(CASE WHEN chosen IS NULL AND ad THEN every ELSE after END) FILTER (chosen IS NULL OR part = chosen), 0) AS one, coalesce(sum(CASE WHEN ad THEN every ELSE after END), 0) AS two,
    CASE WHEN item_id % 5 = 0 THEN 180 ELSE 0 END AS three FROM (SELECT item_id FROM a) LEFT JOIN v USING (item_id) GROUP BY item_id
), r AS (SELECT *, CASE WHEN one >= 150 OR one >= two THEN one ELSE two END AS best FROM n)
  SELECT item_id, CASE WHEN best < 150 AND three > best THEN 'embedded' WHEN one >= 150 OR one >= two THEN 'selected' ELSE 'whole' END AS stage, CASE WHEN best < 150 AND three > best THEN three ELSE best END::BIGINT AS words FROM r""")  # fmt: skip
def article_stages(spark, sf):
    """Pages, a third of them cut short, some with a body in JSON-LD: the stage that gives each its text, and its words."""
    html = F.expr(f"({_EMBEDDED}) || ({_THIN.replace('{one}', '$').replace('{two}', '$')})")
    made = table(spark, sf, "pages").select("page_id", html.alias("html"), P.title(F.col("html")).alias("title"))
    return html_blocks.staged(made)[0]


#: Feeds of three dialects: an image with a title of its own, names of other namespaces, a second value, markup in a field, a broken end.
_DIALECTS = (
    """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><image><title>Logo</title><link>http://logo.example/</link></image><title>Site {n} &amp;amp; co</title><link>http://s{n}.example/</link>
<item><title>First {n}</title><dc:title>Second</dc:title><guid isPermaLink="false">g{n}</guid><link>/a/{n}</link><description>Some <b>bold</b> &eacute; text</description><pubDate>Tue, 05 Mar 2024 10:20:30 GMT</pubDate></item><item><title>cut""",
    """<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Site {n} &amp; co</title><link rel="self" href="/self"/><link href="http://s{n}.example/"/>
<entry><id>g{n}</id><title type="html">&lt;i&gt;First&lt;/i&gt; {n}</title><link rel="replies" href="/no"/><link href="/a/{n}"/><published>2024-03-05T10:20:30Z</published><updated>2025-01-01</updated><summary>Some bold é text</summary></entry></feed>""",
    """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:d="http://purl.org/dc/elements/1.1/"><channel><title>Site {n} &amp; co</title><link>http://s{n}.example/</link></channel>
<image><title>Logo</title></image><item rdf:about="https://f.example/a/{n}"><d:identifier>g{n}</d:identifier><title>First {n}</title><d:date>2024-03-05T11:20:30+01:00</d:date><description>Some bold &#233; text</description></item></rdf:RDF>""",
)


def _dialects(spark, sf):
    form = F.get(F.array(*map(F.lit, _DIALECTS)), (F.col("page_id") % 3).cast("int"))
    body = F.encode(F.replace(form, F.lit("{n}"), F.col("page_id").cast("string")), "UTF-8")
    made = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.lit("https://f.example/feed.xml").alias("url"), body.alias("body"), F.lit(None).cast("string").alias("charset"))
    return written(feeds.raw_rows(made), "feeds")


@query("feed_rows", "SELECT page_id AS source_id, CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'rdf' END AS dialect, 'Site ' || page_id || ' & co' AS title, 'http://s' || page_id || '.example/' AS link, 1 AS entries FROM pages")
def feed_rows(spark, sf):
    """Title, link and dialect of feeds; an image's title is not the feed's."""
    return feeds.feed_rows(_dialects(spark, sf))


@query("feed_dialects", "SELECT page_id AS source_id, 0::BIGINT AS position, 'g' || page_id AS guid, 'https://f.example/a/' || page_id AS url, 'First ' || page_id AS title, 'Some bold é text' AS snippet, 1709634030::BIGINT AS published FROM pages")
def feed_dialects(spark, sf):
    """Entries of the three dialects: other namespaces' names, first values, markup in a field, an entry before a broken end."""
    rows = _dialects(spark, sf).where("position is not null").drop("dialect")
    return feeds.built(rows, F.lit(1_710_000_000)).drop("content")


@query("hn_json", "SELECT page_id AS source_id, 0::BIGINT AS position, page_id::VARCHAR AS guid, url, 'Story ' || page_id AS title, 'src.example' AS snippet, 1700000000 + page_id AS published FROM (SELECT page_id, 'https://www.src.example/' || page_id AS url FROM pages)")
def hn_json(spark, sf):
    one = F.struct(F.col("page_id").cast("string").alias("objectID"), F.concat(F.lit("Story  "), F.col("page_id")).alias("title"), F.concat(F.lit("https://www.src.example/"), F.col("page_id")).alias("url"), (F.lit(1_700_000_000) + F.col("page_id")).alias("created_at_i"))
    none = F.struct(F.lit("x").alias("objectID"), F.lit(" ").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("created_at_i"))
    made = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.to_json(F.struct(F.array(one, none).alias("hits"))).alias("body"))
    return feeds.search_hits(made).drop("content")


@query("looks_like_feed", "SELECT page_id, page_id % 2 = 0 AS feed FROM pages")
def looks_like_feed(spark, sf):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<?xml version='1.0'?>\n<rss version='2.0'>"), F.col("html"))).otherwise(F.concat(F.lit("<html><p>&lt;rss <rss >"), F.col("html")))
    return table(spark, sf, "pages").select("page_id", feeds.looks_like_feed(body).alias("feed"))


@query("decode_entities", "SELECT page_id, 'é & < ' || page_id || ' &bogus; ''' AS text FROM pages")
def decode_entities(spark, sf):
    typed = F.concat(F.lit("&eacute; &amp; &#60; "), F.col("page_id").cast("string"), F.lit(" &bogus; &apos;"))
    return table(spark, sf, "pages").select("page_id", entities.decode_entities(typed).alias("text"))


@query("tex_readable", "SELECT page_id, 'θ₁ + x² ≤ 1/' || page_id AS text FROM pages")
def tex_readable(spark, sf):
    typed = F.concat(F.lit(r"\theta_1 + x^2 \leq \frac{1}{"), F.col("page_id").cast("string"), F.lit("}"))
    return table(spark, sf, "pages").select("page_id", entities.tex_readable(typed).alias("text"))
