"""Queries of adapters, addresses, discovery, answers of servers and bodies. Made-up input varies by row; where both engines read
the same expression, it only makes the input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.functions import adapters, bodies, http, text, urls
from semrank.plans.base import query
from semrank.plans.text import collapse_sql, entities_sql, strip_sql, truncate_sql
from semrank.sources.tables import table

_PAPER = """CASE doc_id % 4 WHEN 0 THEN 'http://arxiv.org/abs/2401.' || doc_id || 'v' || (doc_id % 13) WHEN 1 THEN 'https://arxiv.org/abs/hep-th/99' || doc_id
  WHEN 2 THEN 'http://other.example/' || doc_id || 'v2' ELSE 'http://arxiv.org/abs/2401.' || doc_id || 'v1/x' END"""


@query("preprint_entries", f"SELECT doc_id, regexp_replace(a, 'v[0-9]+$', '') AS guid, a AS url FROM (SELECT doc_id, CASE WHEN starts_with(u, 'http://arxiv.org/') THEN 'https' || substr(u, 5) ELSE u END AS a FROM (SELECT doc_id, {_PAPER} AS u FROM documents))")
def preprint_entries(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_PAPER).alias("u"))
    return rows.select("doc_id", adapters.preprint_identity(F.col("u")).alias("guid"), adapters.preprint_address(F.col("u")).alias("url"))


_POST = """CASE doc_id % 3 WHEN 0 THEN text || ' submitted by <a href="https://f.example/u/n"> /u/name' || doc_id || ' </a> [link] [comments]'
  WHEN 1 THEN '<p>' || text || '</p>&#32; submitted by &#32; <a href="x"> /u/n </a> to <a href="y"> r/topic </a>' ELSE text END"""
_SIGNED = adapters.SIGNATURE.replace("'", "''")


@query("forum_posts", f"""WITH h AS (SELECT doc_id, {_POST} AS html FROM documents), p AS (SELECT doc_id, html, regexp_replace({collapse_sql(entities_sql(strip_sql('html')))}, '{_SIGNED}', '') AS post FROM h),
  s AS (SELECT doc_id, html, post, {collapse_sql('post')} AS flat FROM p), t AS (SELECT *, {truncate_sql('flat', 300)} AS snippet FROM s)
  SELECT doc_id, snippet, sha256(CASE WHEN length(post) > length(snippet) THEN regexp_replace(html, '{adapters.SIGNATURE_HTML}', '') END) AS content_sha256 FROM t""")  # fmt: skip
def forum_posts(spark, sf):
    """Posts lose the signature that ends them; content is kept where it says more than the snippet."""
    short, content = adapters.forum_post(F.col("html"))
    return table(spark, sf, "documents").select("doc_id", F.expr(_POST).alias("html")).select("doc_id", short.alias("snippet"), F.sha2(content, 256).alias("content_sha256"))


_CATEGORY = "CASE doc_id % 9 WHEN 0 THEN 'cs.lg' WHEN 1 THEN ' STAT.ml ' WHEN 2 THEN 'Hep-Th' WHEN 3 THEN 'cond-mat.Mes-Hall' WHEN 4 THEN 'example.com' WHEN 5 THEN 'cs.' WHEN 6 THEN 'math.x1' WHEN 7 THEN lang || '.cs' ELSE 'q-bio.qm.x' END"


@query("preprint_categories", f"""WITH c AS (SELECT doc_id, regexp_extract(trim({_CATEGORY}), '^([^.]*)(?:\\.([A-Za-z-]{{2,12}}))?$', ['a', 's']) AS m, trim({_CATEGORY}) AS t FROM documents)
  SELECT doc_id, CASE WHEN t <> '' AND lower(m.a) IN {adapters.ARCHIVES!r} AND (m.s <> '' OR NOT contains(t, '.')) THEN lower(m.a) || CASE WHEN m.s = '' THEN '' WHEN length(m.s) = 2 THEN '.' || upper(m.s) ELSE '.' || lower(m.s) END END AS category FROM c""")  # fmt: skip
def preprint_categories(spark, sf):
    return table(spark, sf, "documents").select("doc_id", adapters.category(F.expr(_CATEGORY)).alias("category"))


_URL = """CASE page_id % 14 WHEN 0 THEN 'https://www.reddit.com/r/Topic_' || page_id || '/new' WHEN 1 THEN 'https://old.reddit.com/r/x' WHEN 2 THEN 'https://github.com/owner' || page_id || '/repo.git' WHEN 3 THEN 'https://github.com/features/x'
  WHEN 4 THEN 'https://www.youtube.com/channel/UC' || lpad(CAST(page_id AS STRING), 22, '-') WHEN 5 THEN 'https://m.youtube.com/feeds/videos.xml?channel_id=UC' || lpad(CAST(page_id AS STRING), 22, '_') WHEN 6 THEN 'https://youtu.be/' || page_id
  WHEN 7 THEN 'https://arxiv.org/list/cs.lg/recent' WHEN 8 THEN 'https://export.arxiv.org/api/query?x=' || page_id WHEN 9 THEN 'https://github.com/o/r' || page_id || '/releases.atom' WHEN 10 THEN 'https://hn.algolia.com/api/v1/x'
  WHEN 11 THEN 'https://news.ycombinator.com/rss' ELSE url END"""
_PARTS = f"""WITH a AS (SELECT page_id, {_URL} AS u FROM pages), u AS (SELECT page_id, u, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host,
  regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM a), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM u),
  x AS (SELECT *, nullif(regexp_extract(u, '/r/([A-Za-z0-9_]{{2,21}})(?:[/?#.]|$)', 1), '') AS forum, CASE WHEN host = 'github.com' AND len(seg) >= 2 AND lower(seg[1]) NOT IN {urls.RESERVED_OWNERS!r} THEN seg[1] || '/' || regexp_replace(seg[2], '\\.git$', '') END AS repo,
    nullif(regexp_extract(u, '(?:channel/|channel_id=)(UC[A-Za-z0-9_-]{{22}})(?:[^A-Za-z0-9_-]|$)', 1), '') AS channel FROM s)"""


@query("url_identities", f"""{_PARTS} SELECT page_id, array_to_string(seg, ' ') AS segments, forum, repo, channel, host = 'youtu.be' OR host = 'youtube.com' OR host LIKE '%.youtube.com' AS video, CASE
  WHEN host = 'news.ycombinator.com' OR (host = 'hn.algolia.com' AND starts_with(path, '/api/')) THEN 'hackerNews' WHEN host = 'arxiv.org' OR host LIKE '%.arxiv.org' THEN 'arxiv' WHEN host = 'reddit.com' OR host LIKE '%.reddit.com' THEN 'reddit'
  WHEN host = 'github.com' AND path LIKE '%/releases.atom' THEN 'githubReleases' WHEN (host = 'youtube.com' OR host LIKE '%.youtube.com') AND starts_with(path, '/feeds/') THEN 'youtube' ELSE 'feed' END AS kind FROM x""")  # fmt: skip
def url_identities(spark, sf):
    u = F.col("u")
    rows = table(spark, sf, "pages").select("page_id", F.expr(_URL).alias("u"))
    return rows.select("page_id", F.array_join(urls.path_segments(u), " ").alias("segments"), urls.subreddit(u).alias("forum"), urls.github_repo(u).alias("repo"), urls.youtube_channel(u).alias("channel"), urls.is_video(u).alias("video"), urls.source_kind(u).alias("kind"))


@query("host_feeds", f"""{_PARTS} SELECT page_id, CASE WHEN (host = 'reddit.com' OR host LIKE '%.reddit.com') AND forum IS NOT NULL THEN 'https://www.reddit.com/r/' || forum || '/.rss'
  WHEN (host = 'youtube.com' OR host LIKE '%.youtube.com') AND channel IS NOT NULL THEN 'https://www.youtube.com/feeds/videos.xml?channel_id=' || channel WHEN repo IS NOT NULL THEN 'https://github.com/' || repo || '/releases.atom'
  WHEN host = 'arxiv.org' AND seg[1] = 'list' THEN 'https://export.arxiv.org/api/query?search_query=cat:cs.LG&sortBy=submittedDate&sortOrder=descending&max_results=100' END AS feed FROM x""")  # fmt: skip
def host_feeds(spark, sf):
    """Addresses of known hosts lead to their feeds without discovery."""
    return table(spark, sf, "pages").select("page_id", adapters.host_feed(F.expr(_URL)).alias("feed"))


_TYPED = """CASE page_id % 9 WHEN 0 THEN 'feed:' || url WHEN 1 THEN '//h' || page_id || '.example' WHEN 2 THEN ' example.org?x=' || page_id WHEN 3 THEN 'localhost:8080' WHEN 4 THEN 'two words.example' WHEN 5 THEN 'ftp://a.example/'
  WHEN 6 THEN 'FEED://a.example/b' WHEN 7 THEN 'plain' ELSE url END"""


@query("web_addresses", f"""WITH a AS (SELECT page_id, regexp_replace(trim({_TYPED}), '^(?i:feed:)', '') AS t FROM pages), b AS (SELECT page_id, CASE WHEN starts_with(t, '//') THEN 'https:' || t WHEN contains(t, '://') THEN t ELSE 'https://' || t END AS t FROM a),
  c AS (SELECT page_id, CASE WHEN regexp_full_match(t, '[^:/]+://[^/?#]+([?#].*)?') THEN regexp_replace(t, '^([^:/]+://[^/?#]+)', '\\1/') ELSE t END AS t FROM b)
  SELECT page_id, CASE WHEN regexp_matches(t, '^(?i:https?)://(?:[^/?#\\s]*\\.[^/?#\\s]*|localhost(?::\\d+)?)/\\S*$') THEN t END AS address FROM c""")  # fmt: skip
def web_addresses(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.web_address(F.expr(_TYPED)).alias("address"))


_LINKED = """'<link rel="alternate" type="application/rss+xml" href="/feed?a=1&amp;b=' || page_id || '" title="A &amp; B"><LINK rel=stylesheet href=x.css><linkfoo rel="alternate">' || html || '<link type=''application/atom+xml; charset=utf-8'' rel="home Alternate"
  href=''sub' || (page_id % 3) || '.atom''/><link rel="alternate" type="application/rss+xml" href="/feed?a=1&amp;b=' || page_id || '"><link rel="alternate" type="text/html" href="/x"><link rel="alternate" type="application/rdf+xml" href="mailto:x">'"""
_ATTR = {n: f"""coalesce(nullif(regexp_extract(tag, '(?is)[\\s"'']{n}\\s*=\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?is)[\\s"'']{n}\\s*=\\s*''([^'']*)''', 1), ''), nullif(regexp_extract(tag, '(?is)[\\s"'']{n}\\s*=\\s*([^\\s"''>]+)', 1), ''), '')""" for n in ("rel", "type", "href", "title")}


@query("feed_links", f"""WITH h AS (SELECT page_id, url, regexp_extract_all({_LINKED}, '(?is)<link[\\s/][^>]*>') AS tags FROM pages), t AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS position FROM h),
  a AS (SELECT page_id, url, position, {_ATTR['rel']} AS rel, trim(lower(split_part({_ATTR['type']}, ';', 1))) AS kind, {entities_sql(_ATTR['href'])} AS href, {entities_sql(_ATTR['title'])} AS title FROM t),
  f AS (SELECT page_id, position, title, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href WHEN contains(href, ':') THEN href
    ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*((?:/[^/?#]*)*/)', 1), ''), '/') || href END AS feed
    FROM a WHERE list_contains(string_split(lower(rel), ' '), 'alternate') AND kind IN {adapters.FEED_TYPES!r})
  SELECT page_id, min(position)::INT AS position, feed, arg_min(title, position) AS title FROM f WHERE starts_with(feed, 'http') GROUP BY page_id, feed""")  # fmt: skip
def feed_links(spark, sf):
    """Feeds that pages link to, in the order of the page and once each."""
    return adapters.advertised_feeds(table(spark, sf, "pages").select("page_id", "url", F.expr(_LINKED).alias("html")))


@query("catalog_search", "SELECT page_id FROM pages WHERE contains(strip_accents(lower(url || ' ' || html)), 'example') AND contains(strip_accents(lower(url || ' ' || html)), 'ouque')")
def catalog_search(spark, sf):
    """Entries that hold every word, whatever its case and accents."""
    return table(spark, sf, "pages").where(adapters.found_in("ÔUQUE Exámple", F.col("url"), F.col("html"))).select("page_id")


_LOAD = """named_struct('kind', CASE doc_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'githubReleases' WHEN 2 THEN 'arxiv' ELSE 'feed' END, 'video', doc_id % 23 = 3, 'chars', CASE WHEN doc_id % 7 <> 0 THEN length(text) END,
  'words', CASE WHEN doc_id % 7 <> 0 THEN length(text) / 6 END, 'link', doc_id % 11 <> 4, 'page', doc_id % 2 = 0, 'paper', doc_id % 6 = 2, 'abstract', doc_id % 4 <> 2)"""


@query("article_source", """WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'githubReleases' WHEN 2 THEN 'arxiv' ELSE 'feed' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS chars FROM documents)
  SELECT doc_id, CASE WHEN kind = 'youtube' THEN 'external' WHEN kind = 'githubReleases' THEN CASE WHEN chars > 0 THEN 'feed' ELSE 'none: The release has no notes' END
    WHEN kind = 'arxiv' THEN CASE WHEN doc_id % 6 = 2 THEN 'paper' WHEN chars > 0 THEN 'feed' WHEN doc_id % 4 <> 2 THEN 'abstract' ELSE 'none: No HTML version and no abstract' END
    WHEN doc_id % 23 = 3 THEN 'external' WHEN chars >= 1200 THEN 'feed' WHEN doc_id % 11 = 4 THEN CASE WHEN chars > 0 THEN 'feed' ELSE 'none: The item has no link' END
    WHEN doc_id % 6 = 2 THEN 'paper' WHEN doc_id % 2 = 0 THEN 'page' WHEN chars / 6 >= 150 THEN 'feed' ELSE 'none: page' END AS source FROM a""")  # fmt: skip
def article_source(spark, sf):
    """Feed, page, paper or abstract: where an article's text comes from."""
    a = table(spark, sf, "documents").select("doc_id", F.expr(_LOAD).alias("a"))
    chosen = adapters.chosen_text(*[F.col(f"a.{c}") for c in ("kind", "video", "chars", "words", "link", "page", "paper", "abstract")])
    return a.select("doc_id", chosen.alias("source"))


_TYPE = "CASE page_id % 7 WHEN 0 THEN 'text/html; charset=utf-' || page_id WHEN 1 THEN 'text/xml;q=1; Charset = \"ISO-8859-1\"' WHEN 2 THEN 'text/html' WHEN 3 THEN 'charset=x' WHEN 4 THEN 'a; charset' WHEN 5 THEN 'a;charset=''u=8''' END"


@query("content_charset", f"SELECT page_id, nullif(trim(regexp_extract(';' || substr(t, strpos(t, ';')), '(?i);\\s*charset\\s*=([^;]*)', 1), ' \"'''), '') AS charset FROM (SELECT page_id, {_TYPE} AS t FROM pages) WHERE contains(t, ';') UNION ALL SELECT page_id, NULL FROM (SELECT page_id, {_TYPE} AS t FROM pages) WHERE NOT coalesce(contains(t, ';'), false)")
def content_charset(spark, sf):
    return table(spark, sf, "pages").select("page_id", http.charset(F.expr(_TYPE)).alias("charset"))


_ANSWER = """named_struct('status', CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END, 'after', CASE event_id % 7 WHEN 0 THEN '120' WHEN 1 THEN ' 30.5 ' WHEN 2 THEN 'Tue, 05 Mar 2024 10:20:30 GMT' WHEN 3 THEN '1709634030' WHEN 4 THEN 'soon' WHEN 5 THEN '-5' END,
  'remaining', CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '12' WHEN 2 THEN 'x' END, 'reset', CASE event_id % 3 WHEN 0 THEN '1709634000' WHEN 1 THEN '45' END)"""


@query("server_delays", """WITH a AS (SELECT event_id, event_id % 4 AS s, CASE event_id % 7 WHEN 0 THEN 120.0 WHEN 1 THEN 30.5 WHEN 2 THEN 30.0 WHEN 3 THEN 30.0 WHEN 5 THEN 0.0 END::DOUBLE AS after, event_id % 5 = 0 AS spent, CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 45.0 END::DOUBLE AS reset FROM events)
  SELECT event_id, CASE WHEN s = 0 OR (s = 1 AND after IS NOT NULL) THEN coalesce(after, reset, 60.0) WHEN spent THEN reset END AS seconds FROM a""")  # fmt: skip
def server_delays(spark, sf):
    """How long an answer asks to stay away; the clock stands at 1709634000."""
    a = table(spark, sf, "events").select("event_id", F.expr(_ANSWER).alias("a"))
    return a.select("event_id", http.cooldown(F.col("a.status"), F.col("a.after"), F.col("a.remaining"), F.col("a.reset"), F.lit(1_709_634_000)).alias("seconds"))


@query("refresh_reasons", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'no internet connection' WHEN 1 THEN 'the server took too long to answer' WHEN 2 THEN 'the feed is gone (HTTP ' || CASE WHEN user_id % 2 = 0 THEN 404 ELSE 410 END || ')'
  WHEN 3 THEN 'the server answered HTTP ' || (500 + user_id) WHEN 4 THEN 'the server asked to wait ' || ceil(value)::BIGINT || ' s' WHEN 5 THEN 'the server asked to slow down' WHEN 6 THEN 'the address doesn''t return a feed' ELSE props END AS reason FROM events""")  # fmt: skip
def refresh_reasons(spark, sf):
    kinds = F.array(*map(F.lit, ("offline", "timedOut", "http", "http", "rateLimited", "rateLimited", "notAFeed", "network")))
    n = (F.col("event_id") % 8).cast("int")
    status = F.when(n == 2, F.when(F.col("user_id") % 2 == 0, 404).otherwise(410)).otherwise(500 + F.col("user_id"))
    return table(spark, sf, "events").select("event_id", http.reason(F.get(kinds, n), status, F.when(n == 4, F.col("value")), F.col("props")).alias("reason"))


@query("redacted_details", "SELECT doc_id, left(replace(left(text, doc_id % 300) || 'key-' || doc_id || text, 'key-' || doc_id, '<key>'), 300) AS detail FROM documents")
def redacted_details(spark, sf):
    """Secrets go before the cut, also where they cross it."""
    key = F.concat(F.lit("key-"), F.col("doc_id").cast("string"))
    detail = F.concat(F.left("text", (F.col("doc_id") % 300).cast("int")), key, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", http.redacted(detail, key).alias("detail"))


@query("typed_ages", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 60) * 60.0 WHEN 1 THEN (event_id % 60) * 3600.0 WHEN 2 THEN (event_id % 60) * 86400.0 ELSE 0.0 END::DOUBLE AS seconds FROM events")
def typed_ages(spark, sf):
    typed = F.concat((F.col("event_id") % 60).cast("string"), F.get(F.array(*map(F.lit, ("m", "h", "d", "w", ""))), (F.col("event_id") % 5).cast("int")))
    return table(spark, sf, "events").select("event_id", http.seconds_of_age(typed).alias("seconds"))


@query("year_before", "SELECT event_id, strftime(ts + INTERVAL 59 DAY - INTERVAL 1 YEAR, '%Y-%m-%d %H:%M:%S') AS before FROM events")
def year_before(spark, sf):
    ts = F.col("ts") + F.expr("INTERVAL 59 DAY")  # over the 29th of February
    return table(spark, sf, "events").select("event_id", F.date_format(http.year_before(ts), "yyyy-MM-dd HH:mm:ss").alias("before"))


def fnv_sql(t: str) -> str:
    """Of text, over the hexadecimal digits of its UTF-8 bytes."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({t})), {at}, 1)) - 1)"
    byte = f"({digit('2 * i - 1')} * 16 + {digit('2 * i')})::UHUGEINT"
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, 1 + strlen({t})), lambda i: {byte})), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query("fnv_hashes", f"SELECT page_id, {fnv_sql('url')}::DECIMAL(20, 0)::VARCHAR AS hash FROM pages")
def fnv_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", bodies.fnv1a("url").cast("string").alias("hash"))


@query("json_pages", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN length(text) >= 200 THEN sha256(text) ELSE sha256('') END WHEN 1 THEN sha256('') WHEN 2 THEN CASE WHEN length(text) >= 200 THEN sha256(text) ELSE sha256('') END END AS body_sha256 FROM documents""")
def json_pages(spark, sf):
    """Posts that come as JSON: nested, without a body, by language; and pages that aren't JSON."""
    t = F.col("text")
    nested = F.to_json(F.struct(F.lit(1).alias("id"), F.array(F.struct(F.lit("short").alias("content"), F.struct(t.alias("articleBody")).alias("object"))).alias("items")))
    mapped = F.to_json(F.struct(F.create_map(F.lit("en"), t).alias("contentMap")))
    page = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" \n"), nested)).when(F.col("doc_id") % 4 == 1, '{"error": {"content": 5}}').when(F.col("doc_id") % 4 == 2, mapped).otherwise(F.concat(F.lit("{not json"), t))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", page.alias("page"))
    return rows.select("doc_id", F.sha2(bodies.json_body("page"), 256).alias("body_sha256"))


@query("embedded_articles", "SELECT doc_id, CASE WHEN length(text) >= 600 THEN sha256('<p>' || array_to_string(string_split(text, chr(10)), '</p>' || chr(10) || '<p>') || '</p>') END AS body_sha256 FROM documents")
def embedded_articles(spark, sf):
    """Articles that pages keep in JSON-LD, beside other payloads."""
    ld = F.to_json(F.struct(F.lit("x").alias("@type"), F.array(F.struct(F.col("text").alias("articleBody"))).alias("@graph")))
    html = F.concat(F.lit("<script type='application/ld+json'>{broken</script><SCRIPT data-x type=\"application/ld+json\">"), ld, F.lit("</script>"))
    rows = table(spark, sf, "documents").select("doc_id", bodies.json_ld(html).alias("payloads"))
    return rows.select("doc_id", F.sha2(bodies.embedded_body("payloads"), 256).alias("body_sha256"))


@query("page_bytes", "SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 3 THEN 'É“x” <meta charset=latin1>' || doc_id ELSE text END) AS text_sha256 FROM documents")
def page_bytes(spark, sf):
    """Pages as bytes: plain UTF-8, with a mark, UTF-16, Windows-1252 under a Latin-1 label, and a wrong label."""
    k, t = F.col("doc_id") % 5, F.col("text")
    western = F.concat(F.unhex(F.lit("C99378")), F.unhex(F.lit("94")), F.encode(F.concat(F.lit(" <meta charset=latin1>"), F.col("doc_id").cast("string")), "UTF-8"))
    data = F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(k == 2, F.encode(t, "UTF-16")).when(k == 3, western).otherwise(F.encode(t, "UTF-8"))
    declared = F.when(k == 4, "no-such-charset").when(k == 0, "UTF8")
    rows = table(spark, sf, "documents").select("doc_id", data.alias("data"), declared.alias("declared"))
    return rows.select("doc_id", F.sha2(bodies.page_decoded("data", "declared"), 256).alias("text_sha256"))


@query("article_counts", f"""SELECT page_id, len(list_filter(string_split({collapse_sql(entities_sql(strip_sql('html')))}, ' '), lambda x: x <> ''))::BIGINT AS words, length({collapse_sql(entities_sql(strip_sql('html')))})::BIGINT AS characters,
  len(regexp_extract_all(html, '(?i)<img[\\s/>]'))::BIGINT AS images, len(regexp_extract_all(html, '(?i)<table[\\s>]'))::BIGINT AS tables FROM pages""")  # fmt: skip
def article_counts(spark, sf):
    plain = text.plain_text(F.col("html"))
    rows = table(spark, sf, "pages").select("page_id", plain.alias("t"), F.regexp_count("html", F.lit(r"(?i)<img[\s/>]")).cast("long").alias("images"), F.regexp_count("html", F.lit(r"(?i)<table[\s>]")).cast("long").alias("tables"))
    return rows.select("page_id", F.size(F.filter(F.split("t", " "), lambda x: x != "")).cast("long").alias("words"), F.length("t").cast("long").alias("characters"), "images", "tables")
