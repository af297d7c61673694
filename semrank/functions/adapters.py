"""What each kind of source needs besides its feed: identities, categories, advertised feeds, texts without signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semrank.functions import entities, text, urls

# Archives of the preprint server.
ARCHIVES = (
    "astro-ph", "cond-mat", "cs", "econ", "eess", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "math", "math-ph",
    "nlin", "nucl-ex", "nucl-th", "physics", "q-bio", "q-fin", "quant-ph", "stat",
)
# The line that ends every post of the forum, in text and in HTML.
SIGNATURE = r"(?i)\s*submitted by\s+/u/\S+(\s+to\s+r/\S+)?(\s*\[link\])?(\s*\[comments\])?\s*$"
SIGNATURE_HTML = r"(?i)(?:&#32;|\s)*submitted by(?:&#32;|\s)*<a [^>]*>\s*/u/.*$"
# Media types of feeds.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml")


def preprint_address(url: Column) -> Column:
    return F.regexp_replace(url, "^http://arxiv\\.org/", "https://arxiv.org/")


def preprint_identity(guid: Column) -> Column:
    """Revisions of a paper are one item."""
    return F.regexp_replace(preprint_address(guid), r"v[0-9]+$", "")


def category(typed: Column) -> Column:
    """The server's spelling of a category, null for anything else: two-letter subjects in capitals, others in lower case."""
    parts = F.split(F.trim(typed), r"\.")
    archive, subject = F.lower(F.get(parts, 0)), F.get(parts, 1)
    named = F.when(subject.rlike(r"^[A-Za-z-]{2,12}$"), F.concat(archive, F.lit("."), F.when(F.length(subject) == 2, F.upper(subject)).otherwise(F.lower(subject))))
    return F.when(archive.isin(*ARCHIVES) & (F.size(parts) <= 2), F.when(F.size(parts) == 1, archive).otherwise(named))


def listed_category(url: Column) -> Column:
    parts = urls.path_segments(url)
    return F.when((urls.bare_host(url) == "arxiv.org") & (F.get(parts, 0) == "list"), category(F.get(parts, 1)))


def forum_post(content: Column) -> tuple[Column, Column]:
    """(snippet, content) of a post without its signature; content is null where it says no more than the snippet."""
    post = F.regexp_replace(text.plain_text(content), SIGNATURE, "")
    short = text.snippet(post)
    return short, F.when(F.length(post) > F.length(short), F.regexp_replace(content, SIGNATURE_HTML, ""))


def host_feed(url: Column) -> Column:
    """The feed of an address whose host is known, before any discovery; null elsewhere."""
    host = urls.bare_host(url)
    channel, forum, repo = urls.youtube_channel(url), urls.subreddit(url), urls.github_repo(url)
    on = lambda name: (host == name) | host.endswith("." + name)
    made = lambda kind, name: F.when(name.isNotNull(), urls.feed_address(F.lit(kind), name))
    return F.coalesce(
        F.when(on("reddit.com"), made("reddit", forum)), F.when(on("youtube.com"), made("youtube", channel)),
        made("githubReleases", repo), made("arxiv", listed_category(url)),
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, quoted or bare; null if it isn't there."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = [F.nullif(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(*found)


def resolved(href: Column, base: Column) -> Column:
    """href against the address of its page, without dot segments."""
    origin, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def advertised_feeds(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): page_id, position, feed, title of each feed that a page links to, in order and once."""
    tags = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<link[\s/][^>]*>)"), 1)).alias("position", "tag"))
    tag = F.col("tag")
    kind = F.trim(F.lower(F.substring_index(attribute(tag, "type"), ";", 1)))
    href = F.trim(text.basic_entities(attribute(tag, "href")))
    rows = tags.where(F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "alternate") & kind.isin(*FEED_TYPES) & (href != ""))
    rows = rows.select("page_id", "position", resolved(href, F.col("url")).alias("feed"), F.coalesce(text.basic_entities(attribute(tag, "title")), F.lit("")).alias("title"))
    first = F.row_number().over(Window.partitionBy("page_id", "feed").orderBy("position"))
    return rows.where(F.col("feed").rlike("^(?i:https?)://")).withColumn("_n", first).where("_n = 1").drop("_n")


def found_in(query: str, *fields: Column) -> Column:
    """Whether every word of the query is in the fields, in any order and without regard to case or accents."""
    folded = lambda c: F.collate(c, "UNICODE_CI_AI")
    hay = F.concat_ws(" ", *fields)
    out = F.lit(True)
    for word in query.split():
        out = out & F.contains(folded(hay), folded(F.lit(word)))
    return out


def chosen_text(kind: Column, video: Column, feed_chars: Column, feed_words: Column, link: Column, page_ready: Column, paper_ready: Column, abstract: Column) -> Column:
    """Where an article's text comes from: external, feed, paper, page, abstract, or why there is none. feed_chars and feed_words
    are null without feed content; abstract tells whether the item has one.
    """
    has = F.coalesce(feed_chars > 0, F.lit(False))
    release = F.when(has, "feed").otherwise("none: The release has no notes")
    preprint = F.when(paper_ready, "paper").when(has, "feed").when(abstract, "abstract").otherwise("none: No HTML version and no abstract")
    usual = (
        F.when(video, "external").when(feed_chars >= FEED_CHARS, "feed").when(~link & has, "feed").when(~link, "none: The item has no link")
        .when(paper_ready, "paper").when(page_ready, "page").when(feed_words >= ARTICLE_WORDS, "feed").otherwise("none: page")
    )
    return F.when(kind == "youtube", "external").when(kind == "githubReleases", release).when(kind == "arxiv", preprint).otherwise(usual)


# Characters of feed content that stand for the article, and words of an article.
FEED_CHARS, ARTICLE_WORDS = 1200, 150


def decoded_attribute(tag: Column, name: str) -> Column:
    """attribute() with every entity decoded, not only the basic ones."""
    return entities.decode_entities(attribute(tag, name))
