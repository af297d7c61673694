"""URL functions as Columns: hosts, kinds of source, identities, campaign parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_host(url: Column) -> Column:
    """Lower-case host without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def source_kind(url: Column) -> Column:
    """Which adapter reads a feed address."""
    host, path = bare_host(url), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return (
        F.when((host == "news.ycombinator.com") | ((host == "hn.algolia.com") & path.startswith("/api/")), "hackerNews")
        .when((host == "arxiv.org") | host.endswith(".arxiv.org"), "arxiv")
        .when((host == "reddit.com") | host.endswith(".reddit.com"), "reddit")
        .when((host == "github.com") & path.endswith("/releases.atom"), "githubReleases")
        .when(((host == "youtube.com") | host.endswith(".youtube.com")) & path.startswith("/feeds/"), "youtube")
        .otherwise("feed")
    )


def without_campaign(url: Column) -> Column:
    """The url without utm_* parameters, the others byte for byte."""
    base, query, mark = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~F.lower(x).startswith("utm_")), "&")
    return F.when(F.contains(query, F.lit("utm_")), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), mark)).otherwise(url)


def arxiv_id(url: Column) -> Column:
    """Identifier without its version, null if there is none; a number of more digits than today's five is not cut to another paper's."""
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf|html)/([a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,})", 1), F.lit(""))


def subreddit(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/r/([A-Za-z0-9_]{2,21})(?:[/?#.]|$)", 1), F.lit(""))


# First path segments of the host that are not owners.
RESERVED_OWNERS = (
    "about", "collections", "enterprise", "explore", "features", "issues", "login", "marketplace", "notifications",
    "orgs", "pricing", "pulls", "search", "settings", "sponsors", "topics", "trending",
)


def github_repo(url: Column) -> Column:
    """owner/name of a repository page, null elsewhere."""
    parts = path_segments(url)
    return F.when((bare_host(url) == "github.com") & (F.size(parts) >= 2) & ~F.lower(F.get(parts, 0)).isin(*RESERVED_OWNERS), F.concat_ws("/", F.get(parts, 0), F.regexp_replace(F.get(parts, 1), r"\.git$", "")))


def youtube_channel(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:channel/|channel_id=)(UC[A-Za-z0-9_-]{22})(?:[^A-Za-z0-9_-]|$)", 1), F.lit(""))


def is_video(url: Column) -> Column:
    host = bare_host(url)
    return (host == "youtu.be") | (host == "youtube.com") | host.endswith(".youtube.com")


def web_address(typed: Column) -> Column:
    """What was typed as an http address with a path: feed: schemes replaced, https added; null if it can't be one."""
    t = F.regexp_replace(F.trim(typed), r"^(?i:feed:)", "")
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    t = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    t = F.regexp_replace(t, r"^([^:/]+://[^/?#]+)(?=$|[?#])", "$1/")
    return F.when(t.rlike(r"^(?i:https?)://(?:[^/?#\s]*\.[^/?#\s]*|localhost(?::\d+)?)/\S*$"), t)


def feed_address(kind: Column, name: Column) -> Column:
    """The feed of a category, channel, repository or subreddit."""
    return (
        F.when(kind == "arxiv", F.concat(F.lit("https://export.arxiv.org/api/query?search_query=cat:"), name, F.lit("&sortBy=submittedDate&sortOrder=descending&max_results=100")))
        .when(kind == "youtube", F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), name))
        .when(kind == "githubReleases", F.concat(F.lit("https://github.com/"), name, F.lit("/releases.atom")))
        .when(kind == "reddit", F.concat(F.lit("https://www.reddit.com/r/"), name, F.lit("/.rss")))
        .otherwise(name)
    )
