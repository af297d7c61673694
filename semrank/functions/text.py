"""Text functions as Columns: terms, white space, snippets, tags, boilerplate, titles, ages, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.constants import SNIPPET_CHARS

# Tags that end a run of text, and the ends of a cut text.
BLOCK_TAGS = (
    "p", "br", "div", "li", "ul", "ol", "tr", "td", "th", "table", "blockquote", "pre", "hr", "section", "article",
    "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "figure", "figcaption", "header", "footer",
)
CUT_EDGE = " ,;:\\-–—(\\[\"'«"

# What publishing tools add to every excerpt.
BOILERPLATE = (
    r"(?is)\s*The post .{1,300} (?:first )?appeared first on .{1,120}$",
    r"(?is)\s*L['’]article .{1,300} est apparu en premier sur .{1,120}$",
    r"(?is)(?<=[.!?…\]»])\s*(?:Read more|Continue reading|Lire la suite)\b.{0,200}$",
    r"(?is)^Comments$",
)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of three characters or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 3)


def overlap(text: Column, asked: Column) -> Column:
    """Number of distinct asked terms in the text."""
    return F.size(F.array_intersect(F.array_distinct(terms(asked)), terms(text)))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space, zero-width spaces and byte-order marks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\p{Z}\s​﻿\u0085]+", " "))


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at a space among the last 40 if there is one, with an ellipsis."""
    head = F.substring(text, 1, limit - 1)
    tail = F.regexp_extract(head, r"( [^ ]*)$", 1)
    cut = F.when((tail != "") & (F.length(tail) <= 40), F.left(head, F.length(head) - F.length(tail))).otherwise(head)
    edge = f"[{CUT_EDGE}]+"
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, f"^{edge}|{edge}$", ""), F.lit("…")))


def strip_tags(html: Column) -> Column:
    """Text without tags: script and style bodies go, tags of blocks leave a space. Quoted `>` don't end a tag."""
    tag = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>", "")
    for name in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b{tag}.*?(?:</{name}\b{tag}|\z)", "")
    out = F.regexp_replace(out, rf"(?is)</?(?:{'|'.join(BLOCK_TAGS)})\b{tag}", " ")
    return F.regexp_replace(out, rf"(?is)</?[a-z][a-z0-9:_-]*{tag}", "")


def basic_entities(text: Column) -> Column:
    """The five entities of XML and the no-break space; functions.entities has all."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    return collapse(basic_entities(strip_tags(html)))


def without_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "")
    return text


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    return truncate(collapse(text), limit)


def normal_title(text: Column) -> Column:
    """Letters, marks and digits only, lower-cased, to compare titles."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]", "")


def same_title(a: Column, b: Column) -> Column:
    """One holds the other, both with 8 characters or more that count."""
    x, y = normal_title(a), normal_title(b)
    return (F.length(x) >= 8) & (F.length(y) >= 8) & (F.contains(x, y) | F.contains(y, x))


def age(seconds: Column) -> Column:
    """now, 5m, 3h, 2d, 4w, 7mo."""
    s = F.greatest(seconds, F.lit(0))
    steps = ((60, 1, None), (3600, 60, "m"), (86_400, 3600, "h"), (14 * 86_400, 86_400, "d"), (61 * 86_400, 7 * 86_400, "w"))
    out = None
    for below, unit, mark in steps:
        value = F.lit("now") if mark is None else F.concat(F.floor(s / unit).cast("string"), F.lit(mark))
        out = F.when(s < below, value) if out is None else out.when(s < below, value)
    return out.otherwise(F.concat(F.floor(s / (30.44 * 86_400)).cast("string"), F.lit("mo")))


def count_of(n: Column, noun: str) -> Column:
    """1,234 items."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, noun).otherwise(noun + "s"))
