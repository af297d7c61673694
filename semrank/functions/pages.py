"""What a page says of itself, as Columns: title, paywall, need of scripts, and the verdict on its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.constants import ARTICLE_WORDS, PAYWALL_WORDS
from semrank.functions.text import plain_text

# Marks of paywalled pages, of pages that ask for scripts, and of empty shells.
PAYWALL = r'"isAccessibleForFree"\s*:\s*"?false|content_tier"\s+content\s*=\s*"(?:locked|metered)"'
PLEA = r"<noscript\b[^>]*>[\s\S]{0,2000}?(?:enable|requires?|activer|without)\s+javascript"
SHELL = r"""<div\b[^>]*\bid\s*=\s*["'](?:root|app|__next|__nuxt|react-root)["'][^>]*>\s*</div>"""
OG_TITLE = r"""<meta\b[^>]*\bproperty\s*=\s*["']og:title["'][^>]*\bcontent\s*=\s*"([^"]*)\""""
TITLE = r"<title\b[^>]*>(.*?)</title"


def declares_paywall(html: Column) -> Column:
    return html.rlike(f"(?i){PAYWALL}")


def needs_script(html: Column) -> Column:
    return html.rlike(f"(?i){PLEA}") | html.rlike(f"(?i){SHELL}")


def title(html: Column) -> Column:
    """og:title, else the title element, as plain text."""
    og, own = F.regexp_extract(html, f"(?is){OG_TITLE}", 1), F.regexp_extract(html, f"(?is){TITLE}", 1)
    return plain_text(F.when(og != "", og).otherwise(own))


def verdict(words: Column, paywalled: Column, script: Column) -> tuple[Column, Column]:
    """state (ready or unavailable) and reason."""
    short = words < ARTICLE_WORDS
    public = F.format_string("Paywalled: only %d words are public", words)
    reason = (
        F.when(paywalled & (words < PAYWALL_WORDS), public)
        .when(short & script, F.format_string("The page needs JavaScript to show its text (%d words without it)", words))
        .when(short, F.format_string("Too little text (%d words)", words))
    )
    return F.when(reason.isNull(), "ready").otherwise("unavailable").alias("state"), reason.alias("reason")

