"""Bodies that need a parser: bytes of pages, JSON pages, articles in JSON-LD, a stable hash. Whole bodies cross to Python in small batches."""

from __future__ import annotations

import codecs
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

# Fields of a post's own HTML by trust, characters of a body in JSON and in JSON-LD, bytes searched for a charset.
BODY_KEYS = ("content", "articleBody", "body", "html", "text")
JSON_CHARS, JSON_LD_CHARS, META_BYTES = 200, 600, 8192
# Where a page names its charset, names that mean Windows-1252, marks at the start of a text.
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.\-]+)", re.I)
_LATIN = ("ascii", "cp1252", "iso-8859-1", "iso8859-1", "latin-1", "latin1", "us-ascii", "windows-1252")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD payloads of a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)


def _loaded(text: str | None):
    try:
        return json.loads(text) if text and text.lstrip()[:1] in ("{", "[") else None
    except ValueError:
        return None


def _first(value, pick, depth: int) -> str | None:
    """The first body that pick finds, in the order of the document and not deeper than `depth`."""
    todo = [(value, 0)]
    while todo:
        now, at = todo.pop()
        if at < depth and isinstance(now, dict | list):
            if isinstance(now, dict) and (found := pick(now)):
                return found
            todo += [(x, at + 1) for x in reversed(list(now.values()) if isinstance(now, dict) else now)]
    return None


def _post(d: dict) -> str | None:
    bodies = [d.get(k) for k in BODY_KEYS] + (list(d["contentMap"].values()) if isinstance(d.get("contentMap"), dict) else [])
    return next((x for x in bodies if isinstance(x, str) and len(x) >= JSON_CHARS), None)


def _marked(d: dict) -> str | None:
    body = d.get("articleBody")
    return body if isinstance(body, str) and len(body) >= JSON_LD_CHARS else None


# Whole bodies go to Python a hundred at a time: an Arrow batch would hold 10,000 of them, and their results, in a worker.
@F.udf(StringType(), useArrow=False)
def json_body(text: str | None) -> str | None:
    """The HTML of a post that came as JSON; empty for JSON without one, null for text that isn't JSON."""
    loaded = _loaded(text)
    return None if loaded is None else _first(loaded, _post, 6) or ""


@F.udf(StringType(), useArrow=False)
def embedded_body(payloads: list[str] | None) -> str | None:
    """The article in a page's JSON-LD payloads as paragraphs, one a line; null if there is none."""
    body = next((b for b in (_first(_loaded(x), _marked, 8) for x in payloads or ()) if b), None)
    return body and "\n".join(f"<p>{line}</p>" for line in re.split(r"\r\n|[\n\r  \x85\x0b\x0c]", body))


def _known(label: str | None) -> str | None:
    name = (label or "").strip(" \t\"'").lower()
    if name in _LATIN:
        return "cp1252"
    try:
        return codecs.lookup(name).name if name else None
    except (LookupError, ValueError):
        return None


def _damaged(data: bytes) -> bool:
    """Whether nearly all bytes over 127 belong to whole UTF-8 characters."""
    text = data.decode("utf-8", "replace")
    good = sum("\x7f" < c != "�" for c in text)
    return good > 0 and good >= 8 * text.count("�")


def _readings(data: bytes, declared: str | None) -> list[tuple[str, str]]:
    """(charset, what to do with errors) in the order of trust: a mark at the start alone, or the charset of the answer, that of the
    page, UTF-8 (repaired if only a little is broken), Windows-1252, and UTF-8 however much is broken.
    """
    marked = [(name, "replace") for mark, name in _MARKS if data.startswith(mark)]
    if marked:
        return marked[:1]
    meta = _META.search(data[:META_BYTES])
    named = [_known(declared), _known(meta and meta[1].decode()), "utf-8"]
    told = [(name, how) for name in dict.fromkeys(n for n in named if n) for how in (("strict", "repair") if name == "utf-8" else ("strict",))]
    return [*told, ("cp1252", "strict"), ("utf-8", "replace")]


def _read(data: bytes, charset: str, errors: str) -> str | None:
    if errors == "repair":
        return data.decode(charset, "replace") if _damaged(data) else None
    try:
        return data.decode(charset, errors)
    except (UnicodeDecodeError, ValueError):
        return None


def page_text(data: bytes | None, declared: str | None) -> str | None:
    """Text of a page's bytes by the first of its _readings() that works."""
    if data is None:
        return None
    texts = (_read(data, *how) for how in _readings(data, declared))
    return next(t for t in texts if t is not None).lstrip("\ufeff")


@F.udf(StringType(), useArrow=False)
def page_decoded(data: bytes | None, declared: str | None) -> str | None:
    return page_text(None if data is None else bytes(data), declared)


@F.pandas_udf(DecimalType(20, 0))
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of UTF-8 bytes, unsigned: one step for the nth bytes of all rows at a time."""
    from decimal import Decimal

    raw = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in text]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    h = np.full(len(raw), 14_695_981_039_346_656_037, dtype=np.uint64)
    longest = size[order]
    for i in range(int(size.max(initial=0))):
        rows = order[: np.searchsorted(-longest, -i, side="left")]
        h[rows] = (h[rows] ^ data[start[rows] + i]) * np.uint64(1_099_511_628_211)
    return pd.Series([None if t is None else Decimal(int(x)) for t, x in zip(text, h, strict=True)], dtype=object)
