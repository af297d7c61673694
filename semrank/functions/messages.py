"""Lines under lists and articles: the first message that applies, as Columns. Texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.constants import FIRST_WINDOW, LOAD_LIMIT, OLDER_WINDOW
from semrank.functions.text import count_of

KEYS = (("missing", "Add a key to search."), ("rejected", "The key was rejected."), ("storageError", "Couldn't access the key."))
OUTCOMES = (("dailyLimit", "Daily limit reached. Resets at midnight."), ("offline", "Offline. Showing what was already checked."), ("stopped", "Stopped after repeated errors."))
NOTE = "Exclusions, amounts and dates aren't judged."
CODE = "Code not checked."


def _first(*rules: tuple[Column, Column | str]) -> Column:
    out = None
    for applies, says in rules:
        out = F.when(applies, says) if out is None else out.when(applies, says)
    return out


def _cases(value: Column, table) -> list[tuple[Column, str]]:
    return [(value == k, says) for k, says in table]


def number(n: Column) -> Column:
    return F.format_number(n, 0)


def list_foot(sources, ranked, key, outcome, running, progress, unchecked, checked, window, loaded, total, error, title, unjudgeable) -> Column:
    """error: of the source in scope, null without; title: of the source in scope, null without. Empty for no sources."""
    covered = F.least(window, loaded)
    older = F.least(F.lit(OLDER_WINDOW), total - covered)
    items = F.concat(count_of(loaded, "item"), F.coalesce(F.concat(F.lit(" in "), title), F.lit("")))
    return _first(
        (sources == 0, ""), *((ranked & c, says) for c, says in (*_cases(key, KEYS), *_cases(outcome, OUTCOMES))),
        (ranked & ~running & (unchecked > 0), F.concat(number(unchecked), F.lit(" not checked."))),
        (error.isNotNull(), F.concat(F.lit("Couldn't refresh: "), error, F.lit("."))), (~ranked, items), (unjudgeable, NOTE),
        (running & progress, F.concat(number(checked), F.lit(" of "), number(covered), F.lit(" checked"))),
        (running, F.concat(F.lit("Checking "), count_of(covered, "item"))),
        (covered < total, F.concat(F.lit("Newest "), number(covered), F.lit(" of "), number(total), F.lit(" checked. Check "), number(older), F.lit(" older"))),
        (F.lit(True), F.concat(count_of(checked, "item"), F.lit(" checked"))),
    )


def empty_line(sources, refreshing, items, ranked, running, can_send, outcome, checked) -> Column:
    """The line of an empty list; null where nothing may be said. Nothing is "not found" before it was checked."""
    settled = ~running & can_send & (outcome.isNull() | (outcome == "completed"))
    return _first(
        (sources == 0, "No sources yet."), (refreshing & (items == 0), "Getting your sources"), (~ranked & (items == 0), "No items yet."),
        (ranked & settled, F.concat(F.lit("Nothing found in "), count_of(checked, "item"), F.lit(" checked"))),
    )


def reader_foot(asked, judgeable, code, running, finding, failed, key, outcome, checked, found, unsure, saturated, by_title) -> Column:
    """asked: whether there is a sentence; finding: whether it was typed in the article."""
    of = F.concat(number(checked), F.lit(" of "), number(judgeable), F.lit(" checked"))
    none = (found + unsure) == 0
    sides = F.concat_ws(", ", F.when(found > 0, F.concat(number(found), F.lit(" found"))), F.when(unsure > 0, F.concat(number(unsure), F.lit(" unsure"))))
    nothing = F.concat(F.when(by_title, "Matched by title. ").otherwise(""), F.lit("Nothing found in "), count_of(checked, "paragraph"), F.lit(" checked"))
    said = F.when(none, nothing).otherwise(sides)
    return _first(
        (~asked | (judgeable == 0), F.when(code & (judgeable == 0), CODE).otherwise("")), (running & finding, "Checking"), (running & (failed == 0), F.concat(F.lit("Checking "), count_of(judgeable, "paragraph"))),
        (running, of), *_cases(key, KEYS), *_cases(outcome, OUTCOMES), (checked < judgeable, F.concat(of, F.lit("."))), (saturated, "Most of this article is about this."),
        (none & finding, F.concat(F.lit("Nothing found in "), number(checked), F.lit(" checked"))), (code, F.concat(said, F.lit(". " + CODE))), (F.lit(True), said),
    )


def load_limit(ranked, pin, older) -> Column:
    """Rows that a list loads: its judge window, and for a pin at least what it found on earlier days; LOAD_LIMIT unranked."""
    window = F.lit(FIRST_WINDOW) + older * OLDER_WINDOW
    return F.when(~ranked, LOAD_LIMIT).when(pin, F.greatest(F.lit(LOAD_LIMIT), window)).otherwise(window)


def judges(scoped_to_source, has_sentence) -> Column:
    """A sentence over one source only filters what is there; it never asks the judge."""
    return has_sentence & ~scoped_to_source
