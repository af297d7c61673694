"""Bands, caps and the overlap judge as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.constants import LIST_CAP, LIST_FOUND, LIST_UNSURE, PASSAGE_CAP, PASSAGE_FOUND, PASSAGE_UNSURE
from semrank.functions.text import overlap, terms

NOTHING, UNSURE, FOUND = 0, 1, 2


def overlap_judge(text: Column, sentence: Column) -> Column:
    """0.9, 0.5 or 0.05 by the share of the sentence's words that the text has: at least 0.6, 0.3 or less."""
    share = overlap(text, sentence) / F.nullif(F.size(F.array_distinct(terms(sentence))), F.lit(0))
    return F.when(share >= 0.6, 0.9).when(share >= 0.3, 0.5).otherwise(0.05)


def valid_probability(p: Column) -> Column:
    """p if it is a finite number from 0 to 1, else null."""
    return F.when(~F.isnan(p) & p.between(0.0, 1.0), p)


def list_band(p: Column) -> Column:
    return F.when(p >= LIST_FOUND, FOUND).when(p >= LIST_UNSURE, UNSURE).when(p.isNotNull(), NOTHING)


def passage_band(p: Column) -> Column:
    return F.when(p >= PASSAGE_FOUND, FOUND).when(p > PASSAGE_UNSURE, UNSURE).when(p.isNotNull(), NOTHING)


def capped_for_list(p: Column, unjudgeable: Column) -> Column:
    """Kept under found where the sentence can't be judged in full."""
    return F.when(unjudgeable, F.least(p, F.lit(LIST_CAP))).otherwise(p)


def capped_for_passage(p: Column, unjudgeable: Column) -> Column:
    return F.when(unjudgeable, F.least(p, F.lit(PASSAGE_CAP))).otherwise(p)
