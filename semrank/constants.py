"""Thresholds and windows of the engine. Results depend on each of them."""

import math

LIST_FOUND, LIST_UNSURE = 0.60, 0.45
PASSAGE_FOUND, PASSAGE_UNSURE = 0.75, 0.25  # found at or above, unsure strictly above
SATURATION_SHARE, SATURATION_CHECKED = 0.35, 24
LIST_CAP, PASSAGE_CAP = math.nextafter(LIST_FOUND, 0), math.nextafter(PASSAGE_FOUND, 0)
FIRST_WINDOW, OLDER_WINDOW, LOAD_LIMIT = 300, 1200, 2000
PREJUDGED_ITEMS, PREJUDGED_PASSAGES = 3, 40
SNIPPET_CHARS, SENTENCE_CHARS, TITLE_CHARS = 300, 200, 100
PASSAGE_MIN, PASSAGE_MAX, PASSAGE_COUNT = 40, 1200, 400
ARTICLE_WORDS, PAYWALL_WORDS = 150, 400
DOLLARS_PER_TOKEN, DAILY_DOLLARS, READING_RESERVE = 0.042 / 1e6, 0.50, 0.05
SEEN_PRECISION_S, FAILING_S, FUTURE_S, ARTICLE_RETRY_S = 86_400, 86_400, 86_400, 3_600
FAILURES_IN_A_ROW, PINS = 10, 9
RANK_STEPS = 20
JUDGEABLE = ("paragraph", "quote", "listItem")
