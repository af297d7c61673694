"""Queries of the judge's answers, passes, prejudging, pins over changed items, and the lines under lists and articles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from semrank.functions import bodies, messages
from semrank.functions.judge import overlap_judge, valid_probability
from semrank.operators import judging, rank, reader
from semrank.plans.adapters import fnv_sql
from semrank.plans.base import query
from semrank.plans.items import item_text_hash
from semrank.plans.rank import ASKED, BASE, BASE_ALL, MODEL, _banded, _pairs
from semrank.plans.rank import _cached as cached
from semrank.plans.reader import W as READER
from semrank.plans.reader import _leveled
from semrank.sources.scratch import folder, written
from semrank.sources.tables import ITEM_SQL, PASSAGE_SQL, SENTENCES, items, live_items, passages, sentence_sql, table

_P = "CASE (event_id + {k}) % 7 WHEN 0 THEN '0.25' WHEN 1 THEN '1' WHEN 2 THEN '\"0.5\"' WHEN 3 THEN 'true' WHEN 4 THEN '1.5' WHEN 5 THEN 'null' ELSE '0.875e0' END"
_BODY = "CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE '{\"model\": \"' || CASE WHEN event_id % 13 = 0 THEN '' ELSE 'm' END || '\", \"usage\": {\"input_tokens\": ' || CASE WHEN event_id % 17 = 0 THEN '1.5' ELSE '600' END || '}, \"answers\": {' || " + " || ', ' || ".join(
    f"'\"q{k}\": {{\"type\": \"' || CASE WHEN (event_id + {k}) % 19 = 0 THEN 'other' ELSE 'noul' END || '\", \"noul\": ' || {_P.format(k=k)} || '}}'" for k in range(3)
) + " || '}}' END"


@query("judge_answers", """WITH f AS (SELECT event_id AS id, unnest([0, 1, 2]) AS frame FROM events), p AS (SELECT id, frame, CASE WHEN id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND (id + frame) % 19 <> 0 THEN CASE (id + frame) % 7 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1 WHEN 6 THEN 0.875 END END AS p FROM f)
  SELECT id, frame, p, count(p) OVER (PARTITION BY id) = 0 AS failed FROM p""")  # fmt: skip
def judge_answers(spark, sf):
    """Answers of the wire: numbers from 0 to 1 count, strings, booleans and other kinds don't; an answer may be partial."""
    made = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_BODY).alias("body"))
    return judging.answers(made, 3)


@query("judge_requests", """SELECT doc_id, sha256('{"model":"m","state":{"text":"item ' || doc_id || '"},"questions":{"q0":{"type":"noul","instructions":"a' || lang || '"},"q1":{"type":"noul","instructions":"b"}}}') AS body_sha256 FROM documents""")
def judge_requests(spark, sf):
    state = F.concat(F.lit("item "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(judging.request_body("m", state, F.array(F.concat(F.lit("a"), "lang"), F.lit("b"))), 256).alias("body_sha256"))


_RAW = "CASE WHEN event_id % 29 = 0 THEN -0.5 WHEN event_id % 31 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 37 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 41 = 0 THEN NULL ELSE value / 1000 END"


@query("valid_probabilities", f"SELECT event_id, CASE WHEN isfinite(p) AND p BETWEEN 0 AND 1 THEN round(p, 9) END AS p FROM (SELECT event_id, {_RAW} AS p FROM events)")
def valid_probabilities(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(valid_probability(F.expr(_RAW)), 9).alias("p"))


@query("refused_batches", f"WITH b AS (SELECT event_id, event_id // 10 AS batch_id, {_RAW} AS p FROM events) SELECT event_id FROM b WHERE batch_id NOT IN (SELECT batch_id FROM b WHERE p IS NULL OR NOT isfinite(p) OR p NOT BETWEEN 0 AND 1)")
def refused_batches(spark, sf):
    """One bad probability refuses its whole batch."""
    rows = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("batch_id"), F.expr(_RAW).alias("p"))
    return judging.refused(rows).select("event_id")


_STATUS = "CASE WHEN event_id % 97 = 5 THEN 'unauthorized' WHEN event_id % 89 = 7 THEN 'budget' WHEN user_id % 3 = 0 AND event_id % 13 <> 0 THEN 'unreachable' WHEN user_id % 3 = 1 AND event_id % 17 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'refused' ELSE 'unreachable' END ELSE 'answered' END"


@query("pass_outcomes", f"""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_STATUS} AS s FROM events),
  k AS (SELECT a.user_id, a.n, a.s, count(*) FILTER (b.s IN ('refused', 'unreachable')) AS bad, count(*) FILTER (b.s = 'unreachable') AS away FROM r a JOIN r b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 9 AND a.n GROUP BY ALL),
  e AS (SELECT user_id, n, CASE WHEN s = 'unauthorized' THEN 'keyRejected' WHEN s = 'budget' THEN 'dailyLimit' WHEN bad = 10 AND away = 10 THEN 'offline' WHEN bad = 10 THEN 'stopped' END AS o FROM k)
  SELECT user_id AS pass_id, coalesce(arg_min(o, n) FILTER (o IS NOT NULL), 'completed') AS outcome, coalesce(min(n) FILTER (o IS NOT NULL), max(n)) AS used FROM e GROUP BY user_id""")  # fmt: skip
def pass_outcomes(spark, sf):
    """How each pass ended, and after how many requests."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("pass_id"), place.alias("position"), F.expr(_STATUS).alias("status"))
    return judging.outcomes(rows)


_KIND = "CASE WHEN length(text) < 30 THEN 'heading' WHEN idx % 9 = 4 THEN 'code' WHEN idx % 2 = 0 THEN 'paragraph' ELSE 'quote' END"


@query("prejudge", f"""{BASE}, r AS (SELECT id FROM banded WHERE pin_id = 0 AND band = 2 ORDER BY round(shown * 20) DESC, sort_date DESC, id DESC LIMIT 3), {PASSAGE_SQL},
  k AS (SELECT item_id, idx, row_number() OVER (PARTITION BY item_id ORDER BY idx) AS n FROM (SELECT *, {_KIND} AS kind FROM passage) WHERE kind IN ('paragraph', 'quote', 'listItem') AND item_id IN (SELECT id FROM r))
  SELECT item_id, idx FROM k WHERE n <= 40""")  # fmt: skip
def prejudge(spark, sf):
    """The first 40 judgeable passages of the three best rows of a search."""
    found = rank.ranked(_banded(spark, sf, (ASKED,))).where("band = 2")
    return judging.prejudged(found.select("id", "position"), passages(spark, sf).withColumn("kind", F.expr(_KIND))).select("item_id", "idx")


@query("pin_pass", BASE_ALL + """, want AS (SELECT DISTINCT text_hash, frame_hash FROM judged WHERE id % 4 = 1), known AS (SELECT DISTINCT text_hash, frame_hash FROM judged WHERE id % 3 = 0 AND pin_id < 3)
  SELECT text_hash, count(*) AS frames FROM want w WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.text_hash = w.text_hash AND k.frame_hash = w.frame_hash) GROUP BY text_hash""")  # fmt: skip
def pin_pass(spark, sf):
    """Changed items against all pins: one request a text, with the frames that the cache doesn't answer."""
    every = lambda spark, sf: rank.pairs(live_items(spark, sf).withColumn("text_hash", item_text_hash()), rank.framed(spark, SENTENCES))
    changed = live_items(spark, sf).where("id % 4 = 1").withColumn("text_hash", item_text_hash())
    return judging.pin_pass(changed, rank.framed(spark, SENTENCES), cached(spark, sf, every), MODEL).select("text_hash", F.size("frames").cast("long").alias("frames"))


@query("matched_by_title", f"""{BASE}, opened AS ({READER} SELECT item_id, found FROM article), hit AS (SELECT DISTINCT id FROM banded WHERE pin_id = 0 AND band = 2)
  SELECT a.item_id, h.id IS NOT NULL AND found = 0 AS by_title FROM opened a LEFT JOIN hit h ON h.id = a.item_id""")  # fmt: skip
def matched_by_title(spark, sf):
    """Articles whose row was found on its title while nothing inside was."""
    rows = _banded(spark, sf, (ASKED,))
    judged = _leveled(spark, sf).where("level IS NULL").withColumn("p", F.when(F.col("idx") % 7 != 3, overlap_judge(F.col("text"), F.lit(ASKED))))
    return judging.matched_by_title(reader.saturation(judged).select("item_id", "found"), rows)


@query("find_by_meaning", f"WITH {PASSAGE_SQL}, {sentence_sql()} SELECT item_id, idx FROM passage, pin WHERE pin_id = 2 AND list_has_any(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3), ['pour']) AND len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)), ['pour', 'dans', 'avec'])) >= 2")
def find_by_meaning(spark, sf):
    """Passages that a sentence typed in the article finds (here with "pour" and one more of its words), beside the carried one."""
    rows = rank.pairs(passages(spark, sf), rank.framed(spark, SENTENCES)).where("pin_id = 2")
    return rows.withColumn("p", overlap_judge(F.col("text"), F.col("sentence"))).where((F.col("p") >= 0.9) & F.array_contains(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "pour")).select("item_id", "idx")


_JITTER = f"({fnv_sql(chr(39).join(['title || chr(31) || ', ASKED, '']))} % 1000)::DOUBLE / 1000"
_WORDS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {i}), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END))"


@query("stem_judge", f"""WITH {ITEM_SQL}, w AS (SELECT id, {_JITTER} AS j, {_WORDS.format(t=repr(ASKED), i=repr(judging.IGNORED))} AS want, {_WORDS.format(t='title', i=repr(judging.IGNORED))} AS have FROM item),
  s AS (SELECT id, j, len(list_filter(want, lambda a: len(list_filter(have, lambda b: a = b OR (length(a) > 4 AND length(b) > 4 AND (starts_with(a, b) OR starts_with(b, a))))) > 0)) / len(want) AS share FROM w)
  SELECT id, round(CASE WHEN share > 0 THEN least(0.05::DOUBLE + 0.9::DOUBLE * pow(share, 1.6) + (j - 0.5) * 0.06::DOUBLE, 0.98::DOUBLE) ELSE 0.02::DOUBLE + j * 0.12::DOUBLE END, 6) AS p FROM s""")  # fmt: skip
def stem_judge(spark, sf):
    """The judge of stems, with a jitter that is the same on every run."""
    rows = items(spark, sf).select("id", "title", F.concat("title", F.lit("\x1f" + ASKED)).alias("key")).withColumn("hash", bodies.fnv1a("key"))
    jitter = (F.col("hash") % 1000).cast("double") / 1000
    return rows.select("id", F.round(judging.stem_judge(F.col("title"), F.lit(ASKED), jitter), 6).alias("p"))


@query("list_window_counts", f"{BASE} SELECT pin_id, count(*) AS n, count(*) FILTER (id % 3 = 0) AS checked, count(*) FILTER (id % 3 <> 0) AS unchecked FROM pair WHERE pin_id < 3 GROUP BY pin_id")
def list_window_counts(spark, sf):
    """Checked and unchecked rows of each list's window."""
    rows = rank.with_answers(_pairs(spark, sf).where("pin_id < 3"), cached(spark, sf).where(F.col("model") == MODEL).dropDuplicates(["text_hash", "frame_hash"]), MODEL)
    checked = F.col("id") % 3 == 0
    rows = rows.where(~checked | F.col("p").isNotNull())
    return rows.groupBy("pin_id").agg(F.count("*").alias("n"), F.count_if(checked).alias("checked"), F.count_if(~checked).alias("unchecked"))


@query("first_wins", "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def first_wins(spark, sf):
    """A dictionary whose first entry of a key stays."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))


@query("section_confusion", f"""WITH {PASSAGE_SQL} SELECT item_id, count(*) FILTER (i AND f) AS inside_found, count(*) FILTER (i AND NOT f) AS inside_missed, count(*) FILTER (NOT i AND f) AS outside_found, count(*) FILTER (NOT i AND NOT f) AS outside_left
  FROM (SELECT item_id, idx BETWEEN 2 AND 6 AS i, length(text) > 80 AS f FROM passage) GROUP BY item_id""")  # fmt: skip
def section_confusion(spark, sf):
    """Found and missed passages inside and outside the section that holds the answer."""
    i, f = F.col("idx").between(2, 6), F.length("text") > 80
    return passages(spark, sf).groupBy("item_id").agg(F.count_if(i & f).alias("inside_found"), F.count_if(i & ~f).alias("inside_missed"), F.count_if(~i & f).alias("outside_found"), F.count_if(~i & ~f).alias("outside_left"))


@query("mark_pin_read", f"{BASE} SELECT DISTINCT id FROM banded WHERE pin_id = 2 AND band = 2 AND NOT read")
def mark_pin_read(spark, sf):
    """Marking a pin's list read names the rows that change."""
    listed = rank.pin_lists(_banded(spark, sf).where("pin_id = 2").withColumn("viewed", F.lit(None).cast("timestamp_ntz"))).select("id").distinct()
    return live_items(spark, sf).where("NOT read").join(listed, "id", "left_semi").select("id")


@query("passages_json", f"WITH {PASSAGE_SQL} SELECT item_id, idx, text FROM passage")
def passages_json(spark, sf):
    """Passages as an article's JSON and back."""
    packed = passages(spark, sf).groupBy("item_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("idx", "text")))).alias("json"))
    back = packed.select("item_id", F.explode(F.from_json("json", "array<struct<idx: long, text: string>>")).alias("p"))
    return back.select("item_id", "p.idx", "p.text")


@query("list_limits", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2000 WHEN doc_id % 2 = 0 THEN greatest(2000, 300 + 1200 * (doc_id % 5)) ELSE 300 + 1200 * (doc_id % 5) END::BIGINT AS rows, doc_id % 4 = 1 AND doc_id % 5 <> 0 AS judges FROM documents")
def list_limits(spark, sf):
    k = F.col("doc_id")
    limit = messages.load_limit(k % 3 != 0, k % 2 == 0, k % 5)
    return table(spark, sf, "documents").select("doc_id", limit.cast("long").alias("rows"), messages.judges(k % 4 != 1, k % 5 != 0).alias("judges"))


def _comma(n: str) -> str:
    return f"format('{{:,}}', ({n})::BIGINT)"


def _plural(n: str, noun: str) -> str:
    return f"{_comma(n)} || CASE WHEN {n} = 1 THEN ' {noun}' ELSE ' {noun}s' END"


_RUN = """SELECT event_id, event_id % 41 <> 0 AS sources, event_id % 3 <> 0 AS ranked, CASE event_id % 37 WHEN 1 THEN 'missing' WHEN 2 THEN 'rejected' WHEN 3 THEN 'storageError' ELSE 'valid' END AS key,
  CASE event_id % 23 WHEN 1 THEN 'dailyLimit' WHEN 2 THEN 'offline' WHEN 3 THEN 'stopped' WHEN 4 THEN 'completed' END AS outcome, event_id % 7 = 0 AS running, event_id % 2 = 0 AS progress, CASE WHEN event_id % 19 = 4 THEN 1 + event_id % 5 * 700 ELSE 0 END AS unchecked,
  event_id % 301 AS checked, CASE WHEN event_id % 5 = 0 THEN 1500 ELSE 300 END AS win, event_id % 2500 AS loaded, event_id % 2500 + event_id % 4 * 900 AS total, CASE WHEN event_id % 29 = 0 THEN event_type END AS error,
  CASE WHEN event_id % 6 < 2 THEN 'Site ' || user_id END AS title, event_id % 31 = 0 AS odd, event_id % 2 = 1 AS flag, user_id % 4 AS found, user_id % 3 AS unsure, user_id % 60 AS judgeable FROM events"""
_KEY = "WHEN 'missing' THEN 'Add a key to search.' WHEN 'rejected' THEN 'The key was rejected.' ELSE 'Couldn''t access the key.' END"
_END = "WHEN 'dailyLimit' THEN 'Daily limit reached. Resets at midnight.' WHEN 'offline' THEN 'Offline. Showing what was already checked.' ELSE 'Stopped after repeated errors.' END"


def _runs(spark, sf):
    """The rows of _RUN."""
    return spark.sql(_RUN.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query("list_feet", f"""WITH r AS ({_RUN}) SELECT event_id, CASE WHEN NOT sources THEN '' WHEN ranked AND key <> 'valid' THEN CASE key {_KEY} WHEN ranked AND outcome IN ('dailyLimit', 'offline', 'stopped') THEN CASE outcome {_END}
  WHEN ranked AND NOT running AND unchecked > 0 THEN {_comma('unchecked')} || ' not checked.' WHEN error IS NOT NULL THEN 'Couldn''t refresh: ' || error || '.' WHEN NOT ranked THEN {_plural('loaded', 'item')} || coalesce(' in ' || title, '')
  WHEN odd THEN 'Exclusions, amounts and dates aren''t judged.' WHEN running AND progress THEN {_comma('checked')} || ' of ' || {_comma('least(win, loaded)')} || ' checked' WHEN running THEN 'Checking ' || {_plural('least(win, loaded)', 'item')}
  WHEN least(win, loaded) < total THEN 'Newest ' || {_comma('least(win, loaded)')} || ' of ' || {_comma('total')} || ' checked. Check ' || {_comma('least(1200, total - least(win, loaded))')} || ' older' ELSE {_plural('checked', 'item')} || ' checked' END AS foot,
  CASE WHEN NOT sources THEN 'No sources yet.' WHEN flag AND loaded = 0 THEN 'Getting your sources' WHEN NOT ranked THEN CASE WHEN loaded = 0 THEN 'No items yet.' END
  WHEN NOT running AND NOT odd AND coalesce(outcome, 'completed') = 'completed' THEN 'Nothing found in ' || {_plural('checked', 'item')} || ' checked' END AS empty FROM r""")  # fmt: skip
def list_feet(spark, sf):
    """The line under a list and the line of an empty one."""
    c = F.col
    sources = c("sources").cast("int")
    foot = messages.list_foot(sources, c("ranked"), c("key"), c("outcome"), c("running"), c("progress"), c("unchecked"), c("checked"), c("win"), c("loaded"), c("total"), c("error"), c("title"), c("odd"))
    empty = messages.empty_line(sources, c("flag"), c("loaded"), c("ranked"), c("running"), ~c("odd"), c("outcome"), c("checked"))
    return _runs(spark, sf).select("event_id", foot.alias("foot"), empty.alias("empty"))


_SAID = f"CASE WHEN found + unsure = 0 THEN CASE WHEN odd THEN 'Matched by title. ' ELSE '' END || 'Nothing found in ' || {_plural('n', 'paragraph')} || ' checked' ELSE concat_ws(', ', CASE WHEN found > 0 THEN found || ' found' END, CASE WHEN unsure > 0 THEN unsure || ' unsure' END) END"


@query("reader_feet", f"""WITH r AS (SELECT *, CASE WHEN event_id % 8 = 0 THEN least(checked, judgeable) ELSE judgeable END AS n FROM ({_RUN})) SELECT event_id, CASE WHEN NOT sources OR judgeable = 0 THEN CASE WHEN ranked AND judgeable = 0 THEN 'Code not checked.' ELSE '' END
  WHEN running AND flag THEN 'Checking' WHEN running AND unchecked = 0 THEN 'Checking ' || {_plural('judgeable', 'paragraph')} WHEN running THEN {_comma('n')} || ' of ' || {_comma('judgeable')} || ' checked' WHEN key <> 'valid' THEN CASE key {_KEY}
  WHEN outcome IN ('dailyLimit', 'offline', 'stopped') THEN CASE outcome {_END} WHEN n < judgeable THEN {_comma('n')} || ' of ' || {_comma('judgeable')} || ' checked.' WHEN error IS NOT NULL THEN 'Most of this article is about this.'
  WHEN found + unsure = 0 AND flag THEN 'Nothing found in ' || {_comma('n')} || ' checked' WHEN ranked THEN {_SAID} || '. Code not checked.' ELSE {_SAID} END AS foot FROM r""")  # fmt: skip
def reader_feet(spark, sf):
    """The line under an article."""
    c = F.col
    rows = _runs(spark, sf).withColumn("n", F.when(c("event_id") % 8 == 0, F.least("checked", "judgeable")).otherwise(c("judgeable")))
    foot = messages.reader_foot(c("sources"), c("judgeable"), c("ranked"), c("running"), c("flag"), c("unchecked"), c("key"), c("outcome"), c("n"), c("found"), c("unsure"), c("error").isNotNull(), c("odd"))
    return rows.select("event_id", foot.alias("foot"))




@query("judge_loop", f"""{BASE}, have AS (SELECT DISTINCT text_hash, frame_hash FROM judged WHERE id % 3 = 0 AND pin_id < 3), want AS (SELECT DISTINCT text_hash, frame_hash, p FROM judged)
  SELECT w.text_hash, w.frame_hash, round(p, 9) AS p, CASE WHEN h.text_hash IS NOT NULL THEN 0 WHEN substr(w.text_hash, 1, 1) < '5' THEN 2 ELSE 1 END::BIGINT AS run FROM want w LEFT JOIN have h USING (text_hash, frame_hash)""")  # fmt: skip
def judge_loop(spark, sf):
    """A judge that fails on three texts in ten the first time it is asked: two passes fill the cache, each asks only what is missing."""
    root = folder(spark, "judgments")
    known = cached(spark, sf).where(F.col("model") == MODEL)
    known.select("text_hash", "frame_hash", "model", "p").write.parquet(f"{root}/run=0")
    place = F.row_number().over(Window.orderBy(F.col("sort_date").desc(), F.col("id").desc()))  # a window's rows
    pairs = written(_pairs(spark, sf).select("text_hash", rank.judged_text().alias("state"), place.cast("long").alias("position"), "frame_hash", F.col("sentence").alias("frame")), "pairs")

    def judge(fails):
        def asked(requests):
            ps = F.transform("frames", lambda f: overlap_judge(F.col("state"), f))
            return requests.select("text_hash", "position", F.when(fails, "unreachable").otherwise("answered").alias("status"), ps.alias("ps"))

        return asked

    out = cache_of = judging.cache(spark, f"{root}/run=0").withColumn("run", F.lit(0))
    for run, fails in ((1, F.substring("text_hash", 1, 1) < "5"), (2, F.lit(False))):
        here = f"{root}/run={run}"
        cache_of.select("text_hash", "frame_hash", "model", "p").write.parquet(here)
        judging.judge_pass(pairs, here, judge(fails), MODEL, wave=128)
        fresh = judging.cache(spark, here).join(out.select("text_hash", "frame_hash"), ["text_hash", "frame_hash"], "left_anti").withColumn("run", F.lit(run))
        out = cache_of = written(out.unionByName(fresh), "answered")
    return out.select("text_hash", "frame_hash", F.round("p", 9).alias("p"), F.col("run").cast("long").alias("run"))
