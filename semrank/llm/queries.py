"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semrank.llm import decontamination, embedding_dedup, langid, line_dedup, merkle, minhash, packing, resampling, sharding, substring_dedup, token_count, toxicity, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(3) != 1))
    return langid.predict(docs, model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(_table(spark, sf_dir, "documents"), token_count.Counting(tokenizer("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.greatest(F.col("toxic") == 1, F.col("quality") == 0)
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, url_reputation.Reputation(rules=RULES))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hit_words")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(_fold(7) == 0, F.col("n_chars") + 1)
    found = merkle.manifest(_table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", sharding.size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_url_reputation": op7_url_reputation,
        "op8_decontamination": op8_decontamination,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_sharding": op13_sharding,
    }


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

_OP4 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]')
), w AS (
  SELECT doc_id, p, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS k, lead(p, 2) OVER d AS last FROM f
  WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), c AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w WHERE last IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM f JOIN c ON c.doc_id = f.doc_id AND f.p BETWEEN c.p AND c.p + 2
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS t, count(*) AS n, count(g.i) AS r
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_OP7 = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), mark AS (
  SELECT doc_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY doc_id
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(host, ':[0-9]*$', '') AS bare
  FROM u LEFT JOIN mark ON doc_id = page_id GROUP BY host
), h1 AS (
  SELECT *, string_split(bare, '.') AS parts, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM h0
), h2 AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare
    WHEN two IN ('ac.uk','co.in','co.jp','co.nz','co.uk','co.za','com.au','com.br','gov.uk','net.au','org.au','org.uk') THEN two ELSE parts[-1] END AS suffix FROM h1
), h AS (
  SELECT host, n, bad, suffix, CASE WHEN bare = suffix THEN bare WHEN contains(suffix, '.') THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM h2
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), t AS (
  SELECT n, (bad + 2.0) / (n + 20.0) AS m, (bad + 2.0) / (n + 20.0) * (1 - (bad + 2.0) / (n + 20.0)) / (n + 21.0) AS v
  FROM (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s)
), s1 AS (SELECT s.*, t.m AS pm, t.v AS pv FROM s, t
), ks AS (SELECT CASE WHEN g = 0 OR nn = g THEN 10.0 WHEN q <= g THEN 10000.0 ELSE least(10000.0, greatest(1.0, (nn - g) / (q - g) - 1)) END AS k
  FROM (SELECT count(*) AS g, coalesce(sum(n), 0) AS nn, sum(n * pow(bad / n - pm, 2) / (pm * (1 - pm))) AS q FROM s1 WHERE n > 0)
), s2 AS (SELECT suffix, m, m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv AS v FROM (SELECT *, (bad + k * pm) / (n + k) AS m FROM s1, ks)
), d1 AS (SELECT d.*, s2.m AS pm, s2.v AS pv FROM d JOIN s2 USING (suffix)
), kd AS (SELECT CASE WHEN g = 0 OR nn = g THEN 10.0 WHEN q <= g THEN 10000.0 ELSE least(10000.0, greatest(1.0, (nn - g) / (q - g) - 1)) END AS k
  FROM (SELECT count(*) AS g, coalesce(sum(n), 0) AS nn, sum(n * pow(bad / n - pm, 2) / (pm * (1 - pm))) AS q FROM d1 WHERE n > 0)
), d2 AS (SELECT suffix, domain, m, m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv AS v FROM (SELECT *, (bad + k * pm) / (n + k) AS m FROM d1, kd)
), h1x AS (SELECT h.*, d2.m AS pm, d2.v AS pv FROM h JOIN d2 USING (suffix, domain)
), kh AS (SELECT CASE WHEN g = 0 OR nn = g THEN 10.0 WHEN q <= g THEN 10000.0 ELSE least(10000.0, greatest(1.0, (nn - g) / (q - g) - 1)) END AS k
  FROM (SELECT count(*) AS g, coalesce(sum(n), 0) AS nn, sum(n * pow(bad / n - pm, 2) / (pm * (1 - pm))) AS q FROM h1x WHERE n > 0)
), b AS (
  SELECT host FROM (SELECT host, m, m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv AS v FROM (SELECT *, (bad + k * pm) / (n + k) AS m FROM h1x, kh))
  WHERE m - 1.645 * sqrt(v) > 0.5
), v AS (
  SELECT page_id, u.host, path, b.host IS NOT NULL AS blocked, CASE
    WHEN (u.host = 'www.example.com' OR suffix(u.host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (u.host = 'example.com' OR suffix(u.host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (u.host = 'net' OR suffix(u.host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (u.host = 'net' OR suffix(u.host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (u.host = 'com' OR suffix(u.host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u LEFT JOIN b USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict FROM v
"""

_OP8 = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM b))
), h AS (SELECT doc_id, d.n, s, item_id FROM d JOIN b ON d.n = b.n AND d.k = b.k
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP9 = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), k AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13)
), f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k
), g AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT k.doc_id, unnest(range(s, s + 13)) AS p FROM k JOIN f ON k.k = f.k WHERE f.first < k.doc_id) GROUP BY doc_id
), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w
), x AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM g
), t AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) FILTER (x.p IS NULL) AS kept FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_OP11 = """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), f AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f1, coalesce(strlen(source) || ':' || source, '-') AS f2, coalesce(strlen(lang) || ':' || lang, '-') AS f3,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f4, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS f4b, coalesce(strlen(text) || ':' || text, '-') AS f5,
         xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295)) % 7 = 0 AS tampered FROM documents, tab
), leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(f1 || f2 || f3 || f4 || f5) AS leaf, CASE WHEN tampered THEN sha256(f1 || f2 || f3 || f4b || f5) ELSE sha256(f1 || f2 || f3 || f4 || f5) END AS given,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(f1 || f2 || f3 || f4 || f5)) - 1 AS pos FROM f
), tree AS (
  SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaf
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY grp, level, pos // 2
), sub AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2
), depth AS (SELECT grp, max(level) AS depth FROM tree GROUP BY grp
), step AS (
  SELECT grp, level, pos, CASE WHEN pos % 2 = 1 THEN lag(h) OVER w END AS before, CASE WHEN pos % 2 = 0 AND lead(pos) OVER w = pos + 1 THEN lead(h) OVER w END AS after FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY grp, level ORDER BY pos)
), tstep AS (
  SELECT level, pos, CASE WHEN pos % 2 = 1 THEN lag(h) OVER w END AS before, CASE WHEN pos % 2 = 0 AND lead(pos) OVER w = pos + 1 THEN lead(h) OVER w END AS after FROM top WHERE n > 1 WINDOW w AS (PARTITION BY level ORDER BY pos)
), path AS (
  SELECT grp, leaf.pos AS leaf, level, before, after FROM leaf JOIN depth USING (grp) JOIN step s USING (grp) WHERE s.pos = leaf.pos >> s.level
  UNION ALL
  SELECT grp, leaf.pos, depth + s.level, before, after FROM leaf JOIN depth USING (grp) JOIN sub USING (grp), tstep s WHERE s.pos = sub.pos >> s.level
), proof AS (SELECT grp, leaf AS pos, list(struct_pack(b := coalesce(before, ''), a := coalesce(after, '')) ORDER BY level) AS p FROM path GROUP BY ALL
), folded AS (
  SELECT grp, pos, coalesce(p, []) AS p, leaf, given, doc_id, list_reduce([struct_pack(b := given, a := '')] || coalesce(p, []), lambda x, y: struct_pack(b := sha256(y.b || x.b || y.a), a := '')).b AS folded_root
  FROM leaf LEFT JOIN proof USING (grp, pos)
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(coalesce(list_aggregate(list_transform(p, lambda x: x.b || x.a), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM folded JOIN sub USING (grp), top r WHERE r.n = 1
"""

_OP12 = """
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), f AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM docs
), items AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark
), tf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM items
), tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT gram FROM f UNION SELECT gram FROM tf)
), bucket AS (
  SELECT gram, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS bucket FROM hexed, tab
), d AS (SELECT doc_id, bucket, count(*) AS n FROM f JOIN bucket USING (gram) GROUP BY ALL
), s AS (SELECT bucket, sum(n) AS s FROM d GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM tf JOIN bucket USING (gram) GROUP BY bucket
), total AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS all_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS all_t
), g AS (
  SELECT bucket, floor(1000::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total
), m AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM d JOIN g USING (bucket) GROUP BY doc_id
), x AS (
  SELECT docs.doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(floor((gain - ((gain % n) + n) % n) / n), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || docs.doc_id), 1, 8))::BIGINT AS h FROM docs LEFT JOIN m USING (doc_id)
), y AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x
), z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM y WHERE words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= able * 25 // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Operators 2, 3, 5, 6, 10 and 13 can't be written in SQL; tests hold them against brute force or held-out labels."""
    return {
        "op1_embedding_near_dedup": _OP1,
        "op4_line_dedup": _OP4,
        "op7_url_reputation": _OP7,
        "op8_decontamination": _OP8,
        "op9_substring_dedup": _OP9,
        "op11_merkle_manifest": _OP11,
        "op12_importance_resampling": _OP12,
    }
