import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from semrank.llm import queries
from semrank.llm.decontamination import Decontamination, contamination, remove_documents, remove_spans
from semrank.llm.line_dedup import deduplicate_lines
from semrank.llm.url_reputation import Reputation, judge_urls, posteriors


def brute_lines(rows):
    lines = {i: (t or "").split("\n") if t is not None else [] for i, t in rows}
    full = {i: [k for k, x in enumerate(v) if x.strip(" \t\n\x0b\f\r")] for i, v in lines.items()}
    first, out = {}, {}
    for i in sorted(k for k in lines if k is not None):
        for j in range(len(full[i]) - 2):
            first.setdefault(tuple(lines[i][k] for k in full[i][j : j + 3]), (i, j))
    for i, v in lines.items():
        gone = set()
        for j in range(len(full[i]) - 2):
            if i is not None and first[tuple(v[k] for k in full[i][j : j + 3])] < (i, j):
                gone.update(full[i][j : j + 3])
        text = None if dict(rows)[i] is None else "\n".join(x for k, x in enumerate(v) if k not in gone)
        out[i] = (len(v), len(gone), text)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a\na\na\na\na\na"), (503, "line 1\nline 2"), (504, "é\nü\nß\n"), (505, "é\nü\nß"), (None, "é\nü\nß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in deduplicate_lines(docs).collect()}
    assert got == brute_lines(rows)
    assert deduplicate_lines(docs.limit(0)).count() == 0
    twice = deduplicate_lines(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in twice.collect()) == [(1, 0), (1, 0), (2, 3)]


def test_lines_of_several_texts_of_one_doc_id(spark):
    """Each text is cut by its own windows; of texts that share one, one keeps it."""
    rows = [(1, "a\nb\nc"), (2, "z1\nz2\nz3\nz4\nz5\na\nb\nc"), (2, "q\nr"), (2, "q\nr"), (2, None), (2, "m\nn\no\nx"), (2, "m\nn\no\ny")]
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    out = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_left, r.text) for r in got if r.text not in ("x", "y", "m\nn\no\nx", "m\nn\no\ny") and r.text is not None)
    assert out == [(1, 3, 0, 3, "a\nb\nc"), (2, 2, 0, 2, "q\nr"), (2, 2, 0, 2, "q\nr"), (2, 8, 3, 5, "z1\nz2\nz3\nz4\nz5")]
    assert sorted(r.text for r in got if r.text and r.text[-1] in "xy") in (["m\nn\no\nx", "y"], ["m\nn\no\ny", "x"])
    assert [(r.n_lines, r.n_removed) for r in got if r.text is None] == [(0, 0)]


def words(t):
    out, now = [], ""
    for c in (t or "") + " ":
        if ord(c) > 127 or (c.isascii() and c.isalnum()):
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out


def brute_hits(docs, items, k):
    out = {}
    bench = {i: words(t) for i, t in items}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, b in bench.items():
            n = min(k, len(b))
            for a in range(len(b) - n + 1) if n else ():
                for x in range(len(w) - n + 1):
                    if w[x : x + n] == b[a : a + n]:
                        hit.update(range(x, x + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def leaks():
    rng = random.Random(4)
    pool = ["The", "of", "É", "é", "x1", "end", "a", "Straße"] + [f"w{i}" for i in range(30)]
    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((25, 12, 10, 9, 4, 1, 40, 11))] + [(20, None), (21, ""), (22, "..."), (23, "The"), (24, text(10))]
    items.append((25, items[0][1][:90]))
    docs = []
    for i in range(70):
        t = rng.choice([x for _, x in items if x])
        docs.append((i, text(rng.randrange(0, 60)) + (t.lower() if rng.random() < 0.5 and t.isascii() else t if rng.random() < 0.6 else "") + text(rng.randrange(0, 40))))
    return docs + [(200, None), (201, ""), (202, " !")], items


@pytest.mark.parametrize("most", [200_000, 0])
def test_hits_equal_brute_force(spark, most):
    docs, items = leaks()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b, Decontamination(max_windows=most)).collect()}
    want = brute_hits(docs, items, 10)
    assert got == want
    assert any(x[4] for x in want.values()) and not all(x[4] for x in want.values())
    if most:
        kept = {r.doc_id for r in remove_documents(d, b).collect()}
        assert kept == {i for i, x in want.items() if not x[4]}
        spans = {r.doc_id: r.text for r in remove_spans(d, b).collect()}
        assert all(len(spans[i].split()) == x[0] - x[1] for i, x in want.items())


def test_hits_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, none).collect()}
    assert got == {(1, 2, 0, 0, False), (2, 0, 0, 0, False)}
    assert contamination(docs.limit(0), none).count() == 0


URLS = [
    (1, "http://A.example.com/en/1?x=/net"), (2, "https://www.example.com/en/"), (3, "https://example.com/de"), (4, "http://x.net/es/1#a"), (5, "http://net/fr/"),
    (6, "http://x.net/en"), (7, None), (8, "no scheme"), (9, "http://"), (10, "a://b://c.com/d"), (11, "http://WWW.EXAMPLE.COM/en"), (12, "http://com/"), (13, "http://É.org?q=http://x.com/"),
    (14, "http://m.www.example.com/en/x"), (15, "ftp://notcom/"), (16, "http://x.com"),
]


def test_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, none, Reputation(rules=queries.RULES)).collect()}
    assert got == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("example.com", "/de", "com/", "allow"),
        4: ("x.net", "/es/1", "net/es/", "block"), 5: ("net", "/fr/", "net/fr/", "block"), 6: ("x.net", "/en", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("b:", "//c.com/d", None, "allow"), 11: ("www.example.com", "/en", "com/", "allow"), 12: ("com", "/", "com/", "allow"), 13: ("É.org", "", None, "allow"),
        14: ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"), 15: ("notcom", "/", None, "allow"), 16: ("x.com", "", None, "allow"),
    }


def test_reputation_shrinks_and_blocks(spark):
    counts = [("bad.a.org", 40, 38), ("few.a.org", 1, 1), ("b.org", 200, 10), ("c.com", 300, 12), ("none.com", 0, 0), ("x.co.uk", 50, 5), ("", 3, 0), ("new.b.org", 1, 1), ("one.d.com", 1, 1)]
    got = {r.host: r for r in posteriors(spark.createDataFrame(counts, "host string, n long, bad long")).collect()}
    assert got["bad.a.org"].bound > 0.5 and 0 < got["none.com"].posterior_mean < 0.2
    # A host with one bad page follows its domain: 39 of 41 pages of a.org are bad, 11 of 201 of b.org, and d.com has no other.
    assert got["few.a.org"].bound > 0.5 and got["new.b.org"].bound < 0.5 and got["one.d.com"].bound < 0.5
    assert all(0 <= r.posterior_mean <= 1 and r.bound <= r.posterior_mean for r in got.values())
    pages = spark.createDataFrame([(i, f"http://bad.a.org/{i}") for i in range(40)] + [(100 + i, f"http://c.com/{i}") for i in range(300)] + [(999, "http://bad.a.org/new")], "page_id long, url string")
    marks = spark.createDataFrame([(i, i > 1) for i in range(40)] + [(100 + i, i < 12) for i in range(300)] + [(5, False), (None, True)], "page_id long, bad boolean")
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, marks).collect()}
    assert verdicts[999] == "block" and verdicts[5] == "block" and verdicts[150] == "allow"


def test_one_label_blocks_no_host(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (2, None), (3, "http://b.net/")], "page_id long, url string")
    marks = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    assert {r.verdict for r in judge_urls(pages, marks).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), marks).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key(r) for r in want.select(*columns).fetchall())) == sorted(key(r) for r in got.select(*columns).collect())
