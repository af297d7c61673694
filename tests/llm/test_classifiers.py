"""Toxicity and language: accuracy on rows that were not learned from, and odd inputs."""

import numpy as np

from semrank.llm import langid, toxicity
from semrank.llm.queries import op2_toxicity, op3_language_id

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    """At sf0.1: smaller tables hold out only a handful of toxic documents."""
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic")
    rows = op2_toxicity(spark, LARGE).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert toxic and clean
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print("toxicity", auc, right, len(rows))
    assert auc >= 0.95 and right >= 0.95


def test_held_out_languages(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = op3_language_id(spark, SF).join(langs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    right = sum(r.lang_pred == r.lang for r in rows) / len(rows)
    print("language", right, len(rows))
    assert right >= 0.95


def test_odd_texts(spark):
    made = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (None, "words", "de"), (5, "x " * 100_000, None)], "doc_id long, text string, lang string")
    none = toxicity.train(made, spark.createDataFrame([], "doc_id long, label int"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(made, none).collect())
    got = {r.doc_id: r.lang_pred for r in langid.predict(made, langid.train(made)).collect()}
    assert got[1] == got[2] == got[3] == "und"
    empty = langid.train(made.limit(0))
    assert {r.lang_pred for r in langid.predict(made, empty).collect()} == {"und"}
    assert toxicity.score(made.limit(0), none).count() == 0


def test_toxicity_equals_dense_newton(spark):
    """Counts, ratios and the optimum of the regression against loops and dense matrices."""
    rng = np.random.default_rng(2)
    words = [f"w{k}{'abcdefgh'[k % 8]}" for k in range(30)] + ["vile", "rotten", "nasty"]
    rows = []
    for i in range(60):
        toxic = i % 3 == 0
        text = list(rng.choice(words[:30], 8)) + (list(rng.choice(words[30:], 2)) if toxic else []) + (["vile"] if i == 7 else [])
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t, f"x{i}") for i, t, _ in rows] + [(3, rows[3][1], "again"), (900, "vile words", None), (901, "", None)], "doc_id long, text string, label string")
    p = toxicity.Toxicity(buckets=1 << 18, least_documents=1, least_ratio=0.3, l2=0.02, steps=4000)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"), p)

    def counts(text):
        out = {}
        for w in set(text.lower().split()):
            marked = "\x02" + w + "\x03"
            for g in {marked[a : a + n] for n in p.orders for a in range(len(marked) - n + 1)}:
                out[g] = out.get(g, 0) + 1
        return out

    bags, y = [counts(t) for _, t, _ in rows], np.array([z for _, _, z in rows], dtype=float)
    share = y.mean()
    ratio = {}
    for g in {g for b in bags for g in b}:
        n1, n0 = sum(g in b for b, z in zip(bags, y, strict=True) if z), sum(g in b for b, z in zip(bags, y, strict=True) if not z)
        r = np.log((n1 + p.smooth * share) / (share * (n0 + n1 + p.smooth))) - np.log((n0 + p.smooth * (1 - share)) / ((1 - share) * (n0 + n1 + p.smooth)))
        if abs(r) >= p.least_ratio:
            ratio[g] = r
    grams = sorted(ratio)
    dense = lambda b: np.array([ratio[g] * b.get(g, 0) for g in grams] + [1.0])
    x, w = np.array([dense(b) for b in bags]), np.zeros(len(grams) + 1)
    penalty = np.diag([p.l2] * len(grams) + [0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (q * (1 - q))) @ x / len(y) + penalty + 1e-12 * np.eye(len(w)), x.T @ (q - y) / len(y) + penalty @ w)
    got = {(r.doc_id, round(r.score, 12)) for r in toxicity.score(docs, model, p).collect()}
    assert len(got) == 62
    for i, score in got:
        text = {900: "vile words", 901: ""}.get(i, rows[i][1] if i < 60 else "")
        assert abs(score - 1 / (1 + np.exp(-dense(counts(text)) @ w))) < 0.01


def test_kernel_equals_sets_of_grams():
    texts = ["Der Hund läuft über die Straße", "The dog runs across the street", "½ ② dog 12", "x", "Élan vital, élan!"]
    p = langid.LangId()
    found = langid.presence(texts, p)
    sets = []
    for t in texts:
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        sets.append({padded[a : a + n] for n in p.orders for a in range(len(padded) - n + 1)})
    want = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    assert np.abs(langid.kernel(found, found) - want).max() < 0.02


def test_numerics_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate([("the dog runs", "en"), ("der hund läuft", "de")] * 20)], "doc_id long, text string, lang string, score int")
    odd = spark.createDataFrame([(100, "½ ② ① ٣ Ⅷ", "en", 1), (101, "漢字", None, 1), (102, "the dog", "de", 1)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.unionByName(odd), langid.train(docs.unionByName(docs))).collect()}
    assert got[100] == "und" and got[101] != "und" and got[102] == "en"
