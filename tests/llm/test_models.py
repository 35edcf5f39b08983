import random

import numpy as np

from versio.llm import langid, linear, toxicity


def test_logistic_on_sparse_and_dense():
    rng = np.random.default_rng(1)
    n = 600
    x, e = rng.random((n, 8)) < 0.3, rng.normal(size=(n, 1))
    y = (x[:, 0] | (e[:, 0] > 1)).astype(float)
    rows, cols = np.nonzero(x)
    w, v, b = linear.fit_logistic(rows, cols, e, y, 8, l2=1e-4)
    p = linear.sigmoid(x @ w + e @ v + b)
    assert ((p > 0.5) == (y > 0)).mean() > 0.93 and w[0] > 2 and v[0] > 0.5
    assert linear.fit_logistic(rows, cols, e, np.zeros(n), 8)[2] < -5
    assert linear.fit_logistic(rows[:0], cols[:0], np.zeros((0, 0)), np.zeros(0), 8)[2] < -5


def test_svm_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    w = linear.fit_svm(x, y)
    assert (np.sign(np.hstack([x, np.ones((200, 1))]) @ w) == y).mean() > 0.97


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Idiots and IDIOCY, really?! äöü " * 30
    want = toxicity.features(text)
    assert {"idiots", "4:idio", "5:idiot", "?!"} <= want
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.features(text) == want
    assert toxicity.features("") == set()


def test_out_of_fold_probabilities_come_from_other_rows():
    places = [[k] for k in range(40)]  # a feature for each row: it tells only its own row
    y = np.array([[k % 2, k % 2] for k in range(40)])
    models, held = toxicity.fit_rows(places, y, 40)
    assert len(models) == 2 and models[0][1].shape == (0,) and models[1][1].shape == (1,)
    assert np.abs(held[:, 0] - 0.5).max() < 0.35  # the fitted model knows each row, the out-of-fold one none


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")


def test_toxicity_cases(spark):
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(k, prose(30) + (" vile scoundrels" if k % 4 == 0 else ""), "x") for k in range(400)]
    more = [(1000, None, "x"), (1001, "", "x"), (None, prose(20) + " a vile scoundrel", "x"), (1002, prose(200_000) + " vile scoundrel", "x"), (1003, prose(20), "x"), (1003, prose(20), "x")]
    docs = docs_of(spark, rows + more)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(301, None, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality bigint, toxic bigint")
    out = toxicity.toxicity(docs, labels)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.toxic)
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and sum(map(len, got.values())) == len(rows) + len(more)
    assert all(got[k] == [k % 4 == 0] for k in range(400))
    assert got[1000] == got[1001] == [False] and got[None] == [True] and got[1002] == [True] and got[1003] == [False, False]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300 + 4
    assert toxicity.toxicity(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_a_later_model_uses_the_earlier_category(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(300):
        first = rng.random() < 0.5
        rows.append((k, " ".join(rng.sample(["odd", "words", "here", "again"], 3)) + (" marker" if first else ""), ""))
        labels.append((k, int(not first), int(first)))
    chain = toxicity.fit_chain(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint"), {k: toxicity.F.expr(c) for k, c in toxicity.CATEGORIES.items()})
    assert chain.models[1][1][0] > 0.1


def test_langid_cases(spark):
    rng = random.Random(2)
    stock = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "mit", "ding"], "nl": ["het", "een", "met", "ding"], "fr": ["le", "et", "avec", "chose"], "es": ["el", "y", "con", "cosa"], "xx": ["zzq", "qqz", "kxk", "wvw"]}
    rows = [(k, " ".join(rng.choice(stock[a]) for _ in range(12)), a) for k, a in enumerate(list(stock) * 40)]
    labelled = spark.createDataFrame([*rows, (900, "the and", None), (901, None, "en"), (902, "123 ...", "en")], "doc_id bigint, text string, lang string")
    model = langid.train(labelled, per_lang=30)
    assert sorted(map(sorted, model.families)) == [["de", "en", "nl"], ["es", "fr"], ["xx"]]
    asked = spark.createDataFrame([(a, " ".join(rng.choice(stock[a]) for _ in range(25)), "wrong", 1.5) for a in stock] + [("none", None, "x", 0.0), ("digits", "12 ²³ _ .", "x", 0.0), ("empty", "", "x", 0.0), ("one", "É", "x", 0.0)], "doc_id string, text string, lang string, score double")
    out = langid.identify(asked, model)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[a].lang_pred == a and 0 <= got[a].score <= 1 for a in stock)
    assert all(got[a].lang_pred == "und" and got[a].score == 0 for a in ("none", "digits", "empty")) and got["one"].lang_pred in stock
    assert out.columns == ["doc_id", "lang_pred", "score"]
    assert langid.train(labelled.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(asked, None).collect()} == {"und"}
    assert langid.identify(asked.limit(0), model).count() == 0
    long = "the and with thing " * 100_000
    assert model.predict(langid.profile(long))[0] == "en"


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    # two ids on 6,000 rows: one row of each is learned
    docs = docs_of(spark, [(k % 2, f"text number {k} " + "word " * 5, "x") for k in range(6000)])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id bigint, quality bigint, toxic bigint")
    sizes = []
    fit = toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda places, *a: sizes.append(len(places)) or fit(places, *a))
    toxicity.fit_chain(docs, labels, {k: toxicity.F.expr(c) for k, c in toxicity.CATEGORIES.items()}, sample_rows=2)
    assert sizes == [2]
    # a hot id, and more languages than are learned
    rows = [(7, f"the and with {k}", "en") for k in range(5000)] + [(k, f"der und mit {k}", "de") for k in range(50)] + [(k, f"zz {k}", f"l{k % 40}") for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    taken = langid.training_rows(labelled, "doc_id", "text", "lang", 30, 10).groupBy("lang").count().collect()
    assert len(taken) == 10 and {"en", "de"} <= {r.lang for r in taken} and all(r["count"] <= 30 for r in taken)
    assert {r.lang: r["count"] for r in taken}["en"] == 30  # rows of one id are drawn apart


def test_a_column_named_like_the_text(spark):
    docs = spark.createDataFrame([(1, "the and with", "kept")], "doc_id bigint, text string, _text string")
    assert langid.identify(docs, None, keep=("_text",)).first()._text == "kept"


def test_logits_are_held_alike_in_training_and_scoring():
    assert toxicity._logit(np.array([0.0, 1.0, 0.5])).tolist() == [-toxicity.MOST, toxicity.MOST, 0.0]
    chain = toxicity.Chain(("a", "b"), {"w": 0}, [(np.array([90.0]), np.zeros(0), 0.0), (np.array([0.0]), np.array([1.0]), 0.0)])
    assert np.allclose(chain.probabilities("w"), [1 - 1e-6, 1 - 1e-6])
