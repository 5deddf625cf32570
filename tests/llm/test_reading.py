import numpy as np
from compare import DATA
from pyspark.sql import functions as F

from landloom.llm import reading as r

DOCS = "doc_id long, text string, grade string, features int"


def test_prose_of_a_commit():
    t = "commit 5c197519acfa34c5\r\nAuthor: A <a@b>\r\nDate: now\r\n\r\n    Fix it\r\n\r\n    The page moves.\r\n    Signed-off-by: me\r\n\r\ndiff --git a/x b/x\r\n+int x = 3;\r\n+Callers may still use the old name, but a warning is printed.\r\n"
    p = r.prose(t)
    assert "The page moves." in p and "Callers may still" in p and "Author" not in p and "int x" not in p and "Signed" not in p
    assert r.prose("Subject: [PATCH 1/2] Add it\n\nBody here.").startswith("Add it")
    assert r.prose(None) == "" and r.prose("") == ""


def test_features_tell_long_words_and_clauses():
    easy = r.features("The dog runs. It is big. We see it. You can go now.")
    hard = r.features("Notwithstanding considerable heterogeneity, practitioners, who were hitherto unconvinced, recommend parametrisation because convergence deteriorates.")
    at = r.FEATURES.index
    for f in ("sentence_words", "word_letters", "long_share", "clauses"):
        assert hard[2][at(f)] > easy[2][at(f)]
    assert r.features("")[0] == 0


def test_ordinal_recovers_order_and_rater_bias():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 3))
    raters = rng.choice(["a", "b", "c"], 900)
    z = 2 * x[:, 0] - x[:, 1] + (raters == "c") * 1.0 + rng.logistic(size=900) * 0.5
    y = 1 + np.searchsorted([-2, -0.5, 0.5, 2], z)
    m = r.Ordinal().fit(x, y, raters)
    assert m.weights[0] > 1 and m.weights[1] < -0.5 and abs(m.weights[2]) < 0.2 and (np.diff(m.cuts) > 0).all()
    p = m.probabilities(x)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    assert np.corrcoef(p @ np.arange(1, 6), y)[0, 1] > 0.85


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the graded documents, the estimate follows the marks of the rest."""
    docs, marks = spark.read.parquet(str(DATA / "sf0.1/documents.parquet")), spark.read.parquet(str(DATA / "sf0.1/reading_marks.parquet"))
    graded = docs.join(marks.select("doc_id").distinct(), "doc_id")
    prosed = r.prose_features(graded).cache()
    full = r.full_features(prosed, r.rarity_table(prosed)).cache()
    model = r.fit(full, marks.where("doc_id % 3 <> 0"))
    out = r.clean_marks(marks.where("doc_id % 3 = 0")).groupBy("doc_id").agg(F.avg("grade").alias("g")).join(r.levels(full, model).select("doc_id", F.col("grade").alias("e")), "doc_id").toPandas()
    assert out.g.corr(out.e) > 0.8 and (out.g - out.e).abs().mean() < 0.6


def run(spark, docs, marks):
    prosed = r.prose_features(spark.createDataFrame(docs, DOCS))
    full = r.full_features(prosed, r.rarity_table(prosed))
    m = spark.createDataFrame(marks, "doc_id long, rater string, grade_mark int, marked_at timestamp, n_words int")
    return {x.doc_id: x for x in r.levels(full, r.fit(full, m)).collect()}


def test_dirty_input(spark):
    easy, hard = "The dog ran to us. It was fun to see. ", "Heteroscedasticity notwithstanding, identification deteriorates whenever parametrisation, hitherto unexamined, remains quasi-stationary. "
    docs = [(i, easy * (1 + i % 3), "x", 1) for i in range(20)] + [(100 + i, hard * (1 + i % 3), "x", 1) for i in range(20)]
    docs += [(900, None, "x", 1), (901, "", "x", 1), (902, "   \n", "x", 1), (903, "commit abcdef0123\n\ndiff --git a/x b/x\n+x", "x", 1), (None, easy, "x", 1), (904, easy * 20_000, "x", 1)]
    marks = [(i, "a", 1, None, 0) for i in range(20)] + [(100 + i, None, 5, None, 0) for i in range(20)] + [(1, "a", 1, None, 0), (2, "a", None, None, 0), (3, "a", 9, None, 0), (None, "a", 3, None, 0), (7777, "a", 3, None, 0)]
    got = run(spark, docs, marks)
    assert all(got[k].grade is None and got[k].level is None for k in (900, 901, 902, 903))
    assert got[5].grade < got[105].grade and got[904].level == 1 and got[None].level == 1 and got[904].n_words == 20_000 * 10
    assert all(x.grade is None for x in run(spark, docs, []).values())
    assert run(spark, [], marks) == {}
