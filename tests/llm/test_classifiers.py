import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.common import read_table
from corvane.llm.language_id import BUCKETS, SMOOTHING, Languages, best_mixtures, buckets_of, fit_languages, held_out, identify, mixtures, words_of
from corvane.llm.ordinal import DAMPING, OrdinalModel, fit_ordinal, grade, learn_ordinal, likelihood, rating, thresholds_of

FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables aren't here")


def test_mixture_proportions_are_recovered():
    rng = np.random.default_rng(0)
    p = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]])
    draw = np.concatenate([rng.choice(4, 6000, p=p[0]), rng.choice(4, 4000, p=p[1])])
    counts = np.bincount(draw, minlength=4).astype(float)
    share, like = mixtures(np.log(p.T), counts, np.array([0]), np.ones((1, 3), bool), rounds=500)
    assert share[0] == pytest.approx([0.6, 0.4, 0.0], abs=0.03)
    best = best_mixtures(np.log(p.T), counts, np.array([0]))
    assert (best[0] > 0).tolist() == [True, True, False] and best[0].sum() == pytest.approx(1)
    pure = np.bincount(rng.choice(4, 5000, p=p[2]), minlength=4).astype(float)
    both = best_mixtures(np.log(np.concatenate([p.T, p.T])), np.concatenate([pure, counts]), np.array([0, 4]))
    assert both[0].tolist() == [0, 0, 1] and (both[1] > 0).tolist() == [True, True, False]
    brute = max(((mixtures(np.log(p.T), counts, np.array([0]), np.array([[bool(m >> i & 1) for i in range(3)]]), 500)[1][0] - 3 * np.log(10001) * bin(m).count("1")), m) for m in range(1, 8))
    assert [bool(brute[1] >> i & 1) for i in range(3)] == (best[0] > 0).tolist()


def test_odd_rows_of_language_id(spark, docs_of):
    rows = [(i, "der und die das ist nicht ein " * 5, "de", "s", 0) for i in range(9)] + [(20 + i, "the and of is not a with " * 5, "en", "s", 0) for i in range(9)]
    model = fit_languages(docs_of(rows + [(90, None, "de", "s", 0), (91, "xx", None, "s", 0)]))
    odd = [(1, None), (2, ""), (3, "1234 %% 5"), (4, "the"), (4, "the"), (None, "und und"), (5, "the of and is " * 30_000 + "der die das " * 20_000), (6, "Ω ж")]
    got = {(r.doc_id, r.lang_pred): r for r in identify(docs_of(odd).withColumnsRenamed({"lang": "score", "source": "lang_pred"}), model).collect()}
    assert {k for k in got if k[0] in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")} and got[1, "und"].score == 0
    assert (4, "en") in got and (None, "de") in got
    mixed = got[5, "en"]
    assert mixed.langs == ["en", "de"] and mixed.shares[0] == pytest.approx(2 / 3, abs=0.05) and mixed.score == mixed.shares[0]
    assert identify(docs_of([]), model).count() == 0
    with pytest.raises(ValueError):
        fit_languages(docs_of([]))
    assert isinstance(model, Languages) and model.names == ("de", "en")


def test_numbers_are_no_letters(spark, docs_of):
    rows = [(1, "a b c " * 9, "en", "s", 0), (2, "x y z " * 9, "xy", "s", 0)]
    got = identify(docs_of([(1, "½ ² ③ Ⅷ 12 _"), (2, "ª"), (3, "x²y")]), fit_languages(docs_of(rows)))
    assert {r.doc_id: r.lang_pred == "und" for r in got.collect()} == {1: True, 2: False, 3: False}


def test_likelihoods_equal_a_full_table(docs_of, monkeypatch):
    rows = [(i, " ".join(f"{chr(97 + i)}{a}{b}" for a in "aeiou" for b in "aeiou"), f"l{i}", "s", 0) for i in range(20)]
    model = fit_languages(docs_of(rows))
    assert all(r.lang_pred == f"l{r.doc_id}" for r in identify(docs_of(rows), model).collect())
    full = np.zeros((20, BUCKETS))
    for i, text, *_ in rows:
        at, _ = buckets_of(text.split())
        np.add.at(full[sorted(f"l{k}" for k in range(20)).index(f"l{i}")], at, 1)
    used = (full.sum(axis=0) > 0).sum()
    table = np.log(full + SMOOTHING) - np.log(full.sum(axis=1, keepdims=True) + SMOOTHING * 2 * used)
    words = ["aea", "bzz", "unseen", "x"]
    want = [table[:, buckets_of([w])[0]].sum(axis=1) for w in words]
    assert model.of(words) == pytest.approx(np.array(want))
    monkeypatch.setattr("corvane.llm.language_id.MAX_COUNTS", 100)
    with pytest.raises(ValueError, match="pairs of languages"):
        fit_languages(docs_of(rows))


def test_words_are_stretches_of_letters():
    plain = lambda t: re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() or not (c.isalnum() and not c.isdecimal()) else " " for c in t.lower()))
    for text in ("x²y ½a Ⅷ b③c", "İstanbul naïve_x 漢字 a1b", "", "one two", "٣ab"):
        assert words_of(text) == plain(text)


@needs_tables
def test_held_out_languages(spark):
    docs = read_table(spark, FOLDER, "documents").where("doc_id < 3000")
    model = fit_languages(docs.where(~held_out()))
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 900 and right / n > 0.99
    ids = [r.doc_id for r in docs.where(held_out()).select("doc_id").collect()]
    assert ids == [i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1]


def plain_loss(scores, grades, weight, thresholds):
    t = [-np.inf, *thresholds, np.inf]
    at_most = lambda k, s: 1 / (1 + np.exp(-(t[k + 1] - s)))
    return -sum(w * np.log(at_most(g, s) - (at_most(g - 1, s) if g else 0)) for s, g, w in zip(scores, grades, weight))


@pytest.mark.parametrize("n_grades", [2, 3, 5])
def test_likelihood_and_its_gradient(n_grades):
    rng = np.random.default_rng(n_grades)
    scores, grades, weight, free = rng.normal(0, 2, 12), rng.integers(0, n_grades, 12), rng.random(12) + 0.1, rng.normal(0, 0.5, n_grades - 1)
    loss, by_score, by_free = likelihood(scores, grades, weight, free)
    assert loss == pytest.approx(plain_loss(scores, grades, weight, thresholds_of(free)), rel=1e-9)
    e = 1e-6
    for i in range(12):
        step = e * np.eye(12)[i]
        assert by_score[i] == pytest.approx((likelihood(scores + step, grades, weight, free)[0] - likelihood(scores - step, grades, weight, free)[0]) / (2 * e), abs=1e-5)
    for i in range(n_grades - 1):
        step = e * np.eye(n_grades - 1)[i]
        assert by_free[i] == pytest.approx((likelihood(scores, grades, weight, free + step)[0] - likelihood(scores, grades, weight, free - step)[0]) / (2 * e), abs=1e-5)


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 900)
    rows = [np.unique(np.r_[rng.integers(100, 160, 5), rng.integers(10 * g, 10 * g + 20, 3)]).astype(np.int32) for g in grades]
    args = np.concatenate(rows), np.array([len(r) for r in rows]), grades, 3

    def loss(model):
        s = np.array([model.weights[r].sum() / len(r) ** DAMPING for r in rows])
        return plain_loss(s, grades, np.ones(900), model.thresholds)

    losses = [loss(learn_ordinal(*args, epochs=n, balance=0.0)) for n in (0, 1, 4, 15)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.8 * losses[0]


def test_tails_by_grade(docs_of):
    model = OrdinalModel(np.zeros(1 << 18, np.float32), np.array([-1.0, 1.0]))
    first, last = (grade(docs_of([(1, "x")]), model, tail=t).first().tail_probability for t in (1, None))
    assert first == pytest.approx(0.731, abs=1e-3) and last == pytest.approx(0.269, abs=1e-3)
    for wrong in (0, 3):
        with pytest.raises(ValueError):
            grade(docs_of([(1, "x")]), model, tail=wrong)


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(1000, 3000, 30)).astype(np.int32) for _ in range(1500)]
    grades = rng.integers(0, 3, 1500)
    rows = [np.r_[g, r].astype(np.int32) for g, r in zip(grades, rows)]  # feature number g marks grade g
    model = learn_ordinal(np.concatenate(rows), np.array([len(r) for r in rows]), grades, 3)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] < model.weights[1] < model.weights[2]
    s = np.array([model.weights[r].sum() / len(r) ** DAMPING for r in rows])
    tails = model.tails(s)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(axis=1) == grades) > 0.95


@needs_tables
def test_held_out_grades(spark):
    docs, labels = (read_table(spark, FOLDER, t) for t in ("documents", "labels"))
    ratings = labels.withColumn("grade", rating())
    model = fit_ordinal(docs, ratings.where(~held_out()), 3)
    got = grade(docs.join(labels.select("doc_id").where(held_out()), "doc_id", "left_semi"), model).join(ratings, "doc_id").toPandas()
    share = got.groupby("grade")["kept"].mean()
    assert share[2] > 0.97 and share[0] < 0.05 and share[1] < 0.4
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_odd_rows_of_grading(spark, docs_of):
    model = OrdinalModel(np.zeros(1 << 18, np.float32), np.array([-1.0, 1.0]))
    odd = [(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "x")]
    got = grade(docs_of(odd).withColumnsRenamed({"lang": "score", "source": "kept"}), model).collect()
    assert len(got) == 5 and all(abs(r.expected_grade - 1) < 1e-6 for r in got)
    none = fit_ordinal(docs_of(odd), spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert not none.weights.any() and grade(docs_of([]), model).count() == 0
