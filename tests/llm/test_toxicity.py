from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from otreelake.llm import toxicity as T


@pytest.fixture(scope="module")
def labelled(spark, frame, prose):
    rows, labels = [], []
    for k in range(300):
        toxic = k % 5 == 0
        bad = ["vilekin", "vilekor grobbet", "vilekam vilekus"][k // 5 % 3] if toxic else ""
        rows.append((k, f"{prose(k, 60)} {bad} {prose(1000 + k, 40)}", "en", "s"))
        labels.append((k, 1, int(toxic)))
    return frame(rows), spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")


def test_separates_labelled_documents(labelled):
    docs, labels = labelled
    model = T.fit_on(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = T.grade_toxicity(docs, model).toPandas()
    assert (got.toxic == (got.doc_id % 5 == 0)).all()
    assert got.expected_severity.between(0, 3).all()
    kept = T.drop_toxic(docs.withColumn("toxic", F.lit("mine")), model)
    assert kept.count() == 240 and set(kept.select("toxic").distinct().toPandas().toxic) == {"mine"}


def test_stems_reach_unseen_forms(labelled):
    model = T.fit_on(*labelled)
    assert model.severity("some text with vilekzzz in it")[0] >= model.toxic_from > model.severity("some text with house in it")[0]


def test_odd_rows_and_empty_tables(spark, frame, odd_rows, labelled):
    docs, labels = labelled
    model = T.fit_on(docs, labels)
    odd = frame(odd_rows)
    got = T.grade_toxicity(odd.withColumn("severity", F.lit("clash")), model)
    assert got.count() == len(odd_rows) and not got.where("toxic").count()
    none = T.fit_on(docs.limit(0), labels)
    assert none.severity("anything")[0] < none.toxic_from
    assert T.grade_toxicity(docs.limit(0), none).count() == 0


def test_ordered_thresholds_share_weights():
    """More evidence never lowers a probability, at any threshold."""
    model = T.OrdinalModel({"bad": 2.0}, (1.0, 3.0, 6.0))
    assert [model.severity("bad " * n)[0] for n in (0, 1, 3, 9)] == sorted(model.severity("bad " * n)[0] for n in (0, 1, 3, 9))


def plain_loss(w, t, docs, grades, ridge):
    """Number by number, from the definition P(grade >= k) = sigmoid(w.x - t_k)."""
    theta = [t[0]]
    for step in t[1:]:
        theta.append(theta[-1] + math.exp(step))
    total = 0.0
    for doc, g in zip(docs, grades, strict=True):
        x = sum(w[f] * v for f, v in doc.items())
        at_least = [1.0, *(1 / (1 + math.exp(th - x)) for th in theta), 0.0]
        total -= math.log(at_least[g] - at_least[g + 1])
    return total / len(docs) + ridge * sum(v * v for v in w) / 2


def small_problem():
    rng = np.random.default_rng(4)
    docs = [{int(f): float(rng.uniform(0.5, 2)) for f in rng.choice(6, rng.integers(0, 4), False)} for _ in range(30)]
    entries = [(i, f, v) for i, d in enumerate(docs) for f, v in d.items()]
    rows, cols, vals = (np.array(x) for x in zip(*entries))
    return docs, rng.integers(0, 4, 30), T.Sparse(rows, cols, vals, 30, 6), rng.normal(0, 1, 6), np.array([0.5, -0.3, 0.2])


def test_loss_against_brute_force_and_gradients_against_finite_differences():
    docs, grades, data, w, t = small_problem()
    loss, g_w, g_t = T.loss_and_gradients(w, t, data, grades, 0.01)
    assert math.isclose(loss, plain_loss(w, t, docs, grades, 0.01), rel_tol=1e-9)
    eps = 1e-6
    for x, g in ((w, g_w), (t, g_t)):
        for i in range(len(x)):
            was = x[i]
            x[i] = was + eps
            up = plain_loss(w, t, docs, grades, 0.01)
            x[i] = was - eps
            down = plain_loss(w, t, docs, grades, 0.01)
            x[i] = was
            assert math.isclose((up - down) / (2 * eps), g[i], rel_tol=1e-4, abs_tol=1e-7)


def test_scoring_against_brute_force():
    model = T.OrdinalModel({"bad": 1.3, "wors+": 2.0, "fine": -0.7}, (1.0, 2.5, 4.0), 0.4)
    for text in ("", None, "bad", "Bad bad, worse worst! fine", "nothing here", "fine " * 50):
        words = re.findall(r"[a-z]+", (text or "").lower())
        n = {"bad": words.count("bad"), "wors+": sum(w.startswith("wors") and len(w) > 4 for w in words), "fine": words.count("fine")}
        x = sum(model.weights[f] * (1 + math.log(k)) for f, k in n.items() if k)
        at_least = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        expected, grade = model.severity(text)
        assert math.isclose(expected, sum(at_least))
        levels = [a - b for a, b in zip([1.0, *at_least], [*at_least, 0.0])]
        assert levels[grade] == max(levels)


def test_parts_of_the_sample():
    _, grades, data, w, _ = small_problem()
    kept = np.arange(30) % 4 != 1
    assert np.allclose(data.of(kept).dot(w), data.dot(w)[kept])


def test_repeated_ids_count_once(spark, frame, labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda strength, chosen, counts, toxic: seen.append(len(counts)) or fit(strength, chosen, counts, toxic))
    T.fit_on(docs.union(docs).union(docs.where("doc_id = 10").crossJoin(spark.range(200)).drop("id")), labels)
    T.fit_on(docs, labels)
    assert seen[0] == seen[1]


def test_best_cut():
    assert 0.1 < T.best_cut(np.array([0.1, 0.1, 0.5, 2.0]), np.array([0, 0, 1, 1])) < 0.5
    assert T.best_cut(np.array([0.1, 0.1]), np.array([0, 1])) == T.TOXIC_FROM
