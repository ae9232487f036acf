from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from otreelake.llm import langid as L

ALPHABETS = {"aa": "abcde fgh", "bb": "nopqrs tuv", "cc": "äöüßé èçab"}


@pytest.fixture(scope="module")
def docs(frame):
    rng = random.Random(1)
    rows = []
    for k in range(240):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, "".join(rng.choices(ALPHABETS[lang], k=rng.randrange(40, 400))), lang, "s"))
    return frame(rows)


@pytest.fixture(scope="module")
def net(docs):
    return L.fit_on(docs)


def test_held_out_accuracy(docs, net):
    got = L.predict_language(docs, net).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    right = got.lang_pred == got.doc_id.map(lambda i: ["aa", "bb", "cc"][i % 3])
    assert right[got.held_out].mean() >= 0.97 and got.score.between(0, 1).all()


def small(kind, languages=3, seed=0):
    rng = np.random.default_rng(seed)
    h = 4
    return {k: rng.normal(0, 0.5, shape).astype(kind) for k, shape in {"inputs": (2, 3, 256, h), "recurrent": (2, 3, h, h), "out": (2, h, languages), "bias": (languages,)}.items()}


def plain_probabilities(p, data):
    """One window, position by position and number by number."""

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True))

    def squash(x):
        return 1 / (1 + math.exp(-x))

    h = p["recurrent"].shape[-1]
    states = {}
    for d, order in enumerate([range(len(data)), range(len(data) - 1, -1, -1)]):
        x, u = p["inputs"][d].tolist(), p["recurrent"][d].transpose(0, 2, 1).tolist()
        state = [0.0] * h
        for t in order:
            z = [squash(x[0][data[t]][k] + dot(state, u[0][k])) for k in range(h)]
            r = [squash(x[1][data[t]][k] + dot(state, u[1][k])) for k in range(h)]
            c = [math.tanh(x[2][data[t]][k] + r[k] * dot(state, u[2][k])) for k in range(h)]
            state = [(1 - z[k]) * state[k] + z[k] * c[k] for k in range(h)]
            states[d, t] = state
    out = []
    for t in range(len(data)):
        e = [math.exp(dot(states[0, t], p["out"][0][:, k]) + dot(states[1, t], p["out"][1][:, k]) + p["bias"][k]) for k in range(len(p["bias"]))]
        out.append([x / sum(e) for x in e])
    return out


def test_forward_pass_against_brute_force():
    p = small(np.float64)
    net = L.Network(("a", "b", "c"), **p)
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 256, (5, L.WINDOW)).astype(np.uint8)
    got = L.position_probabilities(net, windows)
    for k, w in enumerate(windows):
        assert np.allclose(got[:, :, k].T, plain_probabilities(p, w.tolist()), atol=1e-9)
    # a document's probabilities: the mean over its bytes, filling bytes left out
    text = "".join(rng.choice(list("abcdeé "), 150))
    data = text.encode()
    filled = data + b"\0" * (-len(data) % L.WINDOW)
    each = [q for at in range(0, len(filled), L.WINDOW) for q in plain_probabilities(p, list(filled[at : at + L.WINDOW]))][: len(data)]
    (found,) = L.document_probabilities(net, [text])
    assert np.allclose(found, np.mean(each, 0), atol=1e-9)


def test_documents_over_blocks_are_as_alone(monkeypatch):
    net = L.Network(("a", "b", "c"), **small(np.float64))
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("xyz é"), n)) for n in (1, 5, 700, 64, 0, 3000, 128, 9)] + [None, "12"]
    alone = [L.document_probabilities(net, [t])[0] for t in texts]
    monkeypatch.setattr(L, "BLOCK", 16)
    for x, y in zip(L.document_probabilities(net, texts), alone, strict=True):
        assert (x is None and y is None) or np.allclose(x, y)


def test_gradients_against_finite_differences():
    p = small(np.float64)
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(97, 110, (6, L.WINDOW)).astype(np.uint8), np.arange(6) % 3
    windows[2, 40:] = 0  # filling bytes
    _, g = L.loss_and_gradients(p, windows, labels)
    eps = 1e-6
    for name, values in p.items():
        flat = values.reshape(-1)
        picks = np.argsort(-np.abs(g[name].reshape(-1)))[:12].tolist() + rng.integers(0, len(flat), 12).tolist()
        for i in picks:
            was = flat[i]
            flat[i] = was + eps
            up = L.loss_and_gradients(p, windows, labels)[0]
            flat[i] = was - eps
            down = L.loss_and_gradients(p, windows, labels)[0]
            flat[i] = was
            assert np.isclose((up - down) / (2 * eps), g[name].reshape(-1)[i], atol=1e-7, rtol=1e-4), (name, i)


def test_training_fits(monkeypatch):
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(1, 255, (8, L.WINDOW)).astype(np.uint8), np.arange(8) % 2
    monkeypatch.setattr(L, "STEPS", 60)
    monkeypatch.setattr(L, "BATCH", 8)
    p = L.position_probabilities(L.train(windows, labels, ("a", "b")), windows)
    assert -np.log(p[labels, :, np.arange(8)]).mean() < 0.2


def test_repeated_ids_count_once(frame, docs, monkeypatch):
    """300 rows of one doc_id are one document of the sample."""
    seen = []
    monkeypatch.setattr(L, "train", lambda windows, labels, languages: seen.append((len(windows), languages)))
    rows = [(7, "abc def gh " * 50, "aa", "s")] * 300 + [(8, "nopq rst " * 50, "bb", "s"), (11, "opqr stu " * 50, "bb", "s")]
    L.fit_on(frame(rows))
    assert seen == [(3 * L.SAMPLE_WINDOWS, ("aa", "bb"))]


def test_every_language_is_learned(frame, monkeypatch):
    """The bound is one on documents: with more languages each gives fewer."""
    seen = []
    monkeypatch.setattr(L, "train", lambda windows, labels, languages: seen.append(languages))
    monkeypatch.setattr(L, "SAMPLE_TOTAL", 600)
    rows = [(k, f"some text number {k}", f"l{k % 300:03}", "s") for k in range(3000)]
    L.fit_on(frame(rows))
    assert len(seen[0]) == 300


def test_every_position_is_labelled_and_texts_are_whole(net):
    p = L.position_probabilities(net, L.windows_of(("abcde fgh" * 100).encode()))
    assert p.shape[:2] == (3, L.WINDOW) and np.allclose(p.sum(0), 1, atol=1e-4)
    # The larger part decides, though it comes last.
    (found,) = L.document_probabilities(net, ["abcd ef" * 30 + "nopq rst" * 400])
    assert net.languages[found.argmax()] == "bb"


def test_labels_and_ids_are_no_inputs(docs, net):
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict_language(docs, net).collect()}
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    assert {r["doc_id"] - 1000: (r["lang_pred"], r["score"]) for r in L.predict_language(other, net).collect()} == plain


def test_odd_rows_and_empty_tables(frame, odd_rows, docs, net):
    got = L.predict_language(frame(odd_rows).withColumn("score", F.lit("clash")), net).collect()
    assert len(got) == len(odd_rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert L.fit_on(docs.limit(0)) is None
    assert {r["lang_pred"] for r in L.predict_language(docs, None).collect()} == {"und"}
    assert L.fit_on(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert L.document_probabilities(net, ["12 34 !!", None, "", "² ½ ① Ⅷ _"]) == [None] * 4
