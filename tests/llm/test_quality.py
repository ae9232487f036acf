from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from otreelake.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(40)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_counts_against_brute_force(frame, odd_rows, prose, labels):
    rng = random.Random(1)
    rows = [(100 + k, "\n".join(prose(rng.randrange(6), rng.randrange(1, 30)) + rng.choice(["", " *#", " "]) for _ in range(rng.randrange(1, 8))), "en", "s") for k in range(60)]
    rows += [(200, "a b c a b c", "en", "s"), (201, "a a a a", "en", "s"), (202, "a b", "en", "s"), (203, "x y z\nx y z\n\n \n", "en", "s")]
    docs = frame(rows + [r for r in odd_rows if r[0] is not None])
    want = {i: brute(t) for i, t, *_ in rows + odd_rows}
    for r in Q.quality(docs, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r
        assert not (r["kept"] and r["base_failed"])


def test_junk_scores_lower(frame, prose, labels):
    rows = [(k, prose(k, 80) if k % 2 == 0 else " ".join(f"{w}%%%" for w in prose(k, 80).split()), "en", "s") for k in range(40)]
    rows += [(100, prose(555, 80), "en", "s"), (101, " ".join(f"{w}%%%" for w in prose(556, 80).split()), "en", "s")]
    got = {r["doc_id"]: r for r in Q.quality(frame(rows), labels).collect()}
    assert got[100]["kept"] and got[100]["score"] > got[101]["score"] and not got[101]["kept"]


def plain_scores(spark, rows, good, monkeypatch):
    """The ratio by its definition, over every document; only the hash is Spark's."""
    texts = {i: WORD.findall(t or "") for i, t, *_ in rows}
    grams = sorted({(w,) for ws in texts.values() for w in ws} | {p for ws in texts.values() for p in zip(ws, ws[1:])})
    df = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None) for g in grams], "a string, b string").withColumn("k", F.monotonically_increasing_id())
    one, two = F.xxhash64("a"), F.xxhash64("b")
    found = df.select("a", "b", F.when(F.col("b").isNull(), Q.bucket(one)).otherwise(Q.bucket(one, two)).alias("bucket")).collect()
    bucket = {(r["a"],) if r["b"] is None else (r["a"], r["b"]): r["bucket"] for r in found}
    of = {i: [bucket[g] for g in [*((w,) for w in ws), *zip(ws, ws[1:])]] for i, ws in texts.items()}
    every, trusted = Counter(b for bs in of.values() for b in bs), Counter(b for i, bs in of.items() if i in good for b in bs)
    share = sum(trusted.values()) / sum(every.values())
    return {i: sum(round(math.log((trusted[b] + Q.PRIOR) / (every[b] * share + Q.PRIOR)), 5) for b in bs) / len(bs) if bs else 0.0 for i, bs in of.items()}


@pytest.mark.parametrize("most", [Q.MOST_BROADCAST, 0])
def test_score_and_verdict_against_brute_force(spark, frame, prose, labels, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_BROADCAST", most)
    rows = [(k, prose(k % 17, 50 + k) if k % 3 else f"zz{k} " * 60, "en", "s") for k in range(60)] + [(200, None, "en", "s"), (201, "word", "en", "s")]
    want = plain_scores(spark, rows, {k for k in range(40) if k % 2 == 0}, monkeypatch)
    for r in Q.quality(frame(rows), labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6), r
        assert r["kept"] == (not r["base_failed"] and r["score"] >= Q.LEAST_SCORE)


def test_many_repeated_windows_and_few_agree(frame, labels, monkeypatch):
    """Both ways of finding the places of repeated windows, on both sides of the number where one takes over."""
    rng = random.Random(3)
    rows = [(k, " ".join(str(rng.randrange(5 + k)) for _ in range(30 * k)), "en", "s") for k in range(1, 25)]
    want = {i: brute(t)[4] for i, t, *_ in rows}
    for few in (0, 3, 64, 10_000):
        monkeypatch.setattr(Q, "FEW", few)
        assert {r["doc_id"]: r["n_repeat_words"] for r in Q.quality(frame(rows), labels).collect()} == want


def test_no_python_in_the_plan(frame, prose, labels):
    plan = Q.quality(frame([(1, prose(1, 60), "en", "s")]).withColumn("score", F.lit("clash")), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(frame, labels):
    docs = frame([(1, "a b", "en", "s")])
    assert Q.quality(docs.limit(0), labels).count() == 0
    assert Q.quality(docs, labels.limit(0)).first()["score"] == 0.0
