from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from otreelake.llm import fingerprint as FP


def test_levels_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (64, 65, 200, 1000):
        data = rng.integers(97, 97 + rng.integers(1, 30), n).astype(np.uint8)
        got = FP.levels(data)
        assert len(got) == n - 63
        for i in range(len(got)):
            total = int(FP._CLOG[np.bincount(data[i : i + 64], minlength=256)].sum())
            assert got[i] == (FP._TOP - total) * 1000 // FP._TOP


def test_selection_against_brute_force(prose):
    data = prose(4, 200).encode()
    raw = np.frombuffer(data, np.uint8)
    ranks = FP.rarity(np.bincount(FP.levels(raw), minlength=FP.LEVELS))
    own = ranks[FP.levels(raw)]
    votes = np.zeros(len(own), int)
    for i in range(len(own) - 63):
        votes[i + int(own[i : i + 64].argmin())] += 1
    assert len(FP.features(data, ranks)) == len({data[i : i + 64] for i in np.flatnonzero(votes >= 16)})


def test_long_texts_in_segments(prose, monkeypatch):
    data = prose(5, 3000).encode() + b"a" * 500 + prose(6, 500).encode()
    ranks = FP.rarity(np.bincount(FP.levels(np.frombuffer(data, np.uint8)), minlength=FP.LEVELS))
    whole = FP.features(data, ranks)
    for size in (1, 63, 64, 1000, len(data)):
        monkeypatch.setattr(FP, "SEGMENT", size)
        assert (FP.features(data[:3000] if size == 1 else data, ranks) == (FP.features(data[:3000], ranks) if size == 1 else whole)).all()
    monkeypatch.setattr(FP, "SEGMENT", 1 << 16)
    big = data * 120  # 3 MB
    tracemalloc.start()
    FP.digest(big, ranks)
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()


def test_columns_of_new_names_clash(frame, prose):
    docs = frame([(k, prose(k, 40), "en", "s") for k in range(8)])
    for c in ("_id", "block", "tail", "_head", "_before", "edited", "fingerprint", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    assert FP.fingerprints(docs).count() == 8


def test_likeness(prose):
    ranks = FP.rarity(np.zeros(FP.LEVELS))
    a, b = prose(1, 400), prose(2, 400)
    of = lambda t: FP.digest(t.encode(), ranks)
    assert FP.likeness(of(a), of(a)) == pytest.approx(1, abs=1e-6)
    assert FP.likeness(of(a), of(b)) < 0.15 < 0.5 < FP.likeness(of(a), of(a[:-100] + b[:100]))
    assert FP.likeness(of(""), of("")) == 1 and FP.likeness(of(""), of(a)) == 0
    assert len(of(prose(3, 30_000))[0]) > 5


def test_edits_and_next(frame, odd_rows, prose):
    rows = [(k * 7 % 301, prose(k % 40, 30 + k % 60), "en", "s") for k in range(300)] + [(1000 + i, t, lang, s) for i, t, lang, s in odd_rows if i is not None][:11]
    rows = list({i: (i, t, lang, s) for i, t, lang, s in rows}.values())
    got = {r["doc_id"]: r for r in FP.fingerprints(frame(rows)).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i]["text"] == text and hashlib.sha256(got[i]["edited"].encode()).digest() == hashlib.sha256(edited.encode()).digest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    by_text = {}
    for r in got.values():
        by_text.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_one_id_with_most_rows(frame, prose, spark):
    """Its rows are dealt out over blocks, and the order goes on over their borders."""
    rows = [(None, prose(k, 20 + k % 7), "en", "s") for k in range(900)] + [(5, prose(2000 + k, 30), "en", "s") for k in range(500)] + [(10 + k, prose(5000 + k, 25), "en", "s") for k in range(600)]
    docs = frame(rows)
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_id"), "text").withColumn("_h", F.xxhash64("text"))
    block, _ = FP.id_blocks(keyed)
    sizes = [r["count"] for r in keyed.groupBy(block.alias("b")).count().collect()]
    assert max(sizes) < 500 and len(sizes) > 8
    order = [(r["_id"], r["_h"], r["text"]) for r in keyed.collect()]
    order.sort()
    got = {r["text"]: r["edited"] for r in FP.fingerprints(docs).collect()}
    for k, (_, _, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][2], len(text) // 2
        assert got[text] == text[: len(text) - half] + following[:half]


def test_one_row_empty_table_and_repeats(frame):
    (only,) = FP.fingerprints(frame([(5, "abcdef", "en", "s")])).collect()
    assert only["edited"] == "abcabc" and only["near_next"] == 1.0
    assert FP.fingerprints(frame([(5, "x", "en", "s")]).limit(0)).count() == 0
    assert FP.fingerprints(frame([(5, "x", "en", "s"), (5, "x", "en", "s"), (None, None, None, None)])).count() == 3
