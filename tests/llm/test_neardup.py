from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from otreelake.llm import neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, words, threshold):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and threshold[1] * common >= threshold[0] * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(8)
    rows = {}
    for k in range(120):
        rows[rng.randrange(1 << 40)] = prose(k, 30 + k)
    base = prose(900, 150)
    for k in range(60):  # near copies, some of them linked only over others
        rows[rng.randrange(1 << 40)] = edited(rng, base, k % 9)
    chain = prose(901, 120)
    for _ in range(15):
        chain = edited(rng, chain, 2)
        rows[rng.randrange(1 << 40)] = chain
    passage = prose(902, 60)
    for k in range(40):  # a passage that many share
        rows[rng.randrange(1 << 40)] = f"{passage} {prose(2000 + k, 60)}"
    for k in range(30):
        rows[rng.randrange(1 << 40)] = base.upper() if k % 2 else base
    for k, t in enumerate(["", " ", None, "one", "ONE", "two words", "two  words", "words two"]):
        rows[k] = t
    return sorted(rows.items())


@pytest.mark.parametrize(("words", "threshold"), [(3, (85, 100)), (5, (80, 100))])
def test_against_brute_force(frame, corpus, words, threshold):
    got = {r["doc_id"]: r for r in N.near_duplicates(frame([(i, t, None, None) for i, t in corpus]), words, threshold).collect()}
    want = brute(corpus, words, threshold)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_small_reach_is_made_up_for(frame, corpus, monkeypatch):
    """With short looks back, components over many regions still come together."""
    monkeypatch.setattr(N, "CHUNK", 300)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame([(i, t, None, None) for i, t in corpus]), 3, (85, 100)).collect()}
    assert got == {i: c for i, (_, c) in brute(corpus, 3, (85, 100)).items()}


def test_links_in_a_crowded_region(frame, prose, monkeypatch):
    """Documents on one template are alike just below the threshold; links among them are found however far apart the trees put them."""
    monkeypatch.setattr(N, "REACH", 1)
    monkeypatch.setattr(N, "BLOCK", 16, raising=False)
    template, rows, ids = prose(903, 270), [], random.Random(6).sample(range(1000), 200)  # partners are no neighbours by id
    for k in range(100):
        own = prose(4000 + k, 25)
        rows.append((ids[k], f"{template} {own}"))
        if k % 4 == 0:
            rows.append((ids[100 + k], f"{template} {' '.join(own.split()[:4])} {prose(5000 + k, 21)}"))
    want = {i: c for i, (_, c) in brute(rows, 3, (85, 100)).items()}
    assert sum(i != c for i, c in want.items()) >= 20
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame([(i, t, None, None) for i, t in rows]), 3, (85, 100)).collect()}
    assert got == want


def test_recall_among_ten_thousand(frame, prose):
    """Crowds of 100 on a template each, whose members are alike but no links, with some links among them, and single documents with copies: no link is lost."""
    rng = random.Random(21)
    rows, at = [], iter(rng.sample(range(1 << 40), 10_000))
    groups = []
    for k in range(50):
        template = prose(30_000 + k, 130)
        crowd = []
        for j in range(100):
            own = prose(40_000 + 100 * k + j, 14)
            if j % 10 == 9:  # a link to the one before it, in part at the threshold
                own = " ".join(crowd[-1][1].split()[130 : 130 + rng.randrange(8, 15)]) + " " + prose(60_000 + 100 * k + j, 5)
            crowd.append((next(at), f"{template} {own}"))
        groups.append(crowd)
    for k in range(2500):
        text = prose(100_000 + k, 40 + k % 60)
        groups.append([(next(at), text), (next(at), edited(rng, text, k % 4))])
    rows = [r for g in groups for r in g]
    want, links = {}, 0
    for g in groups:
        found = brute(g, 3, (85, 100))
        want |= {i: c for i, (_, c) in found.items()}
        links += sum(i != c for i, (_, c) in found.items())
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame([(i, t, None, None) for i, t in rows]), 3, (85, 100)).collect()}
    lost = sum(got[i] != c for i, c in want.items())
    print(f"{len(rows)} documents, {links} of them linked with a smaller one, {lost} in another component than by brute force")
    assert links > 1000 and lost == 0


def test_no_link_is_lost_by_the_sketch(frame, prose, monkeypatch):
    """With a cut by sketch that lets nothing through, the links come from the second round alone, which has exact bounds."""
    monkeypatch.setattr(N, "least_likeness", lambda threshold: 2.0)
    rng = random.Random(12)
    rows = [(10 * k + i, edited(rng, prose(6000 + k, 200), i)) for k in range(12) for i in range(7)]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame([(i, t, None, None) for i, t in rows])).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5, (80, 100)).items()}


def test_parity_bounds_the_difference():
    rng = random.Random(13)
    for n in (1, 5, 300, 5000):
        x = {rng.randrange(1 << 64) for _ in range(n)}
        y = set(rng.sample(sorted(x), n - n // 8)) | {rng.randrange(1 << 64) for _ in range(n // 10)}
        u, v = (N.np.array(sorted(s), N.np.uint64) for s in (x, y))
        bits = [N.np.frombuffer(N.parity(h), N.np.uint64)[None] for h in (u, v)]
        differ = N.apart(N.np.array([len(u)]), N.np.array([len(v)]), *bits)[0, 0]
        assert abs(len(x) - len(y)) <= differ <= len(x ^ y)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200, 240)] + [(500, k) for k in range(600, 650)] + [tuple(rng.sample(range(1000, 1060), 2)) for _ in range(50)]
    got = {r["_id"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_odd_rows_and_empty_table(frame, odd_rows):
    docs = frame(odd_rows).withColumn("component_id", F.lit("clash"))
    got = N.near_duplicates(docs, 3, (85, 100)).collect()
    assert len(got) == len(odd_rows)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5: 5, 6: 5}
    assert N.near_duplicates(docs.limit(0), 3, (85, 100)).count() == 0


def test_repeated_ids_are_one_document(frame, prose):
    """By the least of their texts; each row has its document's group."""
    a, b = sorted([prose(1, 60), prose(2, 60)])
    rows = [(7, b), (7, a), (7, a), (3, b), (9, a), (None, a), (None, a), (8, None), (8, a)]
    got = [(r["doc_id"], r["component_id"]) for r in N.near_duplicates(frame([(i, t, None, None) for i, t in rows])).collect()]
    assert sorted(got, key=str) == sorted([(7, 7)] * 3 + [(3, 3), (9, 7), (None, None), (None, None), (8, 7), (8, 7)], key=str)
    docs = frame([(i, t, None, None) for i, t in rows])
    for c in ("a.b", "_id", "gone", "component_id", "kept"):
        docs = docs.withColumn(c, F.lit("mine"))
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "7", "7", "None", "None"]


def test_keep_one(frame, corpus, odd_rows):
    docs = frame([(i, t, None, None) for i, t in corpus]).withColumn("kept", F.lit("mine"))
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in brute(corpus, 5, (80, 100)).items() if i == c)
    assert N.keep_one(docs.limit(0)).count() == 0
