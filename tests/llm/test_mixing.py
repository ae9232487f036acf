from __future__ import annotations

import hashlib
import math
import re
from itertools import pairwise

from pyspark.sql import functions as F

from otreelake.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, _, x in rows if x == s) for s in sources}
    budget, full, level = 1.5 * sum(total.values()), set(), 0.0
    while len(full) < len(sources):
        level = (budget - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and 2 * total[s] <= weight[s] * level}
        if not more:
            break
        full |= more
    target = {s: min(2.0 * total[s], weight[s] * level) if s not in full else 2.0 * total[s] for s in sources}
    def key(i, t):
        return hashlib.md5(f"17:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()

    out, queue = {}, []
    for s in sources:
        at = 0
        for k, i in sorted((key(i, t), i) for i, t, _, x in rows if x == s):
            out[i] = [size[i], total[s], target[s], 0]
            for copy in (0, 1):
                start = at + copy * total[s]
                split = start < target[s] < start + size[i]
                cuts = [*range(0, size[i], M.PACKET), size[i]] if split else [0, size[i]]
                for n, (low, high) in enumerate(pairwise(cuts)):
                    if target[s] and high > low:
                        queue.append(((start + high) / target[s], "t" if s is None else f"s{s}", k, copy, n, high - low, i))
            at += size[i]
    left = math.floor(budget)
    for *_, words, i in sorted(queue):
        out[i][3] += min(words, left)
        left -= min(words, left)
    return {i: tuple(x) for i, x in out.items()}, budget, [(i, copy) for *_, copy, n, _, i in sorted(queue) if n == 0]


def test_against_brute_force(frame, prose):
    rows = [(k, prose(k, 5 + k % 50), "en", ["hot"] * 6 and ("hot" if k % 3 else f"s{k % 7}" if k % 7 else None)) for k in range(400)]
    want, budget, _ = brute(rows)
    got = {r["doc_id"]: r for r in M.mix(frame(rows)).collect()}
    for i, (size, total, target, taken) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, total, taken)
        assert math.isclose(r["target"], target)
        assert r["taken"] <= 2 * size
    assert sum(r["taken"] for r in got.values()) == math.floor(budget)
    for s in {x for *_, x in rows}:
        own = [i for i, *_, x in rows if x == s]
        assert abs(sum(got[i]["taken"] for i in own) - got[own[0]]["target"]) <= M.PACKET + 1
    again = {r["doc_id"]: r["taken"] for r in M.mix(frame(rows).repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_copies_keep_columns(frame, prose):
    rows = [(k, prose(k, 20), "en", f"s{k % 3}") for k in range(90)]
    docs = frame(rows).withColumns({"size": F.lit("mine"), "taken": F.lit(1.5)})
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: r["taken"] / 20 for r in M.mix(frame(rows)).collect()}
    assert all(abs(counts.get(i, 0) - t) <= 0.5 for i, t in taken.items())
    assert mixed.where("size = 'mine'").count() == mixed.count()


def test_the_mix_comes_in_the_order_of_finish_times(frame, prose):
    """Sources alternate by weight from the first document on, and part by part the order is that of the brute force."""
    rows = [(k, prose(k, 20), "en", f"s{k % 3}") for k in range(300)]
    _, _, order = brute(rows)
    mixed = [r["doc_id"] for r in M.mixed_documents(frame(rows)).collect()]
    assert mixed == [i for i, _ in order][: len(mixed)]
    early = [i % 3 for i in mixed[:80]]
    # targets: 4,000 of 9,000 words (twice the source), then 5,000 as 2 to 1
    assert all(abs(early.count(k) - want) <= 1 for k, want in enumerate([80 * 4 / 9, 80 * 5 / 9 * 2 / 3, 80 * 5 / 9 / 3]))


def test_a_text_over_many_packets_and_one_id_for_all(frame, prose):
    rows = [(k, prose(k, 5000 if k % 10 == 0 else 7), "en", f"s{k % 2}") for k in range(40)]
    want, _, _ = brute(rows)
    assert {r["doc_id"]: r["taken"] for r in M.mix(frame(rows)).collect()} == {i: x[3] for i, x in want.items()}
    same = frame([(None, prose(k, 9), "en", "a") for k in range(60)] + [(7, "one text", "en", "a")] * 30)
    got = M.mix(same).collect()
    assert len(got) == 90 and sum(r["taken"] for r in got) == math.floor(1.5 * (60 * 9 + 30 * 2))


def test_columns_of_any_name(frame, prose):
    docs = frame([(k, prose(k, 10), "en", f"s{k % 2}") for k in range(20)])
    for c in ("_source", "_key", "_bucket", "_row", "_size", "c0", "a.b", "a b", "_s", "packet", "finish"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for made in (M.mix(docs.drop("finish")), M.mixed_documents(docs)):
        assert {r["a.b"] for r in made.collect()} == {"mine a.b"} and {r["_key"] for r in made.collect()} == {"mine _key"}
    assert M.mixed_documents(docs).columns == docs.columns


def test_odd_rows_and_empty_table(frame, odd_rows):
    docs = frame(odd_rows)
    got = M.mix(docs).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(docs.where("text IS NULL")).first()["taken"] == 0
