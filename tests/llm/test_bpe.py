from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from otreelake.llm import bpe as B
from otreelake.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def ours():
    with open(VOCABULARY, "rb") as f:
        return B.ForcedBoundaryBPE(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(9)
    alphabet = "abcdefghij ABCXYZ'\t\n\x0b\x1c\x1f\x85  éÉßİıΣσς0١²½🙂‍한中<|>/!?_-"
    out = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "ΑΣ ΑΣ.", "it's we'll I'M", "ab" * 3000, "é" * 300, "zq" * 40 + "!" * 200]
    for _ in range(3000):
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))))
    return out


def test_same_as_the_library(ours, library):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(ours, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(4)
    odd = [c for c in points if ours.odd[ord(c)]]
    mixed = ["".join(rng.choice(rng.choice((odd, points[:0x3000], points))) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    for made in ([f"a{c}b" for c in points], mixed):
        for at in range(0, len(made), 50_000):
            chunk = made[at : at + 50_000]
            want = library.encode_batch(chunk, add_special_tokens=False)
            wrong = [ascii(t) for t, w in zip(chunk, want, strict=True) if ours.encode(t) != w.ids]
            assert not wrong, wrong[:5]


def test_cuts_are_certain(ours, library):
    """Joined pairs stand in some token; a fragment's encoding does not depend on what stands next to it."""
    inside = set()
    of = {c: b for b, c in enumerate(B.byte_characters())}
    for token in library.get_vocab(with_added_tokens=False):
        own = [of[c] for c in token.removesuffix("</w>")]
        inside.update(zip(own, own[1:]))
    assert {(p >> 8, p & 255) for p in range(1 << 16) if ours.joined[p]} == inside
    data = "xéßq7ж中b".encode()
    assert ours.cut_points(data) == [i for i in range(1, len(data)) if (data[i - 1], data[i]) not in inside]


def test_heap_and_list_agree(ours):
    rng = random.Random(2)
    for _ in range(300):
        ids = [ours.first[b] for b in bytes(rng.choice(b"thearingo") for _ in range(rng.randrange(1, 47)))]
        data = bytes(ours.first.index(i) for i in ids)
        assert ours.merged_by_heap(list(ids)) == ours.merged(data, False)


def test_tables(spark, frame, odd_rows, library):
    docs = frame(odd_rows).withColumn("ids", F.lit("clash"))
    encoded = B.bpe_encode(docs, VOCABULARY)
    got = encoded.collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    decoded = B.bpe_decode(encoded, VOCABULARY).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in decoded) == sorted((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert B.bpe_encode(docs.limit(0), VOCABULARY).count() == 0


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_ENTRIES", 3)
    with open(VOCABULARY, "rb") as f:
        tiny = B.ForcedBoundaryBPE(f.read())
    for text in texts()[:300]:
        assert tiny.encode(text) == library.encode(text, add_special_tokens=False).ids
