from __future__ import annotations

import base64
import random
import re

from pyspark.sql import functions as F

from otreelake.llm import secret_scan as S

PATTERNS = [
    ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    found = [(*m.span(), k, kind) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [(a, b, kind) for a, b, _, kind in sorted(found, key=lambda s: (s[0], s[2]))]


def test_base_spans_against_brute_force():
    rng = random.Random(4)
    pieces = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "é", "ſecret", "toKen", "x.y", "--"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert [s for s in S.scan(text) if s[2] != "random"] == base(text), text
    assert base("secret=token:abcdefgh") == [] == S.scan("secret=token:abcdefgh")


def test_battery_tells_random_from_prose():
    rng = random.Random(7)
    keys = [base64.b64encode(rng.randbytes(n)).decode() for n in (24, 30, 48, 64) for _ in range(25)]
    found = sum(bool(S.random_spans(f"value {k} end")) for k in keys)
    assert found >= 90
    clean = ["antidisestablishmentarianismandmore", "a" * 60, "abababababababababababababab", "this-is-a-long-file-name-for-a-page", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijkl", "0000000000000000000000001", "path/to/some/file/in/a/folder/deep/down", "1234567890123456789012345678901234567890"]
    assert not any(S.random_spans(f"x {c} y") for c in clean)


def test_random_strings_of_each_encoding_are_found():
    rng = random.Random(9)
    for name in ("hex", "HEX", "base32", "base36", "BASE36", "base62", "base64", "base64url"):
        for length, least in ((20, 80), (32, 90), (40, 95)):
            keys = ["".join(rng.choices(S.ENCODINGS[name], k=length)) for _ in range(100)]
            assert sum(bool(S.random_spans(f"value {k} end")) for k in keys) >= least, (name, length)


def test_discoveries_get_harder_with_candidates():
    """The step-up is over all candidates of the text."""
    key = "q7Zp2Xv9Lk4Rt8Wm3Bn6"
    alone = S.random_spans(key)
    crowd = S.random_spans(" ".join([key, *("some_long_identifier_name_%d" % k for k in range(5000))]))
    assert len(alone) >= len(crowd)


def test_battery_against_simulation():
    """Of random strings each test rejects about as many as its level says."""
    rng = random.Random(11)
    for name in ("hex", "base62", "base64"):
        alphabet = S.ENCODINGS[name]
        got = [S.battery("".join(rng.choices(alphabet, k=60)), alphabet) for _ in range(2000)]
        for k in range(3):
            for level in (0.05, 0.2):
                assert abs(sum(p[k] <= level for p in got) / 2000 - level) < 0.03, (name, k, level)


def test_discovery_step_against_brute_force(monkeypatch):
    """Weighted Benjamini-Hochberg by its definition: the most candidates whose weighted p-values stay below the line."""
    rng = random.Random(12)
    for _ in range(300):
        texts = ["".join(rng.choices("AbC9", k=rng.randrange(20, 60))) for _ in range(rng.randrange(1, 9))]
        p_of = {t: 10 ** rng.uniform(-6, 0) for t in texts}
        monkeypatch.setattr(S, "p_value", lambda string, alphabet: p_of[string])
        total = sum(map(len, texts))
        q = {t: p_of[t] * total / (len(texts) * len(t)) for t in texts}
        most = max((k for k in range(1, len(texts) + 1) if sorted(q.values())[k - 1] <= S.FDR * k / len(texts)), default=0)
        want = set(sorted(texts, key=q.__getitem__)[:most])
        joined = " ".join(texts)
        assert {joined[a:b] for a, b in S.random_spans(joined)} == want


def test_the_battery_counts_in_the_discovery():
    alphabet = S.ENCODINGS["base62"]
    string = "q7Zp2Xv9Lk4Rt8Wm3Bn6"
    assert S.p_value(string, alphabet) >= S.p_against_prose(string, alphabet)
    rng = random.Random(13)
    for _ in range(200):
        t = "".join(rng.choices(alphabet, k=30))
        b = min(1.0, 3 * min(S.battery(t, alphabet)))
        assert S.p_value(t, alphabet) == (min(1.0, S.p_against_prose(t, alphabet) / b) if b >= S.REJECT else 1.0)


def test_redact():
    text = "a token = abcdefgh b 0123456789abcdef01234567 c"
    assert S.redact(text) == "a [SECRET] b [SECRET] c"
    assert S.redact(None) is None and S.redact("") == ""
    assert S.redact("secret=0123456789abcdef01234567!") == "[SECRET]!"


def test_tables(frame, odd_rows):
    secret = (99, "the password: hunter22 and " + "0123456789abcdef" * 2, "en", "s")
    docs = frame([*odd_rows, secret, secret]).withColumn("spans", F.lit("clash"))
    got = S.find_secrets(docs).collect()
    assert len(got) == len(odd_rows) + 2
    assert [(s["kind"], s["start"], s["end"]) for r in got if r["doc_id"] == 99 for s in r["spans"]] == [("assign", 4, 22), ("hex", 27, 59)] * 2
    clean = S.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.where("spans = 'clash'").count() == clean.count() == docs.count()
    for r in clean.where("doc_id = 99").collect():
        assert r["text"] == "the [SECRET] and [SECRET]" and r["n_chars"] == len(r["text"])
    assert S.find_secrets(docs.limit(0)).count() == S.redact_secrets(docs.limit(0)).count() == 0
