from __future__ import annotations

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from otreelake.llm import chat as C
from otreelake.llm import queries

PIECES = ["</s>", "[INST]", "<|turn|>", "<|end|>\n", "\\", "\\\\", "<", "[", "/", "\n", "ok", "é🙂", "<|image:1.1|>", "<s>", "|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_escape_is_reversible(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
def test_turns_read_back(turns):
    text = "".join(C.flatten_turn(k, role, body)[0] for k, (role, body) in enumerate(turns))
    assert list(C.read_back(text)) == turns


def test_typed_parts():
    content = [{"type": "text", "text": "see <|x"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None}]
    text, start, end, attached = C.flatten_turn(4, "user", json.dumps(content), as_json=True)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    for k, a in enumerate(attached, 1):
        mark = f"<|{a['kind']}:4.{k}|>"
        assert text[a["at"] : a["at"] + len(mark)] == mark
    assert text[start:end] == "see <\\|x<|image:4.1|><|audio:4.2|><|document:4.3|>"
    with pytest.raises(KeyError):
        C.read_parts('[{"type": "video"}]', True)


def chats(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PIECES, k=rng.randrange(6)))) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(50, None, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (None, 0, "user", "no id"), (51, 0, "assistant", "x" * 100_000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment int").repartition(3)


def test_conversations_against_brute_force(spark):
    rows, df = chats(spark)
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in C.format_chats(df).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        r = got[conv]
        assert list(C.read_back(r["formatted"])) == turns and r["n_turns"] == len(turns)
        assert [C.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]] == [t for role, t in turns if role == "assistant"]


def test_segments_join_up(spark, monkeypatch):
    rows, df = chats(spark)
    whole = {r["conv_id"]: r["formatted"] for r in C.format_chats(df).collect()}
    monkeypatch.setattr(C, "SEGMENT_CHARS", 40)
    parts = {}
    for r in C.format_chats(df).orderBy("conv_id", "segment").collect():
        parts[r["conv_id"]] = parts.get(r["conv_id"], "") + r["formatted"]
    assert parts == whole


def test_empty_table(spark):
    _, df = chats(spark)
    assert C.format_chats(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<s>"), (1, 2, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op6_chat(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, -7}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb<s>\nassistant\nc\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, hashlib.sha256(b"b<s>c").hexdigest())
    assert got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")
