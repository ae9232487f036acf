from __future__ import annotations

import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from otreelake.llm import neardup, queries
from otreelake.llm.queries import VOCABULARY
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_neardup import brute as grouped


def test_stages_against_brute_force(spark, frame, prose, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        text = f"{prose(k // 3 if k % 10 == 0 else k, 80)}"
        if k % 6 == 0:
            text += " vilekin grobbet"
        if k % 7 == 0:
            text += " token = abcdefgh1234"
        rows.append((k, text, "en", rng.choice(["a", "b", "c", None])))
    rows += [(900, None, None, None), (901, "", "en", "a")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, int(k % 6 == 0)) for k in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    clean = [r for r in rows if not (r[0] < 900 and r[0] % 6 == 0)]
    groups = grouped([(i, t) for i, t, *_ in clean], 5, (80, 100))
    one = [r for r in clean if groups[r[0]][1] == r[0]]
    black = [(i, t and t.replace("token = abcdefgh1234", "[SECRET]"), lang, s) for i, t, lang, s in one]
    taken, *_ = mixed(black)
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t, *_ in black:
        size, _, _, n = taken[i]
        want += [(i, library.encode(t or "", add_special_tokens=False).ids)] * (int(n / size + 0.5) if size else 1)
    got = [(r["doc_id"], r["ids"]) for r in P.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_odd_tables_run_through(spark, frame, odd_rows, tmp_path):
    """Null ids, repeated rows, clashing names; and an empty table."""
    docs = frame(odd_rows)
    for c in ("_id", "_key", "_source", "toxic", "kept", "size", "taken", "component_id", "spans"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name in "ab":
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = [r["doc_id"] for r in P.run(spark, str(tmp_path / "a")).collect()]
    assert {i for i, t, *_ in odd_rows if t and t.split()} - set(got) <= {6}  # the second of two equal texts
    assert None in got and P.run(spark, str(tmp_path / "b")).count() == 0


def test_stages_are_registered(spark, frame, odd_rows, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scans", "mixing", "bpe"]
    frame(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {k.split("_")[0] for k in queries.QUERIES if k.startswith("op")} == {f"op{n}" for n in range(1, 11)}
    assert neardup.LEAST_DEPTH <= neardup.DEPTH
