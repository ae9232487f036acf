"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, langid, mixing, neardup, quality, secret_scan, toxicity, url_filter
from .common import map_batches, pa_schema, table

#: The rules that op1 judges by.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest)
SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1))) AS rule,
 coalesce((SELECT max_by(verdict, length(rule)) FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1))), 'allow') AS verdict
FROM parts
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "expected_severity", "severity", "toxic", (~F.col("toxic")).alias("kept"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "finish")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k, coalesce('s' || source, 't') AS q FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(2 * source_size) OVER w AS filled, sum(weight) OVER () - sum(weight) OVER w AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
c AS (SELECT o.*, rest + weight AS open FROM o),
l AS (SELECT max((budget - (filled - 2 * source_size)::DOUBLE) / open::DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * (SELECT level FROM l)) AS target FROM s),
p AS (SELECT row_number() OVER () AS r, d.doc_id, d.q, d.k, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, start + copy * source_size AS own FROM (SELECT p.*, unnest([0, 1]) AS copy FROM p WHERE target > 0)),
e AS (SELECT *, CASE WHEN own < target AND own + size > target THEN unnest(range(0, (size + 15) // 16)) ELSE 0 END AS packet, own < target AND own + size > target AS dealt FROM (SELECT *, 1 AS one FROM c2) WHERE size > 0),
f AS (SELECT DISTINCT r, q, k, copy, packet, CASE WHEN dealt THEN own + least(size, (packet + 1) * 16) ELSE own + size END AS upto, CASE WHEN dealt THEN least(size, (packet + 1) * 16) - packet * 16 ELSE size END AS words, target FROM e),
g AS (SELECT *, sum(words) OVER (ORDER BY upto::DOUBLE / target, q, k, copy, packet ROWS UNBOUNDED PRECEDING) AS total FROM f),
h AS (SELECT r, sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(size)) FROM d)::BIGINT - (total - words))))::BIGINT AS taken FROM g GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN target > 0 THEN (start + size)::DOUBLE / target END AS finish
FROM p LEFT JOIN h USING (r)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_chats(turns.unionByName(own)).select("conv_id", "formatted", "loss")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = pa_schema(spark, schema)

    def digests(batches):
        """The segments of a conversation follow one another; sums and digests go on over them."""
        now, begun = None, False
        for batch in batches:
            done = []
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or now["conv_id"] != conv:
                    if begun:
                        done.append(now | {"turns_sha256": turns.hexdigest(), "loss_sha256": masked.hexdigest()})
                    now, begun = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, True
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, text in chat.read_back(formatted):
                    now["n_turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = chat.unescape(formatted[span["start"] : span["end"]])
                    now["loss_chars"] += len(text)
                    masked.update(text.encode())
                now["formatted_chars"] += len(formatted)
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
        if begun:
            yield pa.RecordBatch.from_pylist([now | {"turns_sha256": turns.hexdigest(), "loss_sha256": masked.hexdigest()}], types)

    return formatted.mapInArrow(digests, schema)


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<|turn|>') + length(role) + 1 + escaped + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digests(cols: dict, coder: bpe.ForcedBoundaryBPE) -> dict:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["text"]:
            ids = coder.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(" ".join(map(coder.names.__getitem__, ids))))
            out["decoded_sha256"].append(sha256(coder.decode(ids)))
        return out

    return map_batches(docs, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", bpe.loader(docs, VOCABULARY))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.fit_on(docs))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


# Parts of the operators' results that SQL can express, over the same whole tables.


def llm_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_COUNTS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT pos)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n >= 2) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM t JOIN l USING (r) LEFT JOIN c USING (r)
"""


def llm_edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_DIGESTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents WINDOW w AS (ORDER BY doc_id))
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(substr(text, 1, (length(text) - length(text) // 2)::BIGINT) || substr(following, 1, (length(text) // 2)::BIGINT)) AS edited_sha256 FROM t
"""


def llm_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
 len(list_filter(regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
 len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM t
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, m.b FROM r JOIN m ON m.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""

QUERIES = {"op1_url_filter": op1_url_filter, "op2_toxicity": op2_toxicity, "op3_mixing": op3_mixing, "op4_quality": op4_quality, "op5_fingerprint": op5_fingerprint, "op6_chat": op6_chat, "op7_bpe": op7_bpe, "op8_secrets": op8_secrets, "op9_langid": op9_langid, "op10_neardup": op10_neardup, "llm_quality_counts": llm_quality_counts, "llm_edited_digests": llm_edited_digests, "llm_secret_counts": llm_secret_counts}

ORACLES = {"op1_url_filter": OP1_SQL, "op3_mixing": OP3_SQL, "op6_chat": OP6_SQL, "op10_neardup": OP10_SQL, "llm_quality_counts": QUALITY_COUNTS_SQL, "llm_edited_digests": EDITED_DIGESTS_SQL, "llm_secret_counts": SECRET_COUNTS_SQL}
