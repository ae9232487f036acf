"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes of the lower-cased text in windows of 64, one pass from the left and one from the right, labels every position
from both states, and a document's probabilities are the mean over all of its positions. States begin anew with each window, so a position
sees its own window only. Training is backpropagation through time, in numpy on the driver, over a bounded sample of windows; the windows of
a sampled document are spread over its whole text. Prediction reads every byte of every text, many windows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

WINDOW, HIDDEN = 64, 16
#: What training reads at most: documents of a language, windows of a document, documents of all languages together (with so many languages that
#: this binds, each gives fewer documents, one at least as long as there are no more languages than that).
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_TOTAL = 400, 8, 100_000
STEPS, BATCH, RATE = 500, 256, 0.01
#: Bytes of a table of languages that is broadcast; a larger one is joined by shuffle.
SMALL = 8 << 20
#: Windows predicted at once. Their arrays stay in a core's cache, and their products are too small for BLAS to start threads that wait for each other.
BLOCK = 512
#: What a text without letters, or no text, is.
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def windows_of(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last is filled with zero bytes."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def clean(text: str | None) -> bytes:
    """The bytes that the network reads; none for a text without a letter."""
    return text.lower().encode() if text and _LETTER.search(text) else b""


@dataclass(frozen=True)
class Network:
    """For each direction: inputs (3, 256, H: what a byte adds to update gate, reset gate and candidate) and recurrent (3, H, H); then out (2, H, L) and bias."""

    languages: tuple[str, ...]
    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> None:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def step(at: np.ndarray, h: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, z: np.ndarray, r: np.ndarray, rec: np.ndarray, c: np.ndarray, into: np.ndarray) -> None:
    """From states h over the bytes at to the states into; update gate z, reset gate r, rec (the candidate's recurrent part before the reset) and candidate c are filled in."""
    for k, gate in ((0, z), (1, r)):
        np.matmul(h, recurrent[k], out=gate)
        gate += inputs[k].take(at, 0)
        sigmoid(gate)
    np.matmul(h, recurrent[2], out=rec)
    np.multiply(rec, r, out=c)
    c += inputs[2].take(at, 0)
    np.tanh(c, out=c)
    np.subtract(c, h, out=into)
    into *= z
    into += h


#: The order in which the two directions read a window.
ORDERS = (range(WINDOW), range(WINDOW - 1, -1, -1))


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(L, WINDOW, n): every position's probabilities of the languages."""
    n, hidden = len(windows), net.recurrent.shape[-1]
    columns = np.ascontiguousarray(windows.T).astype(np.intp)
    logits = np.empty((WINDOW, len(net.languages), n), net.out.dtype)
    logits[:] = net.bias[:, None]
    z, r, rec, c, *turns = np.empty((6, n, hidden), net.recurrent.dtype)
    for d, order in enumerate(ORDERS):
        h = np.zeros((n, hidden), net.recurrent.dtype)
        for k, t in enumerate(order):
            step(columns[t], h, net.inputs[d], net.recurrent[d], z, r, rec, c, turns[k % 2])
            h = turns[k % 2]
            logits[t] += net.out[d].T @ h.T
    return softmax(np.ascontiguousarray(logits.transpose(1, 0, 2)))


def document_probabilities(net: Network, texts: list[str | None]) -> list[np.ndarray | None]:
    """Mean probabilities of each text's positions; None where nothing can be read. A text's windows may lie in several blocks."""
    totals = np.zeros((len(texts), len(net.languages)))
    lengths = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0
    block = max(16, min(BLOCK, (1 << 22) // (WINDOW * len(net.languages))))

    def read(rows: np.ndarray, owner: np.ndarray) -> None:
        p = position_probabilities(net, rows)
        p *= rows.T != 0
        np.add.at(totals, owner, p.sum(1).T)

    for i, text in enumerate(texts):
        data = clean(text)
        lengths[i] = len(data)
        if data:
            held.append(windows_of(data))
            owners.append(np.full(len(held[-1]), i))
            size += len(held[-1])
        if size >= block or size and i == len(texts) - 1:
            rows, owner = np.concatenate(held), np.concatenate(owners)
            whole = size if i == len(texts) - 1 else size - size % block
            for at in range(0, whole, block):
                read(rows[at : min(at + block, whole)], owner[at : min(at + block, whole)])
            held, owners, size = ([rows[whole:]], [owner[whole:]], size - whole) if whole < size else ([], [], 0)
    if size:
        read(np.concatenate(held), np.concatenate(owners))
    sums = totals.sum(1)
    return [totals[i] / sums[i] if lengths[i] and sums[i] > 0 else None for i in range(len(texts))]


def loss_and_gradients(p: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions that are no filling bytes, and its derivatives by backpropagation through time.

    p: inputs (2, 3, 256, H), recurrent (2, 3, H, H), out (2, H, L), bias (L)."""
    kind, n, hidden = p["inputs"].dtype, len(windows), p["recurrent"].shape[-1]
    columns = np.ascontiguousarray(windows.T).astype(np.intp)
    kept = np.empty((2, 4, WINDOW, n, hidden), kind)  # z, r, rec, c
    states = np.zeros((2, WINDOW + 1, n, hidden), kind)  # the last is where either direction begins
    for d, order in enumerate(ORDERS):
        before = WINDOW
        for t in order:
            step(columns[t], states[d, before], p["inputs"][d], p["recurrent"][d], *kept[d, :, t], states[d, t])
            before = t
    logits = np.stack([sum(p["out"][d].T @ states[d, t].T for d in (0, 1)) for t in range(WINDOW)], 1) + p["bias"][:, None, None]
    q = softmax(logits)
    real = (columns != 0).astype(kind)
    real /= max(1.0, real.sum())
    own = np.arange(n)
    loss = -float((np.log(np.maximum(q[labels, :, own].T, 1e-30)) * real).sum())
    q[labels, :, own] -= 1
    q *= real
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"] = q.sum((1, 2))
    order_of_bytes = np.argsort(columns, axis=None, kind="stable")
    in_order = columns.ravel()[order_of_bytes]
    starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    for d, order in enumerate(ORDERS):
        gates = np.empty((3, WINDOW, n, hidden), kind)
        back = np.zeros((n, hidden), kind)
        u = p["recurrent"][d]
        for k in range(WINDOW - 1, -1, -1):
            t = order[k]
            state, (z, r, rec, c) = states[d, order[k - 1] if k else WINDOW], kept[d, :, t]
            g["out"][d] += states[d, t].T @ q[:, t].T
            back += (p["out"][d] @ q[:, t]).T
            gates[0, t] = back * (c - state) * z * (1 - z)
            gates[2, t] = gc = back * z * (1 - c * c)
            gates[1, t] = gc * rec * r * (1 - r)
            grec = (gates[0, t], gates[1, t], gc * r)
            back *= 1 - z
            for j in range(3):
                g["recurrent"][d, j] += state.T @ grec[j]
                back += grec[j] @ u[j].T
        for j in range(3):
            g["inputs"][d, j][in_order[starts]] = np.add.reduceat(gates[j].reshape(-1, hidden)[order_of_bytes], starts)
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 5) -> Network:
    """Adam, with gradients clipped to a norm of 1 and a rate that falls over the last two thirds."""
    rng = np.random.default_rng(seed)
    h, n_lang = HIDDEN, len(languages)
    p = {"inputs": rng.normal(0, 0.3, (2, 3, 256, h)), "recurrent": rng.normal(0, h**-0.5, (2, 3, h, h)), "out": rng.normal(0, (2 * h) ** -0.5, (2, h, n_lang)), "bias": np.zeros(n_lang)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for k in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
        _, g = loss_and_gradients(p, windows[pick], labels[pick])
        norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
        for name in p:
            a = g[name] * min(1.0, 1.0 / max(norm, 1e-12))
            m[name] = 0.9 * m[name] + 0.1 * a
            v[name] = 0.999 * v[name] + 0.001 * a * a
            p[name] = (p[name] - RATE * min(1.0, 3 * (1 - k / (STEPS + 1))) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return Network(languages, **p)


def held_out(doc_id: str = "doc_id"):
    """True for one document in five, which training never sees."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit_on(docs: DataFrame) -> Network | None:
    """The network of a bounded sample of documents that are not held out and have a language; None where there are none. Rows of one doc_id and language count once, by
    the text whose sample is least."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n_lang, letters = counts.agg(F.count(F.lit(1)), F.sum(F.octet_length("lang"))).first()
    if not n_lang:
        return None
    if 16 * n_lang + letters <= SMALL:
        counts = F.broadcast(counts)
    each = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // n_lang))
    # About three times as many as are wanted of each language, by hash; only those are ranked.
    share = 3.0 * each / F.col("rows")
    few = usable.select("doc_id", "lang").join(counts, "lang").where((F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)) < share).select("doc_id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = few.withColumn("place", place).where(F.col("place") <= each).select(F.col("doc_id").alias("_of"), F.col("lang").alias("_lang"))
    ids = cut(ids.orderBy(F.xxhash64("_of")).limit(SAMPLE_TOTAL)) if n_lang > SAMPLE_TOTAL else cut(ids)
    # SAMPLE_TOTAL rows at most, so the broadcast is bounded
    picked = usable.join(F.broadcast(ids), (F.col("doc_id") == F.col("_of")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")

    def sample(cols: dict) -> dict:
        found = []
        for text in cols["text"]:
            rows = windows_of(clean(text))
            at = sorted({k * len(rows) // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)}) if len(rows) else []
            found.append(b"".join(rows[k].tobytes() for k in at))
        return {"doc_id": cols["doc_id"], "lang": cols["lang"], "data": found}

    sampled = map_batches(picked, sample, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, data binary").where("length(data) > 0").groupBy("doc_id", "lang").agg(F.min("data").alias("data"))
    rows = sampled.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")]).to_pylist()
    if not rows:
        return None
    languages = tuple(sorted({r["lang"] for r in rows}))
    data = [windows_of(r["data"]) for r in rows]
    return train(np.concatenate(data), np.repeat([languages.index(r["lang"]) for r in rows], [len(d) for d in data]), languages)


def predict_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. A null text, a text without a letter, or no network: `und` with score 0. Equal probabilities go by language. Repeated rows stay; only doc_id and text are read."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some 100 kB

    def predict(cols: dict) -> dict:
        net = sent.value
        found = document_probabilities(net, cols["text"]) if net else [None] * len(cols["text"])
        best = [None if p is None else int(p.argmax()) for p in found]
        return {"doc_id": cols["doc_id"], "lang_pred": [UNKNOWN if b is None else net.languages[b] for b in best], "score": [0.0 if b is None else float(min(1.0, p[b])) for p, b in zip(found, best, strict=True)]}

    made = map_batches(docs.select("doc_id", "text"), predict, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
    return made.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
