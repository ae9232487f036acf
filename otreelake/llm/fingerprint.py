"""Document fingerprints as improbable-feature digests.

Features are 64-byte windows of the UTF-8 text. A window's entropy falls into one of 1,001 levels, and a level's rank is its rarity: how
few windows of the whole corpus have it. Every run of 64 neighbouring windows votes for its leftmost rarest one; windows with
enough votes are the text's features. Their hashes go, in order, into Bloom filters of 2,048 bits, a new one after every 160 features. Two
digests are as alike as the bits their filters share beyond what chance would give, averaged over the shorter chain's filters, each
against the best of the other.

Entropies come from running byte counts in integer arithmetic, so equal texts have equal digests whatever batch they come in.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, small_batches

WINDOW, RUN, VOTES, LEVELS = 64, 64, 16, 1001
#: Runs of a text looked at together: what long texts need at once. Each has its own running counts, which are whole numbers, so nothing depends on it.
SEGMENT = 1 << 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5

_counts = np.arange(WINDOW + 2, dtype=float)
#: c * log2(c) for counts up to the window, in fixed point, and its differences.
_CLOG = np.round(_counts * np.log2(np.maximum(_counts, 1)) * (1 << 32)).astype(np.int64)
_STEP = np.diff(_CLOG)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)
_TOP = int(_CLOG[WINDOW])


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of every window of a byte array (of WINDOW bytes or more)."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    # Positions by byte, then place; a byte's count among its 63 predecessors is a difference of places in this order.
    key = data[order].astype(np.int64) * (n + 2 * WINDOW) + order
    at = np.arange(n)
    before = np.empty(n, np.int64)
    before[order] = at - np.searchsorted(key, key - (WINDOW - 1))
    after = np.empty(n, np.int64)
    after[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - 1 - at
    first = int(_CLOG[np.bincount(data[:WINDOW], minlength=256)].sum())
    moves = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(moves)])
    return ((_TOP - total) * (LEVELS - 1) // _TOP).astype(np.int64)


def features(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the text's features, in order, each once. A text shorter than a window is one feature; an empty one has none."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if len(raw) < WINDOW:
        chosen = np.zeros((1, WINDOW), np.uint8)
        chosen[0, : len(raw)] = raw
        return hashes(chosen)
    windows = len(raw) - WINDOW + 1
    run = min(RUN, windows)
    runs = windows - run + 1
    votes = np.zeros(windows, np.uint8)  # RUN at most
    for start in range(0, runs, SEGMENT):
        some = min(SEGMENT, runs - start)
        level = levels(raw[start : start + some + run - 1 + WINDOW - 1])
        n = len(level)
        # Smaller is rarer, then more to the left.
        vote = ranks[level] * n + np.arange(n)
        span = 1
        while span < run:
            step = min(span, run - span)
            vote = np.minimum(vote[:-step], vote[step:])
            span += step
        votes[start : start + n] += np.bincount(vote % n, minlength=n).astype(np.uint8)
    places = np.flatnonzero(votes >= min(VOTES, runs))
    found = [hashes(raw[places[at : at + 4096, None] + np.arange(WINDOW)]) for at in range(0, len(places), 4096)]
    h = np.concatenate([np.zeros(0, np.uint64), *found])
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def hashes(chosen: np.ndarray) -> np.ndarray:
    """Of windows as rows of bytes."""
    h = (chosen.astype(np.uint64) + np.uint64(1)) @ _POWERS
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def digest(data: bytes, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters as rows of bits, and how many features each has."""
    h = features(data, ranks)
    chain = np.arange(len(h)) // PER_FILTER
    bits = np.zeros((int(chain[-1]) + 1 if len(h) else 0, FILTER_BITS), bool)
    for k in range(HASHES):
        bits[chain, (h >> np.uint64(64 - 11 * (k + 1))) & np.uint64(FILTER_BITS - 1)] = True
    return bits, np.bincount(chain, minlength=len(bits)) if len(h) else np.zeros(0, int)


def text_of(made: tuple[np.ndarray, np.ndarray]) -> str:
    """A digest as a string: for each filter its number of features and its bits; empty for an empty text."""
    return "|".join(f"{n}.{base64.b64encode(row.tobytes()).decode()}" for row, n in zip(np.packbits(made[0], axis=1), made[1].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two empty digests are alike."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return float(not len(b[0]))
    y = b[0].astype(np.float32)
    ny = y.sum(1)[None, :]
    best = []
    for at in range(0, len(a[0]), 256):
        x = a[0][at : at + 256].astype(np.float32)
        common, nx = x @ y.T, x.sum(1)[:, None]
        by_chance = nx * ny / FILTER_BITS
        most = np.minimum(nx, ny)
        best.append(np.clip((common - by_chance) / np.maximum(most - by_chance, 1e-9), 0, 1).max(1))
    return float(np.average(np.concatenate(best), weights=a[1]))


def level_counts(docs: DataFrame) -> np.ndarray:
    """Windows of the corpus by entropy level: a count of fixed size from every task, added up."""
    schema = "level int, n bigint"
    types = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = np.frombuffer((text or "").encode(), np.uint8)
                for at in range(0, len(raw) - WINDOW + 1, SEGMENT):
                    counts += np.bincount(levels(raw[at : at + SEGMENT + WINDOW - 1]), minlength=LEVELS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], schema=types)

    counts = np.zeros(LEVELS, np.int64)
    for row in docs.select("text").mapInArrow(run, schema).groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of every level: 0 for the rarest; of levels with equal counts the higher entropy is rarer."""
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((-np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return ranks


def id_blocks(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Blocks of neighbours in the order of `_id`, then `_h`, none much larger than others: the block of a row, and of every block the first place with the block before it.

    The bounds are percentiles of the ids; a block between two bounds is cut into equal stretches where the table is large. An id that several percentiles fall on has many rows; they
    are cut into as many slices by their hashes. Only the blocks' first places reach the driver, for 2^18 blocks of different ids at most."""
    ids = docs.select("_id")
    n = ids.count()
    coarse = min(1024, max(1, n // 200))
    fine = max(1, min(256, n // (1024 * 20_000)))
    percentiles = ids.agg(F.percentile_approx("_id", [k / coarse for k in range(coarse + 1)], 10 * coarse)).first()[0] or [0]
    bounds = sorted(set(percentiles))
    often = {i: k for i, k in Counter(percentiles).items() if k > 1}
    listed = F.lit(bounds).cast("array<bigint>")
    place = F.greatest(F.lit(1), F.least(F.size(F.filter(listed, lambda b: b <= F.col("_id"))), F.lit(len(bounds))))
    low, high = F.element_at(listed, place).cast("double"), F.coalesce(F.get(listed, place), F.element_at(listed, place) + 1).cast("double")
    inside = F.least(F.greatest(F.floor((F.col("_id") - low) / F.greatest(high - low, F.lit(1.0)) * fine), F.lit(0)), F.lit(fine - 1))
    slices = max(often.values(), default=0)
    block = place * fine + inside
    if often:
        count = F.element_at(F.create_map(*(F.lit(x).cast("bigint") for pair in often.items() for x in pair)), F.col("_id"))
        part = F.least(F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * count), count - 1)
        block = block * (slices + 1) + F.coalesce(part, F.lit(slices))  # other ids come after the one that the block begins with
    block = block.cast("bigint")
    firsts = [(r["block"], r["first"]["_id"], r["first"]["_h"]) for r in docs.select("_id", "_h", block.alias("block")).groupBy("block").agg(F.min(F.struct("_id", "_h")).alias("first")).orderBy("block").collect()]
    heads = [(i, h, firsts[k - 1][0]) for k, (_, i, h) in enumerate(firsts)]
    return block, docs.sparkSession.createDataFrame(heads, "_head bigint, _hash bigint, _before bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text digest, and with the next document: the edited text, its digest, and two likenesses.

    The next document is that with the next higher doc_id (after the last: the first; a null id comes before all; equal ids go by a
    hash of the text, then by text). The edited text has its last half of code points replaced by the first as many (or all) of the next. Null texts are empty.
    Repeated rows stay; other columns are not read; an empty table gives an empty one.

    Each text is shuffled once, to the block of its id; the first of a block also goes to the block before, where it only serves as the next.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    ranks = rarity(level_counts(keyed))
    block, heads = id_blocks(keyed)
    mine = F.struct(block.alias("block"), F.lit(False).alias("tail"))
    to = F.when(F.col("_before").isNull(), F.array(mine)).otherwise(F.array(mine, F.struct(F.col("_before").alias("block"), F.lit(True).alias("tail"))))
    placed = keyed.join(F.broadcast(heads), (F.col("_id") == F.col("_head")) & (F.col("_h") == F.col("_hash")), "left").select("_id", "_h", "doc_id", "text", F.explode(to).alias("to")).select("to.block", "to.tail", "_id", "_h", "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = pa_schema(docs.sparkSession, schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # block, id, text and digest of the row that waits for its next
        for batch in batches:
            rows = []
            for block, tail, _, _, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and (held is None or held[0] != block):
                    continue  # equal smallest ids: the first of them was the next
                own = digest(text.encode(), ranks)
                if held is not None and held[0] == block:
                    half = len(held[2]) // 2
                    edited = held[2][: len(held[2]) - half] + text[:half]
                    other = digest(edited.encode(), ranks)
                    rows.append((held[1], held[2], edited, text_of(held[3]), text_of(other), likeness(held[3], other), likeness(held[3], own)))
                held = None if tail else (block, doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return placed.repartition("block").sortWithinPartitions("block", "tail", "_id", "_h", "text").mapInArrow(run, schema)
