"""Near-duplicate documents by MinHash and an LSH forest, confirmed on full shingle sets.

1. Every text gives its set of distinct shingles (64-bit hashes), and of those a signature: `TREES` keys of `DEPTH` minima each, and a
   sketch of further minima. Texts with equal sets are one class from here on, whatever their number.
2. The forest: each tree is all classes in the order of its key, dealt out by range, so that no region is too large for a task.
   Neighbours in that order have the longest common prefixes. Each class looks back at its `REACH` nearest and at the first classes of the
   regions that it is in, as long as `LEAST_DEPTH` minima agree. So depth adapts to the region: in a crowded one the
   neighbours agree deeply, in a sparse one they are as far as the least depth. The sketch only tells which are confirmed first.
3. First round: for each class the two likeliest candidates are confirmed on full sets, and components formed. It only saves work.
   Second round: of all pairs of classes that share the first `LEAST_DEPTH` minima of a tree and are still in different components, those
   that `apart` does not prove unlike are confirmed, with no bound on their number or on the size of a region: regions are compared in blocks of
   `BLOCK`. A large group of near copies is one component after the first round and is not compared with itself in the second.
4. Components by alternating star contractions (large star, small star), each one aggregate and one join.

Only the texts of classes with candidates are shuffled: a bitmap of fixed size lets the map side leave out nearly all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, pa_schema

#: Trees, minima in a key, minima in a sketch.
TREES, DEPTH, SKETCH = 16, 8, 128
#: Minima that neighbours share at least, and how far back a class looks.
LEAST_DEPTH, REACH = 3, 32
#: Depths whose regions' first classes are candidates too.
LEADERS = (3, 5, 8)
#: Rows of a tree handled at once.
CHUNK = 50_000
#: Classes of a region that are compared with as many others at once.
BLOCK = 1024
#: Rows of a table of regions that is broadcast.
MOST_BROADCAST = 250_000
#: Bits of a set's parity bitmap.
PARITY = 2048
#: Bits of the bitmap of ids.
BITMAP_BITS = 1 << 22
_SLOTS = TREES * DEPTH + SKETCH
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 63, _SLOTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, _SLOTS, dtype=np.uint64)
_PLACE = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles: A-Z lower-cased, words between ASCII white space; fewer words than a shingle has are one shingle."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return mixed(np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], np.uint64))
    n = len(h) - words + 1
    return np.unique(mixed(sum(h[k : k + n] * _PLACE[k] for k in range(words))))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=least)
    return least


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap that tells for each of `PARITY` buckets of shingles whether their number is odd."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def apart(n_x: np.ndarray, n_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the number of shingles that are in one set only, for each of x with each of y (sizes and bitmaps as rows of uint64). Each such
    shingle changes one bit, so bitmaps never differ in more."""
    return np.maximum(np.bitwise_count(x[:, None] ^ y[None]).sum(2, dtype=np.int64), np.abs(n_x[:, None] - n_y[None]))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """_id, n_shingles, set_key, keys, sketch and bits of each row; the last four are null for texts without words."""

    def run(cols: dict, known: WordHashes) -> dict:
        out: dict[str, list] = {"_id": cols["_id"], "n_shingles": [], "set_key": [], "keys": [], "sketch": [], "bits": []}
        for text in cols["text"]:
            h = shingles(text, words, known)
            out["n_shingles"].append(len(h))
            least = mixed(signature(h)) if len(h) else None
            out["set_key"].append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            out["keys"].append((least[: TREES * DEPTH] >> np.uint64(48)).astype(">u2").tobytes() if len(h) else None)
            out["sketch"].append((least[TREES * DEPTH :] >> np.uint64(56)).astype(np.uint8).tobytes() if len(h) else None)
            out["bits"].append(parity(h) if len(h) else None)
        return out

    return map_batches(docs.select("_id", "text"), run, "_id long, n_shingles long, set_key binary, keys binary, sketch binary, bits binary", WordHashes)


def least_likeness(threshold: tuple[int, int]) -> float:
    """The sketch likeness of candidates of the first round. A pair at the threshold falls below with a probability of about 1 in 2,000, and is
    then left to the second round, which does not ask the sketch."""
    t = threshold[0] / threshold[1]
    return t - 3.5 * float(np.sqrt(t * (1 - t) / SKETCH))


def forest(classes: DataFrame, plausible: float) -> DataFrame:
    """Candidates (_id, other, likeness) from all trees: for each class and tree the likeliest neighbour before it, the likeliest after it,
    and the likeliest leader."""
    width = 2 * DEPTH
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("tree", F.expr(f"substring(keys, tree * {width} + 1, {width})").alias("key"), "_id", "sketch")
    schema = "_id long, other long, likeness float"
    types = pa_schema(classes.sparkSession, schema)
    leaders = [d for d in LEADERS if d >= LEAST_DEPTH]

    def candidates(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, old: int) -> pa.RecordBatch | None:
        n = len(ids)
        here = np.arange(n)
        firsts = []
        changed = np.concatenate([[True], tree[1:] != tree[:-1]])
        for d in range(DEPTH):
            changed = changed | np.concatenate([[True], key[1:, d] != key[:-1, d]])
            if d + 1 in leaders:
                firsts.append(np.maximum.accumulate(np.where(changed, here, 0)))
            if d + 1 == LEAST_DEPTH:
                region = np.cumsum(changed)
        kinds = []  # of the candidates: positions, others, whether they are leaders
        for lag in range(1, min(REACH, n - 1) + 1):
            i = here[lag:][region[lag:] == region[:-lag]]
            if not len(i):
                break
            kinds.append((i, i - lag, False))
        kinds += [(i := np.flatnonzero(here - first > REACH), first[i], True) for first in firsts]
        found = []
        for i, j, leads in kinds:
            i, j = i[i >= old], j[i >= old]
            like = ((sketch[i] == sketch[j]).mean(1) - 1 / 256) * (256 / 255)
            fits = like >= plausible
            found.append((i[fits], j[fits], like[fits], np.full(int(fits.sum()), leads)))
        i, j, like, leads = (np.concatenate([f[k] for f in found]) for k in range(4)) if found else (np.zeros(0, int),) * 4
        if not len(i):
            return None
        best = np.zeros(len(i), bool)
        for near, far in ((i, j), (j, i)):
            order = np.lexsort((ids[far], -like, leads, near))
            own, kind = near[order], leads[order]
            first = np.concatenate([[True], (own[1:] != own[:-1]) | (kind[1:] != kind[:-1])])
            best[order[first & ~kind | first & (near is i)]] = True
        i, j, like = i[best], j[best], like[best]
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(like.astype(np.float32))], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size, old = 0, 0

        def arrays(batch: pa.RecordBatch) -> tuple:
            n = batch.num_rows
            ids = batch.column(2).to_numpy()
            return (
                batch.column(0).to_numpy(),
                np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, DEPTH),
                ids,
                np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, SKETCH),
            )

        for batch in batches:
            if batch.num_rows:
                kept.append(arrays(batch))
                size += batch.num_rows
            if size >= CHUNK:
                joined = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                if (got := candidates(*joined, old)) is not None:
                    yield got
                kept = [tuple(x[-REACH:] for x in joined)]  # the next rows look back at these
                size = old = len(kept[0][0])
        if size > old:
            joined = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            if (got := candidates(*joined, old)) is not None:
                yield got

    # The id is part of the order, so that classes of one key, however many, are dealt out too.
    return rows.repartitionByRange("tree", "key", "_id").sortWithinPartitions("tree", "key", "_id").mapInArrow(run, schema)


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has no more than `MOST_BROADCAST` rows (of a few numbers each); then a region of any size stays where it is. Beyond, Spark's own skew join splits it."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def in_regions(classes: DataFrame, threshold: tuple[int, int], rows: int) -> DataFrame:
    """All pairs (a, b, ca, cb, likeness) of classes that agree in `LEAST_DEPTH` minima of a tree, are in different components ca and cb, and
    may be links: the likeness, an upper bound, reaches the threshold. A pair is there once for each such tree.

    The largest component of a region is dealt into blocks of `BLOCK`, its other classes into blocks of their own. These meet each other
    and those of the largest component, which do not meet among themselves."""
    width, depth = 2 * DEPTH, 2 * LEAST_DEPTH
    regions = classes.select("_id", "component", F.expr(f"explode(transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(keys, t * {width} + 1, {depth}))))").alias("region"))
    mixed_ones = cut(regions.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region"), rows)
    members = cut(regions.join(small(mixed_ones), "region", "left_semi"), rows)
    sizes = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    sizes = sizes.select("region", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("mains"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("others"))
    in_main, place = F.col("component") == F.col("main"), F.xxhash64("_id", F.lit(1))
    dealt = members.join(small(cut(sizes, rows)), "region").withColumn("block", F.when(in_main, F.pmod(place, "mains")).otherwise(F.col("mains") + F.pmod(place, "others")))
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(F.lit(0)), F.expr("mains + others - 1"))))
    dealt = dealt.select("region", F.least("block", "meets").alias("p"), F.greatest("block", "meets").alias("q"), "block", "_id", "component")
    full = dealt.join(classes.select("_id", "n_shingles", "bits"), "_id").select("region", "p", "q", "block", "_id", "component", "n_shingles", "bits")
    schema = "a long, b long, ca long, cb long, likeness float"
    types = pa_schema(classes.sparkSession, schema)

    num, den = threshold

    def pairs(block: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        """Of one (region, p, q), the rows in order of block."""
        first = np.flatnonzero(block == block[0])
        second = np.flatnonzero(block != block[0])
        alone = not len(second)
        second = first if alone else second
        step = max(1, 8192 // len(second))
        for at in range(0, len(first), step):
            x = first[at : at + step]
            differ, both = apart(n[x], n[second], bits[x], bits[second]), n[x][:, None] + n[second][None]
            fits = (differ * (den + num) <= both * (den - num)) & (component[x][:, None] != component[second][None])
            if alone:
                fits &= x[:, None] < second[None]
            i, j = np.nonzero(fits)
            if len(i):
                like, i, j = ((both - differ) / (both + differ))[i, j], x[i], second[j]
                swap = ids[i] < ids[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield ids[i], ids[j], component[i], component[j], like.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            size = sum(b.num_rows for b in held)
            if not size or batch is not None and size < CHUNK // 10:
                continue
            joined = pa.Table.from_batches(held).combine_chunks()
            region, p, q, block, ids, component, n = (joined.column(k).to_numpy() for k in range(7))
            bits = np.frombuffer(b"".join(joined.column(7).to_pylist()), np.uint64).reshape(size, -1)
            starts = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            ends = np.concatenate([starts[1:], [size]])
            last = len(starts) if batch is None else len(starts) - 1  # the last one may go on in the next batch
            found: list[tuple] = []
            n_found = 0
            for start, end in zip(starts[:last], ends[:last], strict=True):
                if component[start:end].min() == component[start:end].max():
                    continue
                for got in pairs(block[start:end], ids[start:end], component[start:end], n[start:end], bits[start:end]):
                    found.append(got)
                    n_found += len(got[0])
                    if n_found >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=types)
                        found, n_found = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=types)
            held = [] if batch is None else joined.slice(starts[-1]).to_batches()

    return full.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q", "block", "_id").mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose full sets are alike enough, with linked true; the others with linked false."""
    left = texts.select(F.col("_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    num, den = threshold

    def check(cols: dict, state: tuple[WordHashes, dict]) -> dict:
        known, sets = state

        def of(i: int, text: str) -> np.ndarray:
            if i not in sets:
                if len(sets) >= 512:
                    sets.clear()
                sets[i] = shingles(text, words, known)
            return sets[i]

        linked = []
        for a, b, s, t in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
            x, y = of(a, s), of(b, t)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(den * common >= num * (len(x) + len(y) - common))
        return {"a": cols["a"], "b": cols["b"], "linked": linked}

    return map_batches(both, check, "a long, b long, linked boolean", lambda: (WordHashes(), {}))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(_id, component) of every node of edges (a, b): component is the smallest node that can be reached. With rounds, that many
    contractions at most; components may then still be parts of the true ones."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    seen, n = None, edges.count()
    while rounds is None or rounds > 0:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct(), n)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        rounds = None if rounds is None else rounds - 1
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "_id")
    return stars.union(stars.select("component").distinct().select(F.col("component").alias("_id"), "component")).groupBy("_id").agg(F.min("component").alias("component"))


def pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def only_needed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(_id, text) of the rows of docs whose _id is in needed. Their bits in a bitmap of fixed size are looked up before the shuffle; the join is exact."""
    bit = F.pmod(F.xxhash64("_id"), F.lit(BITMAP_BITS))
    parts = needed.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")).collect()
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts:  # BITMAP_BITS / 32768 rows at most
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[row["part"] * 4096 : row["part"] * 4096 + len(own)] |= own
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            hit = (sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_id", "text"]).filter(pa.array(hit.astype(bool)))

    return docs.select("_id", "text", bit.alias("bit")).mapInArrow(run, "_id long, text string").join(needed, "_id", "left_semi")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if their sets' intersection is threshold (a fraction) of their union or more; component_id is the smallest doc_id that can be
    reached over links, and kept tells that it is the row's own. Texts that are null or have no words have no shingles and link with
    nothing. Rows with one doc_id are one document, compared by the least of its texts. Rows with a null doc_id are in no group: their component_id is
    null, and they are kept. An empty table gives an empty one; other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    repeated = cut(keyed.where("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"))
    if not repeated.head(1):
        return grouped(keyed, words, threshold)
    rows = keyed.join(repeated, "_id", "left_semi")
    found = cut(grouped(keyed.join(repeated, "_id", "left_anti").union(rows.groupBy("_id").agg(F.min("text").alias("text"))), words, threshold))
    each = rows.select("_id").join(found, F.col("_id") == F.col("doc_id")).select(*found.columns)
    return found.join(repeated, F.col("doc_id") == F.col("_id"), "left_anti").union(each)


def grouped(keyed: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """The same for _id and text, of which no id but null comes twice."""
    signed = cut(signatures(keyed, words))
    n = signed.count()
    classes = cut(signed.where("set_key IS NOT NULL AND _id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("_id", "n_shingles", "keys", "sketch", "bits")).alias("s")).select("set_key", "s.*"), n)
    plausible = least_likeness(threshold)

    def check(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        texts = only_needed(keyed, cut(needed, n))
        return cut(confirmed(pairs, cut(texts, n), words, threshold), pairs.count(), 2000)

    found = cut(forest(classes, plausible).groupBy("_id", "other").agg(F.max("likeness").alias("likeness")), n)
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("likeness"), "other"))  # of 3 * TREES rows at most
    first = cut(found.withColumn("place", place).where("place <= 2").select(*pair("_id", "other")).distinct(), n)
    checked = check(first)

    joined = components(checked.where("linked").select("a", "b"))
    open_ = cut(classes.join(joined, "_id", "left").withColumn("component", F.coalesce("component", "_id")), n)
    rest = in_regions(open_, threshold, n).groupBy("a", "b").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"), F.max("likeness").alias("likeness"))
    rest = cut(rest.join(checked.select("a", "b"), ["a", "b"], "left_anti"), n)
    # the likeliest pair of two components first: where it is a link, their other pairs need no confirmation
    likeliest = cut(rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("likeness", "a", "b")).alias("s")).select("s.a", "s.b"), n)
    checked = cut(checked.union(check(likeliest)), n)
    joined = components(checked.where("linked").select("a", "b"))
    for own, other in (("a", "ca"), ("b", "cb")):
        rest = rest.join(joined.select(F.col("_id").alias(own), F.col("component").alias(f"now_{other}")), own, "left")
    still = F.coalesce("now_ca", "a") != F.coalesce("now_cb", "b")
    more = check(cut(rest.where(still).select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti"), n))

    final = cut(components(checked.union(more).where("linked").select("a", "b")), n)
    labelled = cut(classes.select("set_key", "_id").join(final, "_id", "left").select("set_key", F.coalesce("component", "_id").alias("component")), n)
    # Texts without words have no class; a key of their own each keeps them out of one task.
    rows = signed.select("_id", "n_shingles", F.coalesce("set_key", F.concat(F.lit("-").cast("binary"), F.col("_id").cast("string").cast("binary"))).alias("set_key")).join(labelled, "set_key", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return rows.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the documents that another one of their group stands for; rows that stay are unchanged, whatever their columns are called."""
    gone = near_duplicates(docs, words, threshold).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
