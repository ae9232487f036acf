"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, and the mix is the server. A document's virtual finish
time is the number of its source's words up to and with it, divided by the source's target. All queues are served at
rates in proportion to their targets, so at virtual time v each source has had v times its target. All documents are sorted by finish
time, globally, and the order is truncated where its words reach the total budget, at virtual time 1. The one document of each source
that is in service at that moment is dealt into packets of `PACKET` words with finish times of their own, so no source departs from its
target by more than a packet.

A source whose target is above its size is read again, up to `max_repeats` times, in the same order.

The running sums have two levels: a window inside (source, hash bucket) and sums over the bucket totals, so a source with any share
of the rows is spread over all tasks. The buckets are equal slices of the md5 of doc_id and text and need no sampling of
the data, so reruns and retried tasks agree. The order is made of numbers only; of it, the place of the last packet reaches the driver,
and every document tells by itself which of its copies come before that place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut, n_words

#: Weights of the sources by code point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """totals (source, source_size) with each source's weight and target.

    The shares are by weight; a target stops at max_repeats times the source's size, and the excess is shared again
    by weight. Each round is one aggregate, and only two sums reach the driver."""
    ranked = cut(source_ranks(totals).withColumn("weight", F.element_at(F.lit(list(weights)).cast("array<long>"), (F.col("rank") % len(weights) + 1).cast("int"))))
    most = F.col("source_size") * F.lit(max_repeats)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = most <= F.col("weight") * F.lit(level)
        filled, rest = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest or (raised := (budget_share * total - (filled or 0)) / rest) <= level:
            break
        level = raised
    return ranked.select("source", "source_size", "weight", F.least(most.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def source_ranks(totals: DataFrame) -> DataFrame:
    """rank: 0 for the first source by code point; null comes last. Range partitions are numbered and counted first, so no task gets all sources."""
    order = [F.col("source").asc_nulls_last()]
    slices = cut(totals.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    # A count for each slice, and there are as many slices as shuffle partitions: a small table, whatever the number of sources.
    before, total = [], 0
    for row in slices.groupBy("slice").count().orderBy("slice").collect():
        before.append((row["slice"], total))
        total += row["count"]
    before = slices.sparkSession.createDataFrame(before, "slice int, before long")
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    return slices.withColumn("inside", inside).join(F.broadcast(before), "slice").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("slice", "inside", "before")


#: Words of the packets into which the document is dealt that each source has in service at virtual time 1.
PACKET = 16


@dataclass(frozen=True)
class Cut:
    """Where the mix ends: the place in the order of the last packet that is taken, and the words that are taken of it."""

    finish: float
    source: str
    key: str
    copy: int
    packet: int
    words: int


def keyed(docs: DataFrame, seed: int, n: int) -> DataFrame:
    """docs (c0, c1, ... with _doc, _of and _text) with _size, _s (the source as a key without null), _key (the place in the shuffled order, from id and text) and _bucket."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_doc").cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    made = docs.withColumns({"_size": n_words(F.col("_text")), "_s": F.coalesce(F.concat(F.lit("s"), F.col("_of")), F.lit("t")), "_key": key})
    return made.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int"))


def placed(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    """Rows with _start: the words of their source before them. Rows are dealt once, by source and bucket."""
    inside = F.sum("_size").over(Window.partitionBy("_s", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", inside).join(ahead, ["_s", "_bucket"]).withColumn("_start", F.col("_ahead") + F.col("_upto") - F.col("_size")).drop("_upto", "_ahead")


def finish(words: Column) -> Column:
    """The virtual time at which a source has been served so many words; null where its target is 0."""
    return F.try_divide(words.cast("double"), F.col("_target"))


def packets(max_repeats: int) -> Column:
    """A document's copies as (copy, packet, finish, words). The one that is in service at virtual time 1 comes in packets of `PACKET` words, the others whole."""

    def of(copy: Column) -> Column:
        start = F.col("_start") + F.col("_source_size") * copy
        whole = F.array(F.struct(copy.alias("copy"), F.lit(0).alias("packet"), finish(start + F.col("_size")).alias("finish"), F.col("_size").alias("words")))

        def dealt(k: Column) -> Column:
            upto = F.least(F.col("_size"), (k + 1).cast("long") * PACKET)
            return F.struct(copy.alias("copy"), k.alias("packet"), finish(start + upto).alias("finish"), (upto - k.cast("long") * PACKET).alias("words"))

        split = (start < F.col("_target")) & (start + F.col("_size") > F.col("_target"))
        last = F.ceil(F.col("_size") / F.lit(PACKET)).cast("int") - 1
        return F.when(split, F.transform(F.sequence(F.lit(0), last), dealt)).otherwise(whole)

    return F.flatten(F.transform(F.array(*(F.lit(k) for k in range(max_repeats))), of))


def truncation(numbers: DataFrame, budget: int, max_repeats: int) -> Cut | None:
    """All packets in the order of their finish times, and where their words reach the budget; None if they do not.

    The order is made by range partitions; their sums tell in which of them the budget ends, and only that one is summed up row by row. One row reaches the driver for each partition."""
    order = ["finish", "_s", "_key", "copy", "packet"]
    queue = numbers.where("_target > 0").select("_s", "_key", F.explode(packets(max_repeats)).alias("p")).select("p.finish", "_s", "_key", "p.copy", "p.packet", "p.words").where("words > 0")
    queue = cut(queue.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    before = 0
    for row in queue.groupBy("_slice").agg(F.sum("words").alias("words")).orderBy("_slice").collect():
        if before + row["words"] >= budget:
            upto = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            last = queue.where(F.col("_slice") == row["_slice"]).withColumn("upto", upto + F.lit(before)).where(F.col("upto") >= budget).orderBy(*order).first()
            return Cut(*(last[c] for c in order), last["words"] - (last["upto"] - budget))
        before += row["words"]
    return None


def served(packet: Column, end: Cut | None) -> Column:
    """The words that the mix takes of a packet."""
    if end is None:
        return packet["words"]
    place = F.struct(packet["finish"], F.col("_s"), F.col("_key"), packet["copy"], packet["packet"])
    last = F.struct(F.lit(end.finish), F.lit(end.source), F.lit(end.key), F.lit(end.copy), F.lit(end.packet))
    return F.when(place < last, packet["words"]).when(place == last, F.lit(end.words)).otherwise(F.lit(0)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...], budget_share: float, max_repeats: int, seed: int) -> tuple[DataFrame, Cut | None, Column]:
    """docs under names of our own, placed in their queues; where the mix ends; and each row's packets (none where the source has no target)."""
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = rows.withColumns({"_doc": F.col(named["doc_id"]), "_of": F.col(named["source"]), "_text": F.col(named["text"])})
    n = buckets_for(docs.count())
    numbers = cut(keyed(rows.select("_doc", "_of", "_text"), seed, n).select("_of", "_s", "_bucket", "_key", "_size"))
    parts = cut(numbers.groupBy("_of", "_s", "_bucket").agg(F.sum("_size").alias("words")))
    totals = parts.groupBy("_of", "_s").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals.select(F.col("_of").alias("source"), "source_size"), weights, budget_share, max_repeats)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each source and bucket at most.
    ahead = cut(parts.withColumn("_ahead", earlier).join(targets, "_s").select("_s", "_bucket", "_ahead", "_source_size", "_target"))
    total = parts.agg(F.sum("words")).first()[0] or 0
    end = truncation(placed(numbers, ahead), math.floor(min(budget_share, max_repeats) * total), max_repeats)
    copies = F.when(F.col("_target") > 0, packets(max_repeats)).otherwise(F.slice(packets(max_repeats), 1, 0))
    return placed(keyed(rows, seed, n), ahead), end, copies


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """docs (doc_id, source, text and any other columns) with size, source_size, target, finish and taken.

    size is the number of words (null text: 0), finish the virtual finish time of the document's first copy (null where the target is 0), taken
    the number of its words in the mix, repeats counted: between 0 and max_repeats times size. Null source is a
    source of its own, ordered last; null doc_id is a key like another. Repeated rows are separate documents, and
    ties in the shuffled order fall among equals. Rows are kept one to one; an empty table gives an empty one. Columns of the
    input that have the names of the new ones are replaced; others may have any names.
    """
    docs = docs.drop("size", "source_size", "target", "finish", "taken")
    rows, end, copies = mixed(docs, weights, budget_share, max_repeats, seed)
    taken = F.aggregate(copies, F.lit(0).cast("long"), lambda sum_, p: sum_ + served(p, end))
    first = F.when(F.col("_target") > 0, finish(F.col("_start") + F.col("_size")))
    made = rows.select(*(f"c{i}" for i in range(len(docs.columns))), "_size", "_source_size", "_target", first.alias("_finish"), taken.alias("_taken"))
    return made.toDF(*docs.columns, "size", "source_size", "target", "finish", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """The mix as rows with docs' columns, in the mix's order (by range partitions, sorted inside): each copy of which half the words or more are taken, whole. A document
    without words comes once."""
    rows, end, copies = mixed(docs, weights, budget_share, max_repeats, seed)
    names = [f"c{i}" for i in range(len(docs.columns))]
    each = F.transform(F.array(*(F.lit(k) for k in range(max_repeats))), lambda k: F.struct(
        k.alias("copy"),
        F.aggregate(F.filter(copies, lambda p: p["copy"] == k), F.lit(0).cast("long"), lambda sum_, p: sum_ + served(p, end)).alias("taken"),
    ))
    kept = F.filter(each, lambda c: F.when(F.col("_size") > 0, c["taken"] * 2 >= F.col("_size")).otherwise(c["copy"] == 0))
    queue = rows.select(*names, "_s", "_key", "_start", "_size", "_source_size", "_target", F.explode(kept).alias("_c"))
    at = F.coalesce(finish(F.col("_start") + F.col("_size") + F.col("_source_size") * F.col("_c.copy")), F.lit(0.0))
    queue = queue.select(*names, at.alias("_at"), "_s", "_key", F.col("_c.copy").alias("_copy"))
    order = ["_at", "_s", "_key", "_copy"]
    return queue.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).toDF(*docs.columns)
