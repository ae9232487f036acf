"""Quality rules: counts of a text's form, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

The ratio compares two multinomials over hashed words and word pairs: that of trusted documents (labelled good) and that of the raw
corpus, every document of it. A document's score is the mean of its n-grams' log ratios, so its length has no say; it is kept from
a fixed score on. Counting is one aggregate by bucket over all documents, pre-aggregated in every task; the ratios are one array of fixed
size, which the driver reads and puts into the scoring query as a constant. Everything else is one row in, one row out, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Ids of documents labelled good that are broadcast at most; more of them are joined by a shuffle, with the same counts.
MOST_BROADCAST = 1_000_000
#: Documents' n-grams that a bucket is taken to have besides those counted: little evidence says little.
PRIOR = 5.0
#: A document is kept from this mean log ratio on.
LEAST_SCORE = -0.13

SYMBOLS = "#*$%&|<>"
#: Repeated windows of a text that are looked up one by one at most; beyond, sorting finds their places.
FEW = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: in a lambda, an outer expression may be computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashes(words: Column) -> Column:
    """A 64-bit hash of every word; windows and n-grams read these and not the strings."""
    return F.transform(words, lambda w: F.xxhash64(w))


def n_repeat_words(words: Column) -> Column:
    """Words (as hashes) that lie in a 3-word window found twice or more."""

    def covered(places: Column) -> Column:
        """Each place covers three words, less what the next place covers."""
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def by_search(h: Column, repeated: Column) -> Column:
        """Places of windows that are among the repeated ones: looked up one by one while those are few."""
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())

    def by_sort(h: Column) -> Column:
        """The same for any number of repeated windows: next to an equal one in the sorted order."""

        def places(ordered: Column) -> Column:
            same = lambda s, at: F.coalesce(F.get(ordered, at)["h"] == s["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(ordered, lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def counted(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False)))))
        found = let(twice, lambda r: F.when(F.size(r) <= FEW, let(by_search(h, r), covered)).otherwise(let(by_sort(h), covered)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), counted))).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) as doc_id, words (hashes) and the counts. Null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = docs.select("doc_id", "text", words_of(F.col("text")).alias("_words"))
    counted = split.select(
        "doc_id",
        hashes(F.col("_words")).alias("words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return counted.select("*", F.size("words").cast("long").alias("n_words"), n_repeat_words(F.col("words")).alias("n_repeat_words"))


def bucket(one: Column, two: Column | None = None) -> Column:
    """Of a word's hash, or of two words'."""
    return (one if two is None else F.xxhash64(one, two)).bitwiseAND(BUCKETS - 1).cast("int")


def ngrams(words: Column) -> Column:
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: bucket(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.concat(F.transform(w, lambda x: bucket(x)), pairs(w)))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one string: for each bucket the log of the n-gram's share in trusted documents (all that are labelled good) over its share in all, to 5 places."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("good", F.lit(1))
    good = F.broadcast(good) if good.count() <= MOST_BROADCAST else good
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left")
    grams = marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(ngrams(hashes(words_of(F.col("text"))))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["n", "good"])
    listed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "good"))).alias("all"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    ratio = lambda s: F.log((s["good"] + PRIOR) / (s["n"] * F.coalesce(F.try_divide(F.col("good"), F.col("n")), F.lit(0.0)) + PRIOR))
    return listed.select(F.array_join(F.transform("all", lambda s: F.round(ratio(s), 5).cast("string")), ",").alias("ratios"))


def quality(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of every row.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. A text without words has score 0. Without good
    labels all scores are 0. Repeated rows stay; other columns are not read.
    """
    constant = F.split(F.lit(log_ratios(docs, labels).first()["ratios"]), ",").cast("array<double>")
    score = let(
        constant,
        lambda ratios: let(
            F.col("words"),
            lambda w: F.aggregate(
                F.sequence(F.lit(0), F.size(w) - 1),
                F.lit(0.0),
                lambda a, i: a + F.get(ratios, bucket(F.get(w, i))) + F.when(i + 1 < F.size(w), F.get(ratios, bucket(F.get(w, i), F.get(w, i + 1)))).otherwise(0.0),
            ),
        ),
    ) / (2 * F.col("n_words") - 1)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = base_counts(docs).withColumn("score", F.when(F.col("n_words") > 0, score).otherwise(0.0))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", failed.alias("base_failed"), (~failed & (F.col("score") >= least_score)).alias("kept"))
