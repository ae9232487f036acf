"""Choosing the columns to index: those that are least correlated with the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError, OTreeError
from ..functions.transforms import number_column, type_name

#: Columns of which every pair is judged by the rows where both are known; more of them go through one matrix.
MOST_PAIRWISE = 40


def select_columns(df: DataFrame, most: int) -> list[str]:
    """The `most` indexable columns with the lowest average absolute correlation, in the order of the schema where equal.

    Strings go in by their hash. An empty table, and one with no more columns than wanted, gives the first ones. All pairs are one pass of products of matrices."""
    kinds = {}
    for f in df.schema.fields:
        try:
            kinds[f.name] = type_name(f.dataType)
        except OTreeError:
            continue
    if not kinds:
        raise AnalysisError("no column can be indexed")
    names = list(kinds)
    if len(names) <= most:
        return names
    as_number = {n: F.hash(f"`{n}`").cast("double") if k == "string" else number_column(F.col(f"`{n}`"), k) for n, k in kinds.items()}
    numbers = df.select(*(as_number[n].alias(f"c{i}") for i, n in enumerate(names)))
    if len(names) > MOST_PAIRWISE:
        total = total_correlations(numbers)
        return names[:most] if total is None else lowest(names, total, most)
    total = pairwise_correlations(numbers)
    return names[:most] if total is None else lowest(names, total, most)


def lowest(names: list[str], total: list[float], most: int) -> list[str]:
    chosen = sorted(range(len(names)), key=lambda i: (total[i], i))[:most]
    return [names[i] for i in sorted(chosen)]


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sets of rows together: for each pair the rows where both are known, the first's mean over them, and the sum of products of what both differ from their means."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    return np.stack([n, a[1] + apart * share, a[2] + b[2] + apart * apart.T * a[0] * share])


def moments(width: int):
    """For mapInArrow: merged_moments of a partition, and which columns have a number that is not finite."""

    def of(batches):
        whole, odd, all_rows = np.zeros((3, width, width)), np.zeros(width, bool), 0
        for batch in batches:
            all_rows += batch.num_rows
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            odd |= (known & ~np.isfinite(x)).any(0)
            known &= np.isfinite(x)
            rows = known.sum(0)
            first = np.where(rows > 0, x[known.argmax(0), np.arange(width)], 0.0) if len(x) else np.zeros(width)
            x = np.where(known, x - first, 0.0)  # of a column with one value nothing is left, not even by rounding
            off = np.divide(x.sum(0), rows, out=np.zeros(width), where=rows > 0)
            x, m, middle = np.where(known, x - off, 0.0), known.astype(float), first + off
            n, sums = m.T @ m, x.T @ m
            mean = np.divide(sums, n, out=np.zeros_like(n), where=n > 0)
            whole = merged_moments(whole, np.stack([n, middle[:, None] + mean, x.T @ x - sums * mean.T]))
        yield pa.RecordBatch.from_pydict({"moments": [whole.ravel().tolist()], "odd": [odd.tolist()], "n": [all_rows]})

    return of


def pairwise_correlations(numbers: DataFrame) -> list[float] | None:
    """Sums of absolute correlations of each column with the others, each over the rows where both are known. A column with NaN or one value counts as uncorrelated. None for an empty table."""
    width = len(numbers.columns)
    found = numbers.mapInArrow(moments(width), "moments array<double>, odd array<boolean>, n bigint").collect()  # a row for each partition
    whole, odd = np.zeros((3, width, width)), np.zeros(width, bool)
    for r in found:
        whole, odd = merged_moments(whole, np.array(r["moments"]).reshape(3, width, width)), odd | np.array(r["odd"])
    if not sum(r["n"] for r in found):
        return None
    n, _, products = whole
    shared = np.divide(products, n, out=np.zeros_like(n), where=n > 0)
    spread = np.sqrt(np.maximum(np.diag(shared), 0.0))
    scale = np.outer(spread, spread)
    r = np.abs(np.divide(shared, scale, out=np.zeros_like(scale), where=(scale > 0) & ~(odd[:, None] | odd)))
    np.fill_diagonal(r, 0.0)
    return r.round(12).sum(1).round(12).tolist()  # equal columns stay equal, whatever the order of sums


def total_correlations(numbers: DataFrame) -> list[float] | None:
    """Sums of absolute correlations of each column with the others, from one product of the whole matrix instead of an aggregate for each pair. A null or NaN counts
    as its column's mean. None for an empty table."""
    clean = numbers.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in numbers.columns))
    means = clean.agg(F.count(F.lit(1)).alias("rows"), *(F.avg(c).alias(c) for c in numbers.columns)).first().asDict()
    if not means.pop("rows"):
        return None
    filled = clean.fillna({c: m or 0.0 for c, m in means.items()})
    vectors = VectorAssembler(inputCols=numbers.columns, outputCol="v").transform(filled).select("v")
    r = np.abs(np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray()))
    return (r.sum(1) - np.diag(r)).tolist()
