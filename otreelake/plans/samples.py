"""Samples of frames: a Sample of our rows in a plan becomes a range of weights, which the file index knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.relation import index_of
from .catalyst import items, kind
from .statements import of_plan

#: Between a sample and its relation there may be these, which leave rows as they are or drop some by a condition.
_THROUGH = ("Project", "Filter", "SubqueryAlias", "View")


def with_children(spark: SparkSession, plan, children: list):
    held = spark.sparkContext._jvm.java.util.ArrayList()
    for c in children:
        held.add(c)
    return plan.withNewChildren(spark.sparkContext._jvm.org.apache.spark.api.python.PythonUtils.toSeq(held))


def weighed(spark: SparkSession, plan, low: float, high: float):
    """The plan with only the rows whose weights lie between two fractions; None if its rows are not those of one table of ours."""
    if (index := index_of(plan)) is not None:
        from ..table import in_sample

        if not index.indexed():
            return None
        return in_sample(of_plan(spark, plan), index.snapshot, (low, high))._jdf.queryExecution().analyzed()
    if kind(plan) not in _THROUGH:
        return None
    child = weighed(spark, plan.children().head(), low, high)
    return None if child is None else with_children(spark, plan, [child])


def rewritten(spark: SparkSession, plan):
    """The plan, or a new one if it has samples of our tables."""
    if kind(plan) == "Sample" and not plan.withReplacement():
        found = weighed(spark, plan.child(), plan.lowerBound(), min(1.0, plan.upperBound()))
        if found is not None:
            return rewritten(spark, found)
    old = list(items(plan.children()))
    new = [rewritten(spark, c) for c in old]
    return plan if all(a is b for a, b in zip(old, new, strict=True)) else with_children(spark, plan, new)


def push_samples(df: DataFrame) -> DataFrame:
    """df, whose samples of our tables (without replacement) take the rows with weights in the fraction, wherever in the plan they are but in subqueries of
    expressions. Such samples are deterministic, whatever the seed, and read only the files they need. Other samples stay."""
    plan = df._jdf.queryExecution().analyzed()
    new = rewritten(df.sparkSession, plan)
    return df if new is plan else of_plan(df.sparkSession, new)
