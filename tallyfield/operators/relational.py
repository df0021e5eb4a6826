"""Grouping, ordering and window operators that the reports share. Every order is total."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def _struct(order: Order) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def mark_repeats(rows: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    """rows with is_duplicate (not the first of its key) and occurrence, from 1."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(window)).withColumn("is_duplicate", F.col("occurrence") > 1)


def first_of_each(rows: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    """The first row of every key. The least order value is found by partial aggregation, so a hot key doesn't gather in a task."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), _struct(order)).alias("_first"))
    return best.select(*key, "_first.*").select(*rows.columns)


def last_of_each(rows: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    """The last row of every key, as first_of_each."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), _struct(order)).alias("_last"))
    return best.select(*key, "_last.*").select(*rows.columns)


def repeats_of(rows: DataFrame, key: Sequence[str], order: Order, value: str) -> DataFrame:
    """The rows that are not the first of their key, each with first_<value>, that of the first. The order is total.

    The first row is found by partial aggregation and joined back, so a hot key is neither sorted nor gathered in a task. Nulls are a key.
    """
    ranked = rows.withColumn("_order", _struct(order))
    firsts = ranked.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(F.struct("_order", F.col(value).alias("value"))).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    joined = ranked.join(firsts, same).where(F.col("_order") > F.col("_first._order"))
    return joined.select(*rows.columns, F.col("_first.value").alias(f"first_{value}"))


def distribution(rows: DataFrame, value: Column, missing: str) -> DataFrame:
    """(value, n, share_pct): how often each value occurs; null under the name given."""
    counts = rows.groupBy(F.coalesce(value, F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    # one row for each value: the total over them is small
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("share_pct"))


def weighted_mean(amount: Column, basis: Column) -> Column:
    """Sum of amounts by sum of bases over rows that have both; null unless the bases add up to more than 0."""
    both = amount.isNotNull() & basis.isNotNull()
    total = F.sum(F.when(both, basis))
    return F.sum(F.when(both, amount)) / F.when(total > 0, total)


def bands(value: Column, warn: int, critical: int) -> Column:
    """Which of three bands a percentage falls into; null where it is missing."""
    return F.when(value > critical, "critical").when(value > warn, "warn").when(value.isNotNull(), "normal")


def running_by_day(days: DataFrame, day: str, amount: str, name: str) -> DataFrame:
    """days (a row for each day) with the sum up to it. One row a day is few, whatever the facts number."""
    window = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn(name, F.sum(amount).over(window))


def dense_days(days: DataFrame, day: str, fill: dict[str, object]) -> DataFrame:
    """days with a row for every calendar day from the first to the last."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    return calendar.join(days, day, "left").fillna(fill)


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def beyond(rows: DataFrame, k: int) -> DataFrame:
    """(rest): how many rows there are besides the first k, for a note below them."""
    return rows.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("rest"))


def with_totals(rows: DataFrame, label: str, name: str, sums: Sequence[str]) -> DataFrame:
    """rows and a last row of sums, for a table that is shown."""
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label, F.lit(name))
    return rows.unionByName(total, allowMissingColumns=True)


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
