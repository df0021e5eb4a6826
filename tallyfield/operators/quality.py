"""Data-quality rules: a table of conditions compiled into one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the worst.
SEVERITIES = ("CRITICAL", "RED", "WARNING", "YELLOW", "GREEN", "INFO")


@dataclass(frozen=True)
class Rule:
    """An issue that every row meeting a condition raises; a null condition doesn't hold."""

    severity: str
    code: str
    condition: Column
    message: Column | None = None


def severity_rank(severity: Column) -> Column:
    rank = None
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, i) if rank is None else rank.when(severity == name, i)
    return rank.otherwise(len(SEVERITIES))


def issues(rows: DataFrame, rules: list[Rule], source: str, row: Column, ref: Column) -> DataFrame:
    """(severity, code, source, row, ref, message): one row for every rule that a row breaks, all in one scan."""
    checks = [
        F.when(
            F.coalesce(r.condition, F.lit(False)),
            F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), (F.lit(None).cast("string") if r.message is None else r.message).alias("message")),
        )
        for r in rules
    ]
    broken = rows.select(row.alias("row"), ref.cast("string").alias("ref"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return broken.select("i.severity", "i.code", F.lit(source).alias("source"), "row", "ref", "i.message")


def alerts(found: DataFrame, samples: int = 10) -> DataFrame:
    """(severity, code, n, samples): rules that no row breaks don't appear; the first refs in order are samples.

    Only the first refs of each rule are gathered, so a rule that all rows break costs no more than its count.
    """
    counts = found.groupBy("severity", "code").agg(F.count("*").alias("n"))
    # first among the rows of one hash, then among those: no rule is sorted in one task
    spread = Window.partitionBy("severity", "code", F.pmod(F.xxhash64("row", "ref"), F.lit(64))).orderBy("row", "ref")
    first = found.withColumn("_n", F.row_number().over(spread)).where(F.col("_n") <= samples)
    overall = Window.partitionBy("severity", "code").orderBy("row", "ref")
    kept = first.withColumn("_n", F.row_number().over(overall)).where(F.col("_n") <= samples)
    lists = kept.groupBy("severity", "code").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "ref"))), lambda x: x["ref"]), ", ").alias("samples")
    )
    return counts.join(lists, ["severity", "code"])


def counts_by_code(found: DataFrame) -> DataFrame:
    """(severity, code, n, sample), the sample being the message of the first row."""
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"), F.min_by("message", F.struct("row", "ref")).alias("sample"))


def by_severity(found: DataFrame) -> DataFrame:
    """(severity, n): how many issues there are of each."""
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def picked(found: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """The issues of one severity and one source, or of all."""
    rows = found if severity is None else found.where(F.col("severity") == severity)
    return rows if category is None else rows.where(F.col("source") == category)


def overall(found: DataFrame) -> DataFrame:
    """(total, status): all issues, and the worst severity or GREEN."""
    rank = F.min(severity_rank(F.col("severity")))
    worst = F.when(F.count("*") == 0, "GREEN").otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1))
    return found.agg(F.count("*").alias("total"), worst.alias("status"))


def first_issues(found: DataFrame, most: int = 1000) -> DataFrame:
    """The view's cap: the worst first, by code and row. The stored issues are all kept."""
    return found.orderBy(severity_rank(F.col("severity")), "code", F.coalesce("row", F.lit(0)), "ref").limit(most)


def united(*streams: DataFrame) -> DataFrame:
    """The issues of all sources in one frame."""
    return reduce(DataFrame.unionByName, streams)


def report_counters(found: DataFrame) -> DataFrame:
    """(source, code, severity, n) for every kind of issue, (source, null, severity, n) and (null, null, severity, n) above them: one grouping."""
    sets = [[F.col("source"), F.col("code"), F.col("severity")], [F.col("source"), F.col("severity")], [F.col("severity")]]
    return found.groupingSets(sets, F.col("source"), F.col("code"), F.col("severity")).agg(F.count("*").alias("n"))
