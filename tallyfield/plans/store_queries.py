"""Work with a state over the star-schema tables: batches of shipped lines merged into a change log, imports redone, partners dealt out in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog, store
from ..operators import matching as M
from ..operators import quality as Q
from ..shared import scratch_path, written
from ..sources.tables import table
from . import settlement as S
from . import settlement_queries as SQ
from .registry import SQL, d, query

LAST = 5
# A batch carries the lines shipped in its years; an order's first line of a batch counts, and its state is its fingerprint.
SHIPPED = f"""came AS (SELECT CAST(l_orderkey AS VARCHAR) AS natural_key, l_returnflag || l_linestatus AS fingerprint, CAST(l_shipdate AS DATE) AS shipped, CAST(l_quantity AS DECIMAL(12,2)) AS kg,
    least(greatest(year(l_shipdate) - 1995, 1), {LAST}) AS batch, l_linenumber AS line, l_partkey AS part FROM lineitem),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY natural_key, batch ORDER BY shipped, line, part, kg) AS k FROM came) WHERE k = 1),
  steps AS (SELECT *, lag(batch) OVER w AS before, coalesce(lag(fingerprint) OVER w = fingerprint, false) AS same FROM once WINDOW w AS (PARTITION BY natural_key ORDER BY batch)),
  past AS (SELECT CAST(b.range AS INTEGER) AS as_of, natural_key, arg_max(fingerprint, batch) FILTER (WHERE NOT same) AS fingerprint, arg_max(shipped, batch) FILTER (WHERE NOT same) AS shipped,
    arg_max(kg, batch) FILTER (WHERE NOT same) AS kg, min(batch) AS first_batch_id, max(batch) AS last_batch_id FROM steps JOIN range(1, {LAST + 1}) b ON batch <= b.range GROUP BY 1, 2)"""
_tables: dict[tuple[str, str, bool], str] = {}


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the number of their batch."""
    lines = table(spark, sf_dir, "lineitem")
    batch = F.least(F.greatest(F.year("l_shipdate") - 1995, F.lit(1)), F.lit(LAST))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("natural_key"), F.concat("l_returnflag", "l_linestatus").alias("fingerprint"), F.col("l_shipdate").cast("date").alias("shipped"),
        F.col("l_quantity").cast("decimal(12,2)").alias("kg"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), batch.alias("batch"),
    )


def shipped_log(spark: SparkSession, sf_dir: str, compacted: bool = False) -> str:
    """The change log after all batches, made once for each session and folder; compacted: after the fourth batch, and again at the end."""
    at = (spark.sparkContext.applicationId, sf_dir, compacted)
    if at not in _tables:
        root, came = scratch_path(spark, "shipped"), _batch(spark, sf_dir)
        for n in range(1, LAST + 1):
            rows = came.where(F.col("batch") == n).drop("batch")
            changelog.merge(rows, root, n, F.struct("shipped", "line", "part", "kg"), buckets=8, share=None)
            if compacted and n >= LAST - 1:
                changelog.compact(spark, root)
        _tables[at] = root
    return _tables[at]


@query(f"WITH {SHIPPED} SELECT natural_key, fingerprint, shipped, {d('kg')}, first_batch_id, last_batch_id FROM past WHERE as_of = {LAST}")
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.read(spark, shipped_log(spark, sf_dir)).drop("line", "part")


@query(f"WITH {SHIPPED} SELECT as_of, natural_key, fingerprint, shipped, {d('kg')}, first_batch_id, last_batch_id FROM past")
def asof_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shipped_log(spark, sf_dir, compacted=True)
    reads = [changelog.read(spark, root, n).drop("line", "part").withColumn("as_of", F.lit(n)) for n in range(1, LAST + 1)]
    return reduce(DataFrame.unionByName, reads)


@query(f"WITH {SHIPPED} SELECT natural_key, batch AS from_batch, lead(batch) OVER (PARTITION BY natural_key ORDER BY batch) AS to_batch FROM once")
def change_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.history(spark, shipped_log(spark, sf_dir, compacted=True))
    return rows.select("natural_key", F.col("_from").alias("from_batch"), F.col("_to").alias("to_batch"))


@query(f"WITH {SHIPPED} SELECT natural_key FROM once WHERE batch = 3")
def snapshot_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.snapshot(spark, shipped_log(spark, sf_dir, compacted=True), 3).select("natural_key")


@query("""SELECT CAST(c_nationkey AS BIGINT) AS import_id, count(*) AS n, CAST(sum(CASE WHEN c_nationkey = 7 THEN 2 ELSE 1 END * CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) AS balance FROM customer GROUP BY 1""")
def redone_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation as imports; the seventh is done again with other values, and its partition alone is replaced."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(14,2)").alias("balance"), F.col("c_nationkey").cast("long").alias("import_id"))
    root = scratch_path(spark, "imports")
    customers.write.partitionBy("import_id").parquet(root)
    again = store.read_import(spark, root, 7).select("c_custkey", (F.col("balance") * 2).cast("decimal(14,2)").alias("balance"))
    store.write_import(written(again, "again"), root, 7)  # it is read from where it goes
    return spark.read.parquet(root).groupBy("import_id").agg(F.count("*").alias("n"), F.sum("balance").cast("double").alias("balance"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem) SELECT k AS left_key, -k AS right_key, 'SERIES' AS way FROM s UNION ALL
    SELECT s_suppkey + 2000000, -s_suppkey - 3000000, 'NAME' FROM supplier""")
def partners_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's deliveries stand twice in the report, the first takes the series and the second what bears its name: an entry without a series."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.date_trunc("year", "l_shipdate").cast("date").alias("day"), F.col("l_linestatus").alias("method"))
    rows = rows.agg(F.sum(F.col("l_quantity").cast("decimal(12,1)")).cast("decimal(18,1)").alias("kg"))
    twice = rows.unionByName(rows.withColumn("key", F.col("key") + 2_000_000))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    left = keys.withColumn("ord", F.col("key") * 2).unionByName(keys.select((F.col("key") + 2_000_000).alias("key"), (F.col("key") * 2 + 1).alias("ord"), "name"))
    right = keys.select((-F.col("key") - 3_000_000).alias("key"), "name")
    return M.assign_in_order(twice, rows.withColumn("key", -F.col("key")), left, right).select("left_key", "right_key", "way")


#: The queries whose rows together are the report's issues.
STREAMS = ("harvest_issues", "deal_issues", "payment_issues", "directory_issues", "plan_issues", "account_issues")


@query("SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT code, n FROM ({SQL[k]})" for k in STREAMS) + ") GROUP BY 1")
def report_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of one report, of every source, united once and counted in one grouping."""
    report = SQ._Report(spark, sf_dir)
    found = S.all_issues(report.harvest, report.payments, report.index, report.matched, report.deals, report.links, report.lines, report.directory, SQ._owned(spark, sf_dir, report))
    return Q.report_counters(found).where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))


@query("SELECT count(DISTINCT CAST(ts AS DATE)) + count(*) FILTER (WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-15') AS batches FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def batches_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sign-up is a batch of its day, and every day has one more; what else happened are batches that failed."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("report_date"), F.when(F.col("event_type") == "signup", "COMPLETED").otherwise("ERROR").alias("status"))
    daily = events.select("report_date", F.lit("COMPLETED").alias("status")).distinct()
    return store.batches_of_day(events.unionByName(daily), F.lit(SQ.DAY))


@query("""SELECT p_partkey AS id, p_name AS slug FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) AND p_partkey % 2 = 0""")
def slugs_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other part is saved again under its name, which parts with the same name have taken."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug"))
    return store.taken_slugs(parts.where("id % 2 = 0"), parts)
