"""The ledger's reports over the star-schema tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import store
from ..sources import tables as T
from . import ledger as L
from .registry import d, query

DAY = datetime.date(1998, 6, 15)
SHEET_TOTAL = 1_400_000.0
#: The same rows in SQL: all operations with their occurrence, and the working set joined to its dimensions.
OPS = """ops AS (
  SELECT l_orderkey AS contract_number, l_linenumber AS record_no, l_suppkey AS farmer_id, CAST(l_shipdate AS DATE) AS acceptance_date,
    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
    CAST(l_quantity AS DECIMAL(9,3)) AS physical_kg, CAST(CAST(l_quantity AS DECIMAL(9,3)) * 1.25 AS DECIMAL(18,5)) AS gross_kg,
    CAST(CAST(l_quantity AS DECIMAL(9,3)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,5)) AS calculated_kg,
    CAST(CAST(CAST(l_quantity AS DECIMAL(9,3)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,5)) * (1 - CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,7)) AS conditioned_kg,
    CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(9,2)) AS impurity_pct, CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS DECIMAL(9,2)) AS moisture_pct,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag AS grade, CASE WHEN l_linestatus = 'O' THEN 'HAND' ELSE 'MACHINE' END AS method,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS occurrence
  FROM lineitem),
contracts AS (SELECT o_orderkey AS contract_number, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.0004 AS DECIMAL(18,6)) AS contract_qty,
    o_orderpriority AS contract_type, o_custkey AS buyer_id FROM orders),
farmers AS (SELECT s_suppkey AS farmer_id, s_name AS farmer_name, n_name AS block, r_name AS cluster FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
star AS (SELECT ops.*, farmer_name, block, cluster, contract_qty, contract_type, c_mktsegment AS buyer FROM ops JOIN farmers USING (farmer_id)
    LEFT JOIN contracts USING (contract_number) LEFT JOIN customer ON buyer_id = c_custkey),
work AS (SELECT *, conditioned_kg AS kg FROM star WHERE occurrence = 1 AND conditioned_kg > 0)"""
PERFORMANCE = """perf AS (
  SELECT contract_number, contract_qty, coalesce(accepted, 0) AS accepted, coalesce(operations, 0) AS operations,
    round(CASE WHEN contract_qty > 0 THEN CAST(coalesce(accepted, 0) AS DOUBLE) * 100 / CAST(contract_qty AS DOUBLE) END, 4) AS achieved_pct
  FROM contracts LEFT JOIN (SELECT contract_number, sum(kg) AS accepted, count(*) AS operations FROM work GROUP BY 1) USING (contract_number)),
performance AS (SELECT *, CASE WHEN achieved_pct = 0 THEN 'NOT_STARTED' WHEN achieved_pct > 100 THEN 'OVER' WHEN achieved_pct = 100 THEN 'COMPLETED'
    WHEN achieved_pct >= 90 THEN 'NEAR_COMPLETION' ELSE 'IN_PROGRESS' END AS status FROM perf)"""


def _rolled(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""per AS (SELECT {k}contract_number, min(contract_qty) AS qty, sum(kg) AS kg, count(*) AS n, sum(amount) AS amount,
    sum(moisture_pct) AS moisture, sum(impurity_pct) AS impurity FROM work GROUP BY {k}contract_number),
rolled AS (SELECT {k}sum(qty) AS contract_qty, sum(kg) AS accepted, sum(n) AS deliveries, sum(amount) AS amount, count(*) AS contracts,
    round(CAST(sum(moisture) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 4) AS avg_moisture, round(CAST(sum(impurity) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 4) AS avg_impurity,
    round(CAST(sum(kg) AS DOUBLE) * 100 / CAST(sum(qty) AS DOUBLE), 4) AS achieved_pct, round(CAST(sum(amount) AS DOUBLE) / CAST(sum(kg) AS DOUBLE), 4) AS avg_price
  FROM per {group})"""


ROLLED = f"{d('contract_qty')}, {d('accepted')}, CAST(deliveries AS BIGINT) AS deliveries, {d('amount')}, contracts, avg_moisture, avg_impurity, achieved_pct, avg_price"
FARMER = f"farmer_id, {ROLLED}, farmer_name"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.marked(T.operations(spark, sf_dir))


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.working_set(marked(spark, sf_dir))


@query(f"""WITH {OPS}, {PERFORMANCE} SELECT contract_number, {d('contract_qty')}, {d('accepted')}, {d('greatest(contract_qty - accepted, 0)', 'remaining')},
    {d('greatest(accepted - contract_qty, 0)', 'over')}, achieved_pct, status, operations FROM performance""")
def contract_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the weight is asked for, so repeats go by an aggregate over four columns, before anything is joined."""
    rows = T.raw_operations(spark, sf_dir).select(*L.KEY, "source_row", "farmer_id", "conditioned_kg")
    once = R.first_of_each(rows.join(T.farmers(spark, sf_dir).select("farmer_id"), "farmer_id", "left_semi"), list(L.KEY), ["source_row"])
    first = once.withColumns({"is_duplicate": F.lit(False), "is_valid": F.coalesce(F.col("conditioned_kg") > 0, F.lit(False))})
    return L.contract_performance(L.working_set(first), T.contracts(spark, sf_dir))


@query(f"WITH {OPS}, {PERFORMANCE} SELECT status, count(*) AS n FROM performance GROUP BY 1")
def contract_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(contract_performance(spark, sf_dir), "status")


@query(f"""WITH {OPS}, {PERFORMANCE} SELECT CASE WHEN achieved_pct >= 100 THEN 'green' WHEN achieved_pct >= 90 THEN 'yellow'
    WHEN coalesce(achieved_pct, 0) = 0 THEN 'red' ELSE 'none' END AS light, count(*) AS n FROM performance GROUP BY 1""")
def achievement_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(contract_performance(spark, sf_dir).select(L.achievement_light(F.col("achieved_pct")).alias("light")), "light")


@query(f"""WITH {OPS}, {_rolled('')} SELECT {d('contract_qty')}, {d('accepted')}, {d('greatest(contract_qty - accepted, 0)', 'remaining')}, {d('greatest(accepted - contract_qty, 0)', 'over')},
    achieved_pct, (SELECT round(CAST(coalesce(sum(kg), 0) AS DOUBLE), 4) FROM work WHERE acceptance_date = DATE '{DAY}') AS today, {d('amount')}, avg_price, contracts,
    (SELECT count(DISTINCT farmer_id) FROM work) AS farmers, CAST(deliveries AS BIGINT) AS deliveries FROM rolled""")
def mgmt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.management_summary(work(spark, sf_dir), DAY)


@query(f"WITH {OPS}, {_rolled('farmer_id')} SELECT {FARMER} FROM rolled JOIN farmers USING (farmer_id)")
def farmer_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.farmer_analytics(work(spark, sf_dir))


@query(f"WITH {OPS}, {_rolled('farmer_id')} SELECT {FARMER} FROM rolled JOIN farmers USING (farmer_id) ORDER BY coalesce(achieved_pct, 0) DESC, farmer_id LIMIT 10")
def top_farmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_farmers(farmer_analytics(spark, sf_dir))


@query(f"WITH {OPS}, {_rolled('farmer_id')} SELECT {FARMER} FROM rolled JOIN farmers USING (farmer_id) WHERE contract_qty > 0 ORDER BY coalesce(achieved_pct, 0), farmer_id LIMIT 10")
def bottom_farmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bottom_farmers(farmer_analytics(spark, sf_dir))


@query(f"""WITH {OPS}, {_rolled('cluster')} SELECT cluster, {ROLLED}, farmers FROM rolled
    JOIN (SELECT cluster, count(DISTINCT farmer_id) AS farmers FROM work GROUP BY 1) USING (cluster)""")
def cluster_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster_analytics(work(spark, sf_dir))


@query(f"WITH {OPS} SELECT cluster, round(CAST(sum(amount) AS DOUBLE) / CAST(sum(kg) AS DOUBLE), 4) AS weighted_price FROM work GROUP BY 1")
def weighted_avg_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = R.weighted_mean(F.col("amount"), F.col("kg").cast("double"))
    return work(spark, sf_dir).groupBy("cluster").agg(F.round(F.sum("amount").cast("double") / F.sum("kg").cast("double"), 4).alias("weighted_price"), price.alias("p")).drop("p")


@query(f"""WITH {OPS}, p AS (SELECT *, CAST(round(CAST(amount AS DECIMAL(38,2)) / kg, 4) AS DECIMAL(18,4)) AS price FROM work)
    SELECT {d('sum(amount)', 'amount')}, {d(f"coalesce(sum(amount) FILTER (WHERE acceptance_date = DATE '{DAY}'), 0)", 'amount_today')},
    round(CAST(sum(price) AS DOUBLE) / count(price), 2) AS avg_price, round(CAST(sum(amount) AS DOUBLE) / CAST(sum(kg) AS DOUBLE), 4) AS weighted_price,
    round(CAST(min(price) AS DOUBLE), 2) AS min_price, round(CAST(max(price) AS DOUBLE), 2) AS max_price, {d('sum(amount * CAST(l_tax AS DECIMAL(4,2)))', 'markup')}, {d('sum(amount * CAST(l_discount AS DECIMAL(4,2)))', 'discount')},
    {d('sum(physical_kg * 2)', 'transport_fee')}, {d("coalesce(sum(physical_kg * 3) FILTER (WHERE grade = 'R'), 0)", 'seed_cotton_fee')}, {d('sum(physical_kg * 5)', 'other_fee_total')} FROM p""")
def finance_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = {c: F.round(F.col(c).cast("double"), 2) for c in ("avg_price", "min_price", "max_price")}
    return L.finance(work(spark, sf_dir), DAY).withColumns(cents)


@query(f"""WITH {OPS}, v AS (SELECT 'impurity' AS measure, impurity_pct AS v, 6 AS w, 9 AS c FROM work UNION ALL SELECT 'moisture', moisture_pct, 12, 15 FROM work)
    SELECT measure, CASE WHEN v > c THEN 'critical' WHEN v > w THEN 'warn' ELSE 'normal' END AS band, count(*) AS n FROM v GROUP BY 1, 2""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quality_bands(work(spark, sf_dir))


@query(f"""WITH {OPS} SELECT {", ".join(f"round(CAST(sum({m}_pct) AS DOUBLE) / count({m}_pct), 4) AS avg_{m}, {d(f'min({m}_pct)', f'min_{m}')}, {d(f'max({m}_pct)', f'max_{m}')}" for m in ('moisture', 'impurity'))} FROM work""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quality_summary(work(spark, sf_dir))


@query(f"WITH {OPS} SELECT grade AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM work), 4) AS share_pct FROM work GROUP BY 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distribution(work(spark, sf_dir), F.col("grade"), L.UNKNOWN)


@query(f"""WITH {OPS}, s AS (SELECT 0 AS stage_no, 'gross_kg' AS stage, CAST(sum(gross_kg) AS DECIMAL(28,7)) AS kg FROM work UNION ALL SELECT 1, 'tare_kg', CAST(sum(physical_kg * 0.25) AS DECIMAL(28,7)) FROM work UNION ALL SELECT 2, 'physical_kg', CAST(sum(physical_kg) AS DECIMAL(28,7)) FROM work
    UNION ALL SELECT 3, 'calculated_kg', CAST(sum(calculated_kg) AS DECIMAL(28,7)) FROM work UNION ALL SELECT 4, 'conditioned_kg', CAST(sum(conditioned_kg) AS DECIMAL(28,7)) FROM work),
    x AS (SELECT *, lag(kg) OVER (ORDER BY stage_no) AS b FROM s)
    SELECT stage_no, stage, {d('kg')}, {d('kg - b', 'change')}, round(CAST(kg - b AS DOUBLE) * 100 / CAST(b AS DOUBLE), 4) AS change_pct FROM x""")
def weight_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.weight_bridge(work(spark, sf_dir))


@query(f"""WITH {OPS}, t AS (SELECT acceptance_date, sum(kg) AS kg, count(*) AS operations FROM work GROUP BY 1)
    SELECT acceptance_date, {d('kg')}, operations, {d('sum(kg) OVER (ORDER BY acceptance_date)', 'cumulative_kg')} FROM t""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.daily_trend(work(spark, sf_dir))


@query(f"""WITH {OPS}, t AS (SELECT acceptance_date, sum(CASE WHEN method = 'HAND' THEN kg ELSE 0 END) AS hand_kg, sum(CASE WHEN method = 'HAND' THEN 0 ELSE kg END) AS machine_kg FROM work GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series(min(acceptance_date), max(acceptance_date), INTERVAL 1 DAY)) AS DATE) AS acceptance_date FROM t),
    f AS (SELECT acceptance_date, coalesce(hand_kg, 0) AS hand_kg, coalesce(machine_kg, 0) AS machine_kg FROM c LEFT JOIN t USING (acceptance_date))
    SELECT acceptance_date, {d('hand_kg')}, {d('machine_kg')}, {d('hand_kg + machine_kg', 'kg')}, {d('sum(hand_kg + machine_kg) OVER (ORDER BY acceptance_date)', 'cumulative_kg')} FROM f""")
def dense_daily_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dense_daily(work(spark, sf_dir))


@query(f"""WITH {OPS}, t AS (SELECT farmer_id, acceptance_date, sum(CASE WHEN method = 'HAND' THEN kg ELSE 0 END) AS h, sum(kg) AS kg,
      sum(CASE WHEN method = 'HAND' THEN amount ELSE 0 END) AS hand_sum, sum(CASE WHEN method = 'HAND' THEN 0 ELSE amount END) AS machine_sum FROM work GROUP BY 1, 2)
    SELECT farmer_id, acceptance_date, {d('h', 'hand_kg')}, {d('kg - h', 'machine_kg')}, {d('hand_sum')}, {d('machine_sum')},
    round(CAST(h AS DOUBLE) * 100 / CAST(kg AS DOUBLE), 1) AS hand_share_pct FROM t""")
def hand_machine_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand = F.col("method") == "HAND"
    add = lambda test, c, name: F.sum(F.when(test, F.col(c)).otherwise(0)).alias(name)
    rows = work(spark, sf_dir).groupBy("farmer_id", "acceptance_date").agg(
        add(hand, "kg", "hand_kg"), add(~hand, "kg", "machine_kg"), add(hand, "amount", "hand_sum"), add(~hand, "amount", "machine_sum")
    )
    total = F.col("hand_kg") + F.col("machine_kg")
    share = F.round(F.col("hand_kg").cast("double") * 100 / F.nullif(total, F.lit(0)).cast("double"), 1)
    return rows.withColumn("hand_share_pct", share)


@query(f"WITH {OPS} SELECT contract_number, record_no, occurrence > 1 AS is_duplicate, count(*) AS n FROM ops GROUP BY 1, 2, 3")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(R.mark_repeats(T.raw_operations(spark, sf_dir), L.KEY, ["source_row"]), *L.KEY, "is_duplicate")


@query(f"WITH {OPS} SELECT contract_number, record_no, farmer_id, {d('physical_kg')}, {d('amount')}, acceptance_date FROM ops WHERE occurrence = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.raw_operations(spark, sf_dir).select(*L.KEY, "source_row", "farmer_id", "physical_kg", "amount", "acceptance_date")
    return R.first_of_each(rows, list(L.KEY), ["source_row"]).drop("source_row")


@query(f"""WITH {OPS}, w AS (SELECT *, first_value(l_partkey) OVER (PARTITION BY contract_number, record_no ORDER BY occurrence) AS f FROM ops)
    SELECT contract_number, record_no, l_partkey AS product_id, f AS first_product_id FROM w WHERE occurrence > 1""")
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeats_of(T.raw_operations(spark, sf_dir), L.KEY, ["source_row"], "product_id").select(*L.KEY, "product_id", "first_product_id")


ALERTS = f"""{OPS}, {PERFORMANCE}, alerts AS (
    SELECT 'RED' AS severity, 'CONTRACT_OVER' AS code, contract_number FROM performance WHERE status = 'OVER'
    UNION ALL SELECT 'YELLOW', 'NEAR_COMPLETION', contract_number FROM performance WHERE status = 'NEAR_COMPLETION'
    UNION ALL SELECT 'RED', 'NO_ACCEPTANCE', contract_number FROM performance WHERE status = 'NOT_STARTED'
    UNION ALL SELECT 'YELLOW', 'LOW_ACHIEVEMENT', contract_number FROM performance WHERE achieved_pct > 0 AND achieved_pct < 20)"""


def _contract_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contract_alerts(contract_performance(spark, sf_dir))


@query(f"""WITH {ALERTS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY contract_number) AS k FROM alerts)
    SELECT severity, code, count(*) AS n, string_agg(CAST(contract_number AS VARCHAR), ', ' ORDER BY contract_number) FILTER (WHERE k <= 10) AS samples FROM r GROUP BY 1, 2""")
def alerts_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.alerts(_contract_alerts(spark, sf_dir))


DATA_ALERTS = f"""{OPS}, rules AS (SELECT *, unnest([
    CASE WHEN occurrence > 1 THEN {{'severity': 'INFO', 'code': 'DUPLICATE_OPERATION'}} END,
    CASE WHEN occurrence = 1 AND amount <= 0 THEN {{'severity': 'RED', 'code': 'ZERO_OR_NEGATIVE_PRICE'}} END,
    CASE WHEN occurrence = 1 AND impurity_pct > 9 THEN {{'severity': 'YELLOW', 'code': 'HIGH_IMPURITY'}} END,
    CASE WHEN occurrence = 1 AND moisture_pct > 15 THEN {{'severity': 'YELLOW', 'code': 'HIGH_MOISTURE'}} END,
    CASE WHEN occurrence = 1 AND contract_qty IS NULL THEN {{'severity': 'YELLOW', 'code': 'MISSING_CONTRACT_QTY'}} END]) AS i FROM star),
    found AS (SELECT i.severity AS severity, i.code AS code, contract_number, record_no FROM rules WHERE i IS NOT NULL)"""


def _data_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [r for r in L.data_rules() if r.code != "ABNORMAL_WEIGHT_CONVERSION"]
    return Q.issues(marked(spark, sf_dir), rules, "LEDGER", F.col("record_no"), F.col("contract_number"))


@query(f"WITH {DATA_ALERTS} SELECT severity, code, count(*) AS n FROM found GROUP BY 1, 2")
def alerts_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.alerts(_data_issues(spark, sf_dir)).drop("samples")


@query(f"""WITH {OPS} SELECT CASE WHEN CAST(conditioned_kg AS DOUBLE) * 100 < CAST(physical_kg AS DOUBLE) * 90 THEN 'low' ELSE 'normal' END AS conversion, count(*) AS n FROM work GROUP BY 1""")
def abnormal_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("conditioned_kg").cast("double") * 100 < F.col("physical_kg").cast("double") * 90
    return R.counts_by(work(spark, sf_dir).select(F.when(low, "low").otherwise("normal").alias("conversion")), "conversion")


@query(f"""WITH {ALERTS}, {DATA_ALERTS.removeprefix(OPS + ', ')}, u AS (SELECT severity, code, CAST(contract_number AS VARCHAR) AS ref FROM alerts
    UNION ALL SELECT severity, code, CAST(contract_number AS VARCHAR) FROM found) SELECT severity, code, ref, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _contract_alerts(spark, sf_dir).unionByName(_data_issues(spark, sf_dir).withColumn("row", F.col("row").cast("long")))
    return R.counts_by(both, "severity", "code", "ref")


@query(f"WITH {DATA_ALERTS} SELECT severity, code, count(*) AS n, arg_min('row ' || record_no, struct_pack(a := record_no, b := CAST(contract_number AS VARCHAR))) AS sample FROM found GROUP BY 1, 2")
def issue_counts_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.counts_by_code(_data_issues(spark, sf_dir).withColumn("message", F.concat(F.lit("row "), F.col("row"))))


@query(f"WITH {DATA_ALERTS} SELECT count(*) AS total, CASE WHEN count(*) FILTER (WHERE severity = 'RED') > 0 THEN 'RED' WHEN count(*) FILTER (WHERE severity = 'YELLOW') > 0 THEN 'YELLOW' WHEN count(*) > 0 THEN 'INFO' ELSE 'GREEN' END AS status FROM found")
def alert_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.overall(_data_issues(spark, sf_dir))


@query(f"""WITH {DATA_ALERTS} SELECT severity, code, record_no AS row, CAST(contract_number AS VARCHAR) AS ref FROM found
    ORDER BY CASE severity WHEN 'RED' THEN 1 WHEN 'YELLOW' THEN 3 ELSE 5 END, code, record_no, ref LIMIT 1000""")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_issues(_data_issues(spark, sf_dir)).select("severity", "code", "row", "ref")


@query(f"""WITH {OPS}, t AS (SELECT sum(conditioned_kg) AS c FROM ops WHERE occurrence = 1)
    SELECT {d('c', 'computed')}, {d(str(SHEET_TOTAL), 'sheet')}, {d(f'abs(c - CAST({SHEET_TOTAL} AS DECIMAL(28,3)))', 'difference')}, abs(CAST(c AS DOUBLE) - {SHEET_TOTAL}) > {SHEET_TOTAL * 0.02} AS mismatch FROM t""")
def reconcile_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.mark_repeats(T.raw_operations(spark, sf_dir), L.KEY, ["source_row"])
    return L.reconcile_total(rows, SHEET_TOTAL)


@query(f"WITH {OPS} SELECT min(acceptance_date) AS first_day, max(acceptance_date) AS last_day FROM ops")
def data_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.period(T.raw_operations(spark, sf_dir))


@query(f"WITH {OPS} SELECT buyer, count(*) AS n, {d('sum(kg)', 'kg')} FROM work WHERE buyer = 'BUILDING' GROUP BY 1")
def buyer_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    rows = L.working_set(marked(spark, sf_dir), replace(DEFAULT, buyer="BUILDING"))
    return rows.groupBy("buyer").agg(F.count("*").alias("n"), F.sum("kg").alias("kg"))


@query(f"""WITH {OPS} SELECT contract_number, record_no, acceptance_date, {d('kg')} FROM work WHERE farmer_id = 5 AND acceptance_date >= DATE '1998-01-01'
    ORDER BY acceptance_date, contract_number, record_no LIMIT 300""")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work(spark, sf_dir).where(F.col("acceptance_date") >= F.lit(datetime.date(1998, 1, 1)))
    return L.drill_down(rows, farmer=5).select(*L.KEY, "acceptance_date", "kg")


@query(f"WITH {OPS} SELECT DISTINCT cluster, block FROM star ORDER BY 1, 2")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark, sf_dir).select("cluster", "block").distinct().orderBy("cluster", "block")


@query("SELECT o_orderstatus AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN true ELSE false END AS is_plan, count(*) AS n, round(CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.0004 AS DECIMAL(18,6))) AS DOUBLE), 4) AS qty FROM orders GROUP BY 1, 2")
def plan_type_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from .settlement import plan_type

    cfg = replace(DEFAULT, plan_types=("urgent", "high"))
    rows = T.contracts(spark, sf_dir)
    return rows.groupBy(F.col("contract_state").alias("status"), plan_type(F.col("contract_type"), cfg).alias("is_plan")).agg(F.count("*").alias("n"), F.sum("contract_qty").alias("qty"))


@query(f"""WITH {OPS}, w AS (SELECT *, row_number() OVER (PARTITION BY farmer_id ORDER BY contract_number DESC, record_no DESC) AS k FROM star WHERE occurrence = 1)
    SELECT farmer_id, farmer_name, block, cluster FROM w WHERE k = 1""")
def dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir).where("not is_duplicate")
    return store.dimension(rows, None, "farmer_id", ["farmer_name", "block", "cluster"], F.struct("contract_number", "record_no"))


@query(f"WITH {OPS} SELECT farmer_name, {d('sum(kg)', 'kg')}, count(*) AS n FROM work GROUP BY 1 UNION ALL SELECT 'Жами', {d('sum(kg)', 'kg')}, count(*) FROM work")
def sheet_totals_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work(spark, sf_dir).groupBy("farmer_name").agg(F.sum("kg").alias("kg"), F.count("*").alias("n"))
    return R.with_totals(rows, "farmer_name", "Жами", ["kg", "n"])
