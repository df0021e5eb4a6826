"""The daily report over the star-schema tables."""

from __future__ import annotations

import datetime
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.keys import fingerprint
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import store
from ..shared import written
from ..sources import settlement_tables as T
from ..sources.tables import table
from . import settlement as S
from .registry import d, query

DAY = datetime.date(2024, 1, 15)
CFG = replace(DEFAULT, plan_types=("urgent", "high"))
_M = lambda c: f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS DECIMAL(20,0))"
SOURCES = f"""harvest AS (
  SELECT l_orderkey * 8 + l_linenumber AS source_row, CASE WHEN l_suppkey % 50 <> 49 THEN 'S' || l_suppkey END AS inn, s_name AS farmer_name, CAST(l_orderkey AS VARCHAR) AS contract_number,
    CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.0004 AS DECIMAL(18,3)) AS contract_qty_t, o_orderpriority AS contract_type, CAST(l_shipdate AS DATE) AS acceptance_date, l_linestatus AS method_raw,
    CASE WHEN l_linestatus = 'O' THEN 'HAND' WHEN l_returnflag = 'R' THEN 'UNKNOWN' ELSE 'MACHINE' END AS method, CASE WHEN l_tax > 0 THEN CAST(l_linenumber AS VARCHAR) END AS pk17,
    CAST(l_quantity AS DECIMAL(18,3)) AS physical_kg, CASE WHEN l_discount > 0 THEN CAST(l_quantity AS DECIMAL(18,3)) ELSE 0 END AS conditioned_kg,
    CASE WHEN l_quantity <> 13 THEN {_M('l_extendedprice')} END AS amount
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE k = 1),
counted AS (SELECT * FROM harvest WHERE conditioned_kg > 0 AND method <> 'UNKNOWN'),
payments AS (
  SELECT event_id AS source_row, CAST(event_id AS VARCHAR) AS tx_id, CAST(ts AS DATE) AS op_date, CASE WHEN user_id % 4 = 0 THEN 'S' || (user_id % 90) END AS counterparty_inn,
    CASE WHEN user_id % 4 = 3 THEN 'supplier#' || lpad(CAST(user_id % 90 AS VARCHAR), 9, '0') END AS name_key,
    CASE WHEN event_type = 'signup' THEN CAST(event_id % 5 + 900000000 AS VARCHAR) WHEN user_id % 4 IN (0, 2) THEN lpad(CAST(user_id % 90 AS VARCHAR), 9, '0') END AS code,
    CASE WHEN user_id % 4 = 1 THEN CAST(event_id % 20000 AS VARCHAR) END AS deal_number,
    CASE WHEN event_type = 'purchase' THEN {_M('value')} ELSE 0 END AS debit, CASE WHEN event_type = 'error' THEN {_M('value')} ELSE 0 END AS credit, event_type = 'signup' AS is_company_side
  FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
known AS (SELECT inn, arg_min(farmer_name, source_row) AS name, min(source_row) AS ord FROM harvest WHERE inn IS NOT NULL GROUP BY 1),
by_contract AS (SELECT contract_number, arg_min(inn, source_row) AS inn FROM harvest WHERE inn IS NOT NULL GROUP BY 1),
by_code AS (SELECT code, arg_min(counterparty_inn, source_row) AS inn FROM payments WHERE code IS NOT NULL AND counterparty_inn IN (SELECT inn FROM known) GROUP BY 1),
by_name AS (SELECT lower(farmer_name) AS key, min(inn) AS inn FROM harvest WHERE inn IS NOT NULL GROUP BY 1 HAVING min(inn) = max(inn)),
matched AS (
  SELECT p.*, p.debit - p.credit AS net, coalesce(k.inn, c.inn, a.inn, n.inn) AS match_inn,
    CASE WHEN k.inn IS NOT NULL THEN 'INN' WHEN c.inn IS NOT NULL THEN 'CONTRACT' WHEN a.inn IS NOT NULL THEN 'ACCOUNT' WHEN n.inn IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS match_method
  FROM payments p LEFT JOIN known k ON k.inn = p.counterparty_inn LEFT JOIN by_contract c ON c.contract_number = p.deal_number
    LEFT JOIN by_code a ON a.code = p.code LEFT JOIN by_name n ON n.key = p.name_key WHERE NOT is_company_side),
shipments AS (
  SELECT o_orderkey AS source_row, CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS deal, CAST(o_orderkey % 1000 AS VARCHAR) AS contract_number, 'seller ' || (o_orderkey % 97) AS seller_name,
    CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS status, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.0002 AS DECIMAL(18,3)) AS shipment_kg,
    CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.0004 AS DECIMAL(18,3)) AS deal_kg, {_M('o_totalprice')} AS cost, CAST(o_orderdate AS DATE) AS document_date FROM orders),
deals AS (
  SELECT deal, arg_min(b.inn, source_row) FILTER (WHERE true) AS x, min(b.inn) AS match_inn, CASE WHEN min(b.inn) IS NULL THEN 'NONE' ELSE 'CONTRACT' END AS match_method, arg_min(seller_name, source_row) AS seller_name,
    arg_min(deal_kg, source_row) AS deal_kg, string_agg(DISTINCT s.contract_number, ', ' ORDER BY s.contract_number) AS clearing_contracts, string_agg(DISTINCT status, ', ' ORDER BY status) AS statuses,
    count(*) AS documents, coalesce(sum(shipment_kg) FILTER (WHERE status = 'ACTIVE'), 0) AS shipped_kg, coalesce(sum(cost) FILTER (WHERE status = 'ACTIVE'), 0) AS shipped_value,
    max(document_date) AS last_document_date, count(DISTINCT deal_kg) > 1 AS deal_kg_differs FROM shipments s LEFT JOIN by_contract b ON b.contract_number = s.deal GROUP BY 1),
deal_rows AS (
  SELECT d.*, q.qty AS contract_kg, coalesce(a.kg, 0) AS accepted_kg, coalesce(p.net, 0) AS paid_net FROM deals d
    LEFT JOIN (SELECT contract_number, arg_min(contract_qty_t, source_row) * 1000 AS qty FROM harvest GROUP BY 1) q ON q.contract_number = d.deal
    LEFT JOIN (SELECT contract_number, sum(conditioned_kg) AS kg FROM counted GROUP BY 1) a ON a.contract_number = d.deal
    LEFT JOIN (SELECT deal_number, sum(net) AS net FROM matched WHERE deal_number IS NOT NULL GROUP BY 1) p ON p.deal_number = d.deal),
directory AS (
  SELECT s_suppkey AS ord, r_name AS section, n_name AS block, CASE WHEN s_suppkey % 7 = 6 THEN 'Old ' || s_name ELSE s_name END AS display_name, CASE WHEN s_suppkey % 5 <> 4 AND s_suppkey % 7 <> 6 THEN 'S' || s_suppkey END AS tax_id, abs(CAST(s_acctbal AS DECIMAL(18,3))) AS plan_t
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 10000000, r_name, n_name, c_name, 'C' || c_custkey, abs(CAST(c_acctbal AS DECIMAL(18,3)))
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
linked AS (
  SELECT k.inn, k.name, coalesce(i.ord, n.ord) AS entry_ord, CASE WHEN i.ord IS NOT NULL THEN 'INN' WHEN n.ord IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS link
  FROM known k LEFT JOIN directory i ON i.tax_id = k.inn LEFT JOIN directory n ON i.ord IS NULL AND n.tax_id IS NULL AND lower(n.display_name) = lower(k.name)),
links AS (SELECT * FROM linked UNION ALL SELECT NULL, NULL, ord, 'NOT_IN_BASKET' FROM directory WHERE ord NOT IN (SELECT entry_ord FROM linked WHERE entry_ord IS NOT NULL)),
cells AS (
  SELECT inn, acceptance_date, sum(CASE WHEN method = 'HAND' THEN conditioned_kg ELSE 0 END) AS hand_kg, sum(CASE WHEN method = 'HAND' THEN coalesce(amount, 0) ELSE 0 END) AS hand_sum,
    sum(CASE WHEN method = 'HAND' THEN 0 ELSE conditioned_kg END) AS machine_kg, sum(CASE WHEN method = 'HAND' THEN 0 ELSE coalesce(amount, 0) END) AS machine_sum
  FROM counted WHERE inn IS NOT NULL GROUP BY 1, 2),
lines AS (
  SELECT coalesce(l.inn, e.tax_id) AS inn, entry_ord, link, coalesce(section, '{S.UNASSIGNED}') AS section, coalesce(block, '{S.UNASSIGNED}') AS block, coalesce(e.display_name, l.name) AS display_name,
    CASE WHEN l.name IS NOT NULL THEN coalesce(pl.plan_t, 0) ELSE coalesce(e.plan_t, 0) END AS plan_t, coalesce(pl.n, 0) AS contracts, coalesce(c.hand_kg, 0) AS hand_kg, coalesce(c.machine_kg, 0) AS machine_kg,
    coalesce(c.th, 0) AS today_hand_kg, coalesce(c.tm, 0) AS today_machine_kg, coalesce(c.money, 0) AS sum_100, coalesce(p.total, 0) AS paid_total, coalesce(p.today, 0) AS paid_today,
    coalesce(s.kg, 0) AS shipped_kg, coalesce(s.value, 0) AS shipped_value, coalesce(s.n, 0) AS deals, CAST(round(CAST(coalesce(c.money, 0) AS DECIMAL(24,0)) * 0.2, 0) AS DECIMAL(24,0)) AS sum_20
  FROM links l LEFT JOIN directory e ON e.ord = l.entry_ord
  LEFT JOIN (SELECT inn, sum(hand_kg) AS hand_kg, sum(machine_kg) AS machine_kg, sum(hand_sum + machine_sum) AS money, sum(hand_kg) FILTER (WHERE acceptance_date = DATE '1998-06-15') AS th,
      sum(machine_kg) FILTER (WHERE acceptance_date = DATE '1998-06-15') AS tm FROM cells GROUP BY 1) c ON c.inn = coalesce(l.inn, e.tax_id)
  LEFT JOIN (SELECT inn, sum(CASE WHEN t IN ('1-URGENT', '2-HIGH') THEN q ELSE 0 END) AS plan_t, count(*) AS n FROM
      (SELECT inn, contract_number, arg_min(contract_qty_t, source_row) AS q, arg_min(contract_type, source_row) AS t FROM harvest WHERE inn IS NOT NULL GROUP BY 1, 2) GROUP BY 1) pl ON pl.inn = coalesce(l.inn, e.tax_id)
  LEFT JOIN (SELECT match_inn, sum(net) AS total, coalesce(sum(net) FILTER (WHERE op_date = DATE '1998-06-15'), 0) AS today FROM matched WHERE match_inn IS NOT NULL GROUP BY 1) p ON p.match_inn = coalesce(l.inn, e.tax_id)
  LEFT JOIN (SELECT match_inn, sum(shipped_kg) AS kg, sum(shipped_value) AS value, count(*) AS n FROM deal_rows WHERE match_inn IS NOT NULL GROUP BY 1) s ON s.match_inn = coalesce(l.inn, e.tax_id)),
full_lines AS (SELECT *, sum_20 - paid_total AS picking_balance, hand_kg + machine_kg AS total_kg,
    round((CAST(hand_kg + machine_kg AS DOUBLE) / 10) / CASE WHEN plan_t > 0 THEN CAST(plan_t AS DOUBLE) END, 4) AS achieved_pct FROM lines)"""
#: Lines take their day from the harvest.
LINE_DAY = datetime.date(1998, 6, 15)
SUMS = ", ".join(d(f"sum({c})", c) for c in S.SUMS)


class _Report:
    """The frames of one report. Those that several others are made of are written once to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def harvest(self) -> DataFrame:
        return written(S.row_state(T.harvest(self.spark, self.dir)), "harvest")

    @cached_property
    def payments(self) -> DataFrame:
        return written(T.payments(self.spark, self.dir), "payments")

    @cached_property
    def counted(self) -> DataFrame:
        return self.harvest.where("countable")

    @cached_property
    def totals(self) -> DataFrame:
        """Everything that lines, deals and matching ask of the harvest, from one pass."""
        return written(S.harvest_totals(S.row_state(T.harvest(self.spark, self.dir)), LINE_DAY), "totals", by="part")

    @cached_property
    def index(self) -> S.Index:
        found = S.index_of(self.totals, self.payments)
        return replace(found, keys=written(found.keys, "keys"))

    @cached_property
    def matched(self) -> DataFrame:
        return written(S.matched_payments(self.payments, self.index), "matched")

    @cached_property
    def deals(self) -> DataFrame:
        return written(S.deals(T.shipments(self.spark, self.dir), self.index, self.totals, None, self.matched), "deals")

    @cached_property
    def directory(self) -> DataFrame:
        return written(T.directory(self.spark, self.dir), "directory")

    @cached_property
    def links(self) -> DataFrame:
        return written(S.farmer_links(self.totals, self.directory), "links")

    @cached_property
    def lines(self) -> DataFrame:
        return written(S.farmer_lines(self.totals, None, self.directory, self.matched, self.deals, LINE_DAY, CFG, self.links), "lines")

    @cached_property
    def counted_contracts(self) -> DataFrame:
        return self.totals.where("part = 'contract' and counted > 0").select("contract_number")


@query(f"""WITH {SOURCES} SELECT op_date, count(*) AS legs, {d('sum(debit - credit)', 'net')} FROM payments WHERE NOT is_company_side GROUP BY 1""")
def net_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Report(spark, sf_dir).matched.groupBy("op_date").agg(F.count("*").alias("legs"), F.sum("net").alias("net"))


@query(f"""WITH {SOURCES} SELECT match_inn AS inn, {d('sum(net)', 'paid_total')}, {d(f"coalesce(sum(net) FILTER (WHERE op_date = DATE '{DAY}'), 0)", 'paid_today')} FROM matched WHERE match_inn IS NOT NULL GROUP BY 1""")
def payments_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paid_by(_Report(spark, sf_dir).matched, "match_inn", DAY).withColumnRenamed("key", "inn")


@query(f"WITH {SOURCES} SELECT match_inn AS inn, {d('sum(net)', 'paid_total')} FROM matched WHERE match_inn IS NOT NULL GROUP BY 1 HAVING sum(net) <> 0 ORDER BY sum(net) DESC, 1 LIMIT 10")
def top_paid_farmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = S.paid_by(_Report(spark, sf_dir).matched, "match_inn", DAY).where("paid_total <> 0")
    return R.top_k(paid, 10, F.desc("paid_total"), F.col("key")).select(F.col("key").alias("inn"), "paid_total")


@query(f"WITH {SOURCES} SELECT count(*) AS legs, {d('sum(debit)', 'debit')}, {d('sum(credit)', 'credit')} FROM payments WHERE is_company_side")
def owner_leg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.owner_legs(T.payments(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT match_method, count(*) AS n, count(DISTINCT match_inn) AS farmers, {d('sum(net)', 'net')} FROM matched GROUP BY 1")
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Report(spark, sf_dir).matched.groupBy("match_method").agg(F.count("*").alias("n"), F.count_distinct("match_inn").alias("farmers"), F.sum("net").alias("net"))


@query(f"WITH {SOURCES} SELECT code, inn FROM by_code")
def learned_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Report(spark, sf_dir).index.accounts


@query("""SELECT '999999999' AS code, 'OWNER' AS owner UNION ALL SELECT DISTINCT CAST(event_id % 5 + 900000000 AS VARCHAR), 'OWNER' FROM events WHERE event_type = 'signup'""")
def owner_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.owner_bridge(T.payments(spark, sf_dir), F.col("source_row"))


@query(f"WITH {SOURCES} SELECT key, inn FROM by_name")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unique_names(T.harvest(spark, sf_dir)).select("key", "inn")


@query("""WITH words AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS turned FROM part), keys AS (SELECT p_name AS k, min(p_partkey) AS inn FROM part GROUP BY 1)
    SELECT name, turned, inn FROM words JOIN (SELECT array_to_string(list_sort(string_split(k, ' ')), ' ') AS t, arg_min(inn, k) AS inn FROM keys GROUP BY 1) ON t = array_to_string(list_sort(string_split(turned, ' ')), ' ')""")
def name_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    asked = parts.select(F.col("p_name").alias("name"), F.concat_ws(" ", words[1], words[0]).alias("turned")).distinct()
    names = parts.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("inn"))
    loose = names.withColumn("tokens", F.array_join(F.array_sort(F.split("key", " ")), " "))
    exact = loose.where("false")
    return M.name_match(asked, "turned", exact.unionByName(loose.withColumn("key", F.concat(F.lit("~"), "key")))).select("name", "turned", F.col("name_inn").alias("inn"))


@query("""WITH asked AS (SELECT DISTINCT p_name || 's' AS key FROM part), names AS (SELECT DISTINCT p_name AS candidate_key FROM part),
    pairs AS (SELECT key, candidate_key FROM asked CROSS JOIN names),
    x AS (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS a, array_to_string(list_sort(string_split(candidate_key, ' ')), ' ') AS b FROM pairs),
    y AS (SELECT *, round(1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)), 4) AS similarity FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, candidate_key DESC) AS k FROM y) SELECT key, candidate_key, similarity FROM z WHERE k = 1""")
def fuzzy_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_name").alias("inn")).distinct()
    asked = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("s")).alias("name")).distinct()
    return M.candidates(asked, "name", names).select("key", "candidate_key", "similarity")


DEAL = f"""deal, match_inn, match_method, {d('shipped_kg')}, {d('shipped_value')}, clearing_contracts, statuses, documents, last_document_date, deal_kg_differs, {d('contract_kg')}, {d('deal_kg')}, {d('accepted_kg')}, {d('paid_net')}"""
DEAL_COLUMNS = [
    "deal", "match_inn", "match_method", "shipped_kg", "shipped_value", "clearing_contracts", "statuses", "documents",
    "last_document_date", "deal_kg_differs", "contract_kg", "deal_kg", "accepted_kg", "paid_net",
]


@query(f"WITH {SOURCES} SELECT {DEAL} FROM deal_rows")
def deal_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Report(spark, sf_dir).deals.select(*DEAL_COLUMNS)


@query(f"WITH {SOURCES} SELECT {DEAL} FROM deal_rows r ORDER BY r.shipped_kg DESC, deal LIMIT 14")
def top_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_Report(spark, sf_dir).deals.select(*DEAL_COLUMNS), 14, F.desc("shipped_kg"), F.col("deal"))


@query(f"""WITH {SOURCES}, i AS (SELECT deal, unnest([CASE WHEN match_inn IS NULL THEN 'SHIPMENT_NOT_MATCHED' END, CASE WHEN abs(contract_kg - deal_kg) > 1 THEN 'CONTRACT_QTY_MISMATCH' END,
    CASE WHEN deal_kg_differs THEN 'DEAL_QTY_INCONSISTENT' END]) AS code FROM deal_rows) SELECT code, count(*) AS n, min(deal) AS sample FROM i WHERE code IS NOT NULL GROUP BY 1""")
def deal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.issues(_Report(spark, sf_dir).deals, S.deal_rules(), "MATCHING", F.lit(None).cast("long"), F.col("deal"))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("ref").alias("sample"))


@query(f"""WITH {SOURCES} SELECT coalesce(match_inn, 'name:' || seller_name) AS farmer_key, count(*) AS deals, {", ".join(d(f'coalesce(sum({c}), 0)', c) for c in ('contract_kg', 'deal_kg', 'shipped_kg', 'accepted_kg', 'shipped_value', 'paid_net'))} FROM deal_rows GROUP BY 1""")
def farmer_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shipment_farmers(_Report(spark, sf_dir).deals)


ACCOUNTS = """accounts AS (SELECT s_suppkey AS source_row, CASE WHEN s_suppkey % 10 = 0 THEN CAST(s_suppkey % 5 + 900000000 AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS code,
    CASE s_suppkey % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'BLOCKED' ELSE 'IN_TRANSIT' END AS category, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 100 AS DECIMAL(20,0)) AS balance,
    CASE WHEN s_suppkey % 4 = 1 THEN 'S' || s_suppkey END AS holder_inn, CASE WHEN s_suppkey % 4 = 2 THEN lower(s_name) END AS holder_key FROM supplier),
  owned AS (SELECT a.*, CASE WHEN k.inn IS NOT NULL THEN 'FARMER' WHEN o.code IS NOT NULL THEN 'OWNER' WHEN coalesce(c.inn, n.inn) IS NOT NULL THEN 'FARMER' ELSE 'UNKNOWN' END AS owner_kind,
    CASE WHEN k.inn IS NOT NULL THEN k.inn WHEN o.code IS NOT NULL THEN 'OWNER' ELSE coalesce(c.inn, n.inn) END AS owner_inn FROM accounts a LEFT JOIN known k ON k.inn = a.holder_inn
    LEFT JOIN (SELECT DISTINCT code FROM payments WHERE is_company_side) o ON o.code = a.code LEFT JOIN by_code c ON c.code = a.code LEFT JOIN by_name n ON n.key = a.holder_key)"""


def _owned(spark: SparkSession, sf_dir: str, report: _Report | None = None) -> DataFrame:
    report = report or _Report(spark, sf_dir)
    return S.account_owners(T.accounts(spark, sf_dir), report.payments, report.index)


@query(f"WITH {SOURCES}, {ACCOUNTS} SELECT source_row, owner_inn, owner_kind FROM owned")
def account_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).select("source_row", "owner_inn", "owner_kind")


@query(f"WITH {SOURCES}, {ACCOUNTS} SELECT category, {d('sum(balance)', 'balance')} FROM owned WHERE owner_kind = 'OWNER' GROUP BY 1")
def account_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.account_totals(_owned(spark, sf_dir))


@query(f"WITH {SOURCES}, {ACCOUNTS} SELECT 'ACCOUNT_NOT_MATCHED' AS code, count(*) AS n FROM owned WHERE owner_kind = 'UNKNOWN' HAVING count(*) > 0")
def account_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(S.account_issues(_owned(spark, sf_dir)), "code")


def _placed(rows: DataFrame) -> DataFrame:
    """-1 in the place of a missing entry, so that the column stays whole numbers wherever it is shown."""
    return rows.withColumn("entry_ord", F.coalesce("entry_ord", F.lit(-1)).cast("long"))


LINE = f"""inn, CAST(coalesce(entry_ord, -1) AS BIGINT) AS entry_ord, link, section, block, display_name, contracts, deals, {", ".join(d(c) for c in S.SUMS)}, {d('total_kg')}, achieved_pct"""


@query(f"WITH {SOURCES} SELECT {LINE} FROM full_lines")
def settlement_line_20pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_Report(spark, sf_dir).lines)


@query(f"""WITH {SOURCES}, single AS (SELECT section FROM lines GROUP BY 1 HAVING count(DISTINCT block) = 1 AND min(block) = section)
    SELECT CASE WHEN grouping(section) = 1 THEN 'grand' WHEN grouping(block) = 1 THEN 'section' ELSE 'block' END AS level, section, block, count(*) AS farmers, {SUMS} FROM full_lines GROUP BY ROLLUP (section, block)
    HAVING NOT (grouping(block) = 0 AND section IN (SELECT section FROM single))""")
def hierarchical_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subtotals(_Report(spark, sf_dir).lines)


@query(f"WITH {SOURCES} SELECT inn, CAST(coalesce(entry_ord, -1) AS BIGINT) AS entry_ord, block, row_number() OVER (PARTITION BY section, block ORDER BY entry_ord IS NULL, entry_ord, display_name, inn) AS number_in_block FROM full_lines")
def number_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(S.layout(_Report(spark, sf_dir).lines)).select("inn", "entry_ord", "block", F.col("number_in_block").cast("long").alias("number_in_block"))


@query(f"""WITH {SOURCES} SELECT block, min(section) AS section, {d('sum(total_kg)', 'total_kg')}, {d('sum(today_hand_kg + today_machine_kg)', 'today_kg')}, count(*) FILTER (WHERE total_kg > 0) AS farmers FROM full_lines GROUP BY 1""")
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.region_totals(_Report(spark, sf_dir).lines)


@query(f"""WITH {SOURCES}, b AS (SELECT block, sum(total_kg) AS total_kg FROM full_lines GROUP BY 1 HAVING sum(total_kg) > 0) SELECT block, {d('total_kg')} FROM b ORDER BY b.total_kg DESC, block""")
def region_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.region_totals(_Report(spark, sf_dir).lines).where("total_kg > 0")
    return rows.orderBy(F.desc("total_kg"), "block").select("block", "total_kg")


@query(f"""WITH {SOURCES}, {ACCOUNTS} SELECT {d('sum(today_hand_kg)', 'today_hand_kg')}, {d('sum(today_machine_kg)', 'today_machine_kg')}, {d('sum(today_hand_kg + today_machine_kg)', 'today_total_kg')},
    {d('sum(hand_kg)', 'season_hand_kg')}, {d('sum(machine_kg)', 'season_machine_kg')}, {d('sum(total_kg)', 'season_total_kg')}, count(*) FILTER (WHERE total_kg > 0) AS farmers_with_harvest,
    count(*) FILTER (WHERE today_hand_kg + today_machine_kg > 0) AS farmers_today, {d('sum(paid_today)', 'paid_today')}, {d('sum(paid_total)', 'paid_total')}, {d('sum(picking_balance)', 'picking_balance')},
    (SELECT count(DISTINCT contract_number) FROM counted) AS contracts, (SELECT round(CAST(sum(shipped_kg) AS DOUBLE), 4) FROM deal_rows) AS shipped_kg, (SELECT round(CAST(sum(shipped_value) AS DOUBLE), 4) FROM deal_rows) AS shipped_value,
    (SELECT count(*) FROM deal_rows) AS shipment_deals, (SELECT round(CAST(coalesce(sum(balance), 0) AS DOUBLE), 4) FROM owned WHERE owner_kind = 'OWNER' AND category = 'FREE') AS rkp_free_balance FROM full_lines""")
def kpi_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _Report(spark, sf_dir)
    return S.kpis(report.lines, report.counted_contracts, report.deals, S.account_totals(_owned(spark, sf_dir, report)))


@query(f"WITH {SOURCES} SELECT inn, name, CAST(coalesce(entry_ord, -1) AS BIGINT) AS entry_ord, link FROM links")
def directory_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _Report(spark, sf_dir)
    known = report.harvest.where("inn is not null").groupBy("inn").agg(F.min_by("farmer_name", "source_row").alias("name"), F.min("source_row").alias("ord"))
    return _placed(M.link_directory(known, report.directory))


@query(f"WITH {SOURCES} SELECT inn, name FROM links WHERE link = 'NONE'")
def unassigned_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_full_outer(spark, sf_dir).where("link = 'NONE'").select("inn", "name")


@query(f"WITH {SOURCES} SELECT CASE link WHEN 'NAME' THEN 'DIRECTORY_LINKED_BY_NAME' ELSE 'FARMER_NOT_MATCHED' END AS code, count(*) AS n FROM links WHERE link IN ('NAME', 'NONE') GROUP BY 1")
def directory_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(S.directory_issues(directory_full_outer(spark, sf_dir)), "code")


@query(f"WITH {SOURCES} SELECT l.inn, l.display_name, {d('l.plan_t', 'plan_t')}, {d('e.plan_t', 'directory_plan_t')} FROM lines l JOIN directory e ON l.display_name = e.display_name AND l.block = e.block WHERE link <> 'NOT_IN_BASKET' AND abs(e.plan_t - l.plan_t) > 0.001")
def plan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _Report(spark, sf_dir)
    return S.plan_differences(report.lines, report.directory)


@query(f"""WITH {SOURCES}, e AS (SELECT min(acceptance_date) AS a, max(acceptance_date) AS b FROM cells), c AS (SELECT CAST(unnest(generate_series(a, greatest(b, DATE '{LINE_DAY}'), INTERVAL 1 DAY)) AS DATE) AS acceptance_date FROM e),
    t AS (SELECT acceptance_date, coalesce(sum(hand_kg), 0) AS hand_kg, coalesce(sum(machine_kg), 0) AS machine_kg FROM c LEFT JOIN cells USING (acceptance_date) GROUP BY 1)
    SELECT acceptance_date, {d('hand_kg')}, {d('machine_kg')}, {d('hand_kg + machine_kg', 'total_kg')}, {d('sum(hand_kg + machine_kg) OVER (ORDER BY acceptance_date)', 'cumulative_kg')} FROM t""")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_series(S.day_cells(_Report(spark, sf_dir).counted), LINE_DAY)


DAYS = [LINE_DAY + datetime.timedelta(n) for n in range(4)]


@query(f"""WITH {SOURCES} SELECT inn, {", ".join(f"round(CAST(sum(hand_kg) FILTER (WHERE acceptance_date = DATE '{x}') AS DOUBLE), 4) AS \"{x}_hand_kg\", round(CAST(sum(machine_kg) FILTER (WHERE acceptance_date = DATE '{x}') AS DOUBLE), 4) AS \"{x}_machine_kg\"" for x in DAYS)} FROM cells GROUP BY 1""")
def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_days(S.day_cells(_Report(spark, sf_dir).counted), DAYS)


@query(f"""WITH {SOURCES} SELECT inn, display_name, {d('today_hand_kg + today_machine_kg', 'today_kg')} FROM full_lines l WHERE today_hand_kg + today_machine_kg > 0 ORDER BY l.today_hand_kg + l.today_machine_kg DESC, inn LIMIT 25""")
def deliverers_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _Report(spark, sf_dir).lines.select("inn", "display_name", (F.col("today_hand_kg") + F.col("today_machine_kg")).alias("today_kg"))
    return R.top_k(rows.where("today_kg > 0"), 25, F.desc("today_kg"), F.col("inn"))


HARVEST_RULES = """CASE WHEN inn IS NULL THEN 'MISSING_INN' END, CASE WHEN conditioned_kg = 0 AND pk17 IS NULL THEN 'CONDITIONED_WEIGHT_PENDING' END, CASE WHEN conditioned_kg = 0 AND pk17 IS NOT NULL THEN 'INVALID_WEIGHT' END,
    CASE WHEN method = 'UNKNOWN' THEN 'UNKNOWN_HARVEST_TYPE' END, CASE WHEN amount IS NULL AND pk17 IS NOT NULL THEN 'INVALID_AMOUNT' END, CASE WHEN amount IS NULL AND pk17 IS NULL THEN 'AMOUNT_PENDING' END"""


@query(f"WITH {SOURCES}, i AS (SELECT unnest([{HARVEST_RULES}]) AS code FROM harvest) SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1")
def harvest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = S.row_state(T.harvest(spark, sf_dir))
    return R.counts_by(Q.issues(state, S.harvest_rules(), "BASKET", F.col("source_row"), F.col("contract_number")), "code")


@query(f"""WITH {SOURCES}, k AS (SELECT CASE WHEN inn IS NULL OR (conditioned_kg = 0 AND pk17 IS NOT NULL) OR method = 'UNKNOWN' OR (amount IS NULL AND pk17 IS NOT NULL) THEN 'critical' WHEN conditioned_kg = 0 THEN 'pending' ELSE 'valid' END AS k FROM harvest)
    SELECT count(*) FILTER (WHERE k = 'critical') AS critical, count(*) FILTER (WHERE k = 'pending') AS pending, count(*) FILTER (WHERE k = 'valid') AS valid FROM k""")
def harvest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.harvest_counters(S.row_state(T.harvest(spark, sf_dir)))


@query("SELECT l_suppkey AS inn, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def names_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.name_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("inn"), F.col("l_partkey").alias("farmer_name")))


@query(f"WITH {SOURCES} SELECT 'PAYMENT_NOT_MATCHED' AS code, count(*) AS n FROM matched WHERE match_inn IS NULL HAVING count(*) > 0")
def payment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _Report(spark, sf_dir)
    return R.counts_by(S.payment_issues(report.matched, report.index), "code")


@query(f"WITH {SOURCES} SELECT {d('sum(debit)', 'debit')}, sum(debit) <> 100 AS mismatch FROM payments")
def statement_footer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statement_check(T.payments(spark, sf_dir), F.lit(100))


@query(f"WITH {SOURCES} SELECT tx_id, name FROM matched JOIN known ON inn = match_inn")
def display_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _Report(spark, sf_dir)
    return report.matched.join(report.index.farmers.withColumnRenamed("inn", "match_inn"), "match_inn").select("tx_id", "name")


@query(f"WITH {SOURCES} SELECT inn, display_name, block FROM full_lines WHERE block = 'NATION_3' AND lower(display_name || ' ' || inn) LIKE '%1%'")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(_Report(spark, sf_dir).lines, "1", "NATION_3").select("inn", "display_name", "block")


@query(f"""WITH {SOURCES} SELECT inn, section, block, display_name, round(CAST(sum_100 AS DOUBLE) / 100, 2) AS sum_100, round(CAST(paid_total AS DOUBLE) / 100, 2) AS paid_total,
    round(CAST(total_kg AS DOUBLE) / 1000, 6) AS total_t, achieved_pct FROM full_lines""")
def web_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the JSON finds in it: every line, names and numbers."""
    kept = F.from_json("json", "inn string, section string, block string, display_name string, sum_100 double, paid_total double, total_t double, achieved_pct double")
    rows = S.web_view(_Report(spark, sf_dir).lines).select(kept.alias("x")).select("x.*")
    return rows.withColumns({"sum_100": F.round("sum_100", 2), "paid_total": F.round("paid_total", 2), "total_t": F.round("total_t", 6)})


# Stored tables: two batches made of the same orders, with corrections, repeats, new and missing keys.
BATCHES = """raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS natural_key, CAST(o_custkey AS VARCHAR) AS who, o_orderstatus AS st, o_orderpriority AS note, o_orderkey AS ord FROM orders),
  old AS (SELECT natural_key, who AS fingerprint, note FROM raw WHERE st <> 'P'),
  batch AS (SELECT natural_key, CASE WHEN st = 'F' AND note = '1-URGENT' THEN 'new' || who ELSE who END AS fingerprint, 'second' AS note, ord FROM raw WHERE st <> 'F' OR note <> '5-LOW'
    UNION ALL SELECT natural_key, 'again', 'third', ord + 0.5 FROM raw WHERE st = 'P'),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY ord) AS k FROM batch) WHERE k = 1),
  acts AS (SELECT coalesce(once.natural_key, old.natural_key) AS natural_key, once.fingerprint AS nf, old.fingerprint AS f, once.note AS nn, old.note AS n,
    CASE WHEN old.natural_key IS NULL THEN 'INSERT' WHEN once.natural_key IS NULL THEN 'ABSENT' WHEN once.fingerprint = old.fingerprint THEN 'DUPLICATE' ELSE 'UPDATE' END AS action FROM once FULL JOIN old USING (natural_key))"""


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders: pending ones come with the second batch, twice, finished ones of low priority are gone from it, urgent finished ones are corrected."""
    status, note = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").withColumns({"natural_key": F.col("o_orderkey").cast("string"), "who": F.col("o_custkey").cast("string"), "ord": F.col("o_orderkey").cast("double")})
    old = orders.where(status != "P").select("natural_key", F.col("who").alias("fingerprint"), note.alias("note"), F.col("ord").alias("source_row"))
    corrected = F.when((status == "F") & (note == "1-URGENT"), F.concat(F.lit("new"), "who")).otherwise(F.col("who"))
    new = orders.where((status != "F") | (note != "5-LOW")).select("natural_key", corrected.alias("fingerprint"), F.lit("second").alias("note"), F.col("ord").alias("source_row"))
    again = orders.where(status == "P").select("natural_key", F.lit("again").alias("fingerprint"), F.lit("third").alias("note"), (F.col("ord") + 0.5).alias("source_row"))
    return old.withColumns({"first_batch_id": F.lit(1), "last_batch_id": F.lit(1)}), new.unionByName(again)


@query(f"WITH {BATCHES} SELECT action, count(*) AS n FROM acts GROUP BY 1 UNION ALL SELECT 'IN_FILE', (SELECT count(*) FROM batch) - (SELECT count(*) FROM once)")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return store.upsert(new, old, 2, F.col("source_row"))[1]


@query(f"""WITH {BATCHES} SELECT natural_key, CASE WHEN action IN ('INSERT', 'UPDATE') THEN nf ELSE f END AS fingerprint, CASE WHEN action IN ('INSERT', 'UPDATE') THEN nn ELSE n END AS note,
    CASE WHEN action = 'INSERT' THEN 2 ELSE 1 END AS first_batch_id, CASE WHEN action = 'ABSENT' THEN 1 ELSE 2 END AS last_batch_id FROM acts""")
def upsert_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return store.upsert(new, old, 2, F.col("source_row"))[0].drop("source_row")


@query(f"WITH {BATCHES} SELECT natural_key FROM acts WHERE action <> 'INSERT'")
def asof_union_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return store.as_of(store.upsert(new, old, 2, F.col("source_row"))[0], 1).select("natural_key")


@query(f"WITH {BATCHES} SELECT natural_key FROM acts WHERE action <> 'ABSENT'")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return store.snapshot(store.upsert(new, old, 2, F.col("source_row"))[0], 2).select("natural_key")


@query(f"WITH {BATCHES} SELECT natural_key FROM acts WHERE action = 'ABSENT'")
def removed_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return store.compare(new, old).where("action = 'ABSENT'").select("natural_key")


@query("""WITH b AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, dense_rank() OVER (ORDER BY day) AS batch_id FROM b),
    f AS (SELECT DISTINCT event_type AS file_type, CAST(ts AS DATE) AS day FROM events), j AS (SELECT file_type, batch_id, CAST(day AS VARCHAR) AS file_name FROM f JOIN n USING (day) WHERE batch_id <= 20 AND batch_id % 4 <> 0)
    SELECT file_type, max(batch_id) AS batch_id, arg_max(file_name, batch_id) AS file_name FROM j GROUP BY 1""")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "user_id")
    batches = events.select("day").distinct().withColumn("batch_id", F.dense_rank().over(R.Window.orderBy("day")).cast("long"))  # one row a day
    batches = batches.withColumn("status", F.when(F.col("batch_id") % 4 == 0, "ERROR").otherwise("COMPLETED"))
    files = events.select(F.col("event_type").alias("file_type"), "day").distinct()
    files = files.join(batches.select("day", "batch_id"), "day").select("file_type", "batch_id", F.col("day").cast("string").alias("file_name"))
    return store.current_files(files, batches.select("batch_id", "status"), 20)


@query("SELECT max(event_id) AS batch_id FROM events WHERE event_type = 'purchase' AND event_id < 5000")
def latest_batch_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("basket_file"))
    return store.latest_batch_with(rows, "basket_file", 5000)


@query("""WITH s AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS dd, CAST(sum(CAST(l_quantity AS DECIMAL(12,1))) AS DECIMAL(18,1)) AS kg FROM lineitem GROUP BY 1, 2),
    v AS (SELECT k, string_agg(CAST(dd AS VARCHAR) || '=' || kg, ';' ORDER BY dd) AS series FROM s GROUP BY 1), u AS (SELECT series, min(k) AS k FROM v GROUP BY 1 HAVING count(*) = 1) SELECT k AS left_key, -k AS right_key FROM u""")
def series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.col("l_quantity").cast("decimal(12,1)")).cast("decimal(18,1)").alias("kg"))
    return M.match_series(rows, rows.withColumn("key", -F.col("key")))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND props LIKE '%7%'")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & F.col("props").contains("7")).select("event_id")


@query("SELECT event_id, substr(sha256(coalesce(CAST(event_id AS VARCHAR), chr(0)) || chr(31) || event_type || chr(31) || props), 1, 32) AS fingerprint FROM events")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fingerprint(F.col("event_id"), F.col("event_type"), F.col("props")).alias("fingerprint"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def union_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = [events.where(F.col("event_type") == k).select(F.lit(k).alias("kind")) for k in ("purchase", "error", "click", "signup", "view")]
    return R.counts_by(reduce(DataFrame.unionByName, parts), "kind")
