"""Typed scans, rules over them, and the smaller operators, over the star-schema tables written out as the text that workbooks hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, numbers, text
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import store
from ..shared import scratch_path
from ..sources import settlement_tables as ST
from ..sources import tables as T
from ..sources import typed
from ..sources.tables import table
from . import ledger as L
from . import ledger_queries as LQ
from . import settlement as S
from . import settlement_queries as SQ
from .registry import d, query

_M = lambda c: f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS DECIMAL(20,0))"


def _no_errors() -> Column:
    """No field of the row held an error cell."""
    return F.array().cast("array<string>")


def _money(column: str) -> Column:
    return F.translate(F.col(column).cast("decimal(18,2)").cast("string"), ".", ",")


def _raw_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a bank statement: clicks on a day that is none, sign-ups without a day and with an error cell, errors without money."""
    kind = F.col("event_type")
    day = (
        F.when(kind == "click", "31.02.2024").when(kind == "error", F.date_format("ts", "dd.MM.yyyy, HH:mm:ss"))
        .when(kind == "purchase", F.date_format("ts", "HH:mm:ss dd-MM-yyyy")).when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_row"), F.col("event_id").cast("string").alias("tx_id"), day.alias("op_datetime"),
        F.concat(F.lit("C:"), F.col("user_id").cast("string"), F.lit("; D: "), F.col("event_id").cast("string"), F.lit("; ")).alias("attributes"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("counterparty_name"), F.concat(F.lit(" 30 "), F.col("user_id").cast("string")).alias("counterparty_inn"),
        F.lit("2020 8000 000000001").alias("counterparty_account"), F.lit(None).cast("string").alias("account_name"),
        F.when(kind.isin("purchase", "view"), _money("value")).alias("debit"), F.when(kind == "click", _money("value")).alias("credit"),
        F.when(kind == "view", "Возврат").otherwise(F.concat(F.lit("Оплата, с/ф № A"), F.col("event_id").cast("string"))).alias("details"),
        F.when(kind == "signup", F.array(F.lit("debit"))).otherwise(_no_errors()).alias("bad_cells"),
    )


STATEMENT = f"""legs AS (SELECT event_id AS source_row, CAST(event_id AS VARCHAR) AS tx_id, event_type, CASE WHEN event_type NOT IN ('click', 'signup') THEN CAST(ts AS DATE) END AS op_date,
    '30' || user_id AS counterparty_inn, CASE WHEN event_type IN ('purchase', 'view') THEN {_M('value')} ELSE 0 END AS debit, CASE WHEN event_type = 'click' THEN {_M('value')} ELSE 0 END AS credit,
    CAST(event_id AS VARCHAR) AS deal_number, CAST(user_id AS VARCHAR) AS clearing_contract, CASE WHEN event_type <> 'view' THEN 'A' || event_id END AS invoice_no, event_type = 'view' AS is_reversal,
    user_id = 5 AS is_company_side, event_type IN ('error', 'signup') OR value < 0 AS amount_invalid FROM events)"""


@query(f"""WITH {STATEMENT} SELECT tx_id, op_date, counterparty_inn, {d('debit')}, {d('credit')}, deal_number, clearing_contract, invoice_no, is_reversal, is_company_side, 'tx:' || tx_id AS natural_key FROM legs""")
def statement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = typed.statement(_raw_statement(spark, sf_dir), "305", "2020")
    return legs.select("tx_id", "op_date", "counterparty_inn", "debit", "credit", "deal_number", "clearing_contract", "invoice_no", "is_reversal", "is_company_side", "natural_key")


@query(f"""WITH {STATEMENT}, f AS (SELECT sum(debit) FILTER (WHERE event_type = 'purchase') AS footer, sum(debit) AS total FROM legs)
    SELECT 'CRITICAL' AS severity, 'INVALID_DATE' AS code, count(*) AS n FROM legs WHERE event_type = 'click' UNION ALL SELECT 'CRITICAL', 'MISSING_DATE', count(*) FROM legs WHERE event_type = 'signup'
    UNION ALL SELECT 'CRITICAL', 'INVALID_AMOUNT', count(*) FROM legs WHERE amount_invalid UNION ALL SELECT 'WARNING', 'STATEMENT_TOTAL_MISMATCH', count(*) FROM f WHERE footer <> total""")
def statement_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footer is the sum of purchases, so it lacks the views."""
    raw = _raw_statement(spark, sf_dir)
    legs = typed.statement(raw, "305", "2020")
    footer = table(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("string").alias("debit"))
    found = Q.issues(legs, typed.statement_rules(), "PAYMENTS", F.col("source_row"), F.col("tx_id"))
    return R.counts_by(found.unionByName(typed.statement_total_issue(legs, footer)), "severity", "code")


def _raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("s_suppkey").cast("string"), F.col("s_nationkey") % 4
    names = F.when(kind == 0, "Свободные средства").when(kind == 1, "Блокированные средства").when(kind == 2, "Средства в пути").otherwise("Прочее")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_row"), F.concat(F.lit("2020800"), key, F.lit(" (UZS)")).alias("bank_account"), names.alias("account_name"), F.concat(F.lit("2020 "), key).alias("account"),
        F.when(F.col("s_nationkey") != 7, _money("s_acctbal")).alias("balance"), F.when(F.col("s_acctbal") > 0, " Да").otherwise("нет").alias("is_default"),
        F.concat(F.lit(" 3 "), key).alias("holder_inn"), F.col("s_name").alias("holder_name"), _no_errors().alias("bad_cells"),
    )


@query(f"""SELECT s_suppkey AS source_row, '2020800' || s_suppkey AS bank_account, 'UZS' AS currency, CASE s_nationkey % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'IN_TRANSIT' ELSE 'OTHER' END AS category,
    '2020' || s_suppkey AS account, CAST(round(CASE WHEN s_nationkey <> 7 THEN {_M('s_acctbal')} ELSE 0 END, 4) AS DOUBLE) AS balance, s_acctbal > 0 AS is_default, '3' || s_suppkey AS holder_inn FROM supplier""")
def accounts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.accounts(_raw_accounts(spark, sf_dir)).drop("account_name", "balance_invalid", "holder_name")


@query("SELECT 'INVALID_AMOUNT' AS code, count(*) AS n FROM supplier WHERE s_nationkey = 7 HAVING count(*) > 0")
def account_amount_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(Q.issues(typed.accounts(_raw_accounts(spark, sf_dir)), typed.account_rules(), "ACCOUNTS", F.col("source_row"), F.col("account")), "code")


def _raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, state, key = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    unit = F.when(level == "1-URGENT", "тн").when(level == "2-HIGH", "кг.").when(level == "3-MEDIUM", "tonna").when(level == "5-LOW", "dona").otherwise("kg")
    price = _money("o_totalprice")
    qty = F.when((state == "O") & (level == "5-LOW"), F.concat(F.lit("-"), price)).when((state == "F") & (level == "5-LOW"), F.lit(None)).otherwise(price)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_row"), key.alias("deal_number"), F.date_format("o_orderdate", "dd.MM.yy").alias("deal_date"), key.alias("clearing_contract"), F.lit("Seller").alias("seller_name"),
        F.lit("Buyer").alias("buyer_name"), F.lit("cotton").alias("product_name"), F.concat(F.lit("doc"), key).alias("document_number"),
        F.when(state == "P", "30.02.2024").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("document_date"), qty.alias("shipment_qty"), price.alias("delivery_cost"),
        price.alias("deal_qty"), price.alias("deal_amount"), unit.alias("unit"), F.when(state == "F", "Одобрено").when(state == "O", " PENDING ").otherwise("?").alias("status"), _no_errors().alias("bad_cells"),
    )


SHIPPED = """x AS (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 1000 ELSE 1 END AS f, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders),
  docs AS (SELECT *, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN -price * f WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE price * f END AS kg FROM x)"""


@query(f"""WITH {SHIPPED} SELECT o_orderkey AS source_row, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS document_date, {d('kg', 'shipment_kg')}, {d('price * f', 'deal_kg')}, {d(_M('price'), 'delivery_cost')},
    CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PENDING' ELSE 'UNKNOWN' END AS status,
    'shp:' || o_orderkey || ':doc' || o_orderkey || ':' || coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, '') AS natural_key FROM docs""")
def shipments_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.shipments(_raw_shipments(spark, sf_dir)).select("source_row", "document_date", "shipment_kg", "deal_kg", "delivery_cost", "status", "natural_key")


@query(f"""WITH {SHIPPED}, i AS (SELECT unnest([CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN_UNIT' END, CASE WHEN o_orderstatus = 'P' THEN 'INVALID_DATE' END, CASE WHEN kg < 0 THEN 'NEGATIVE_WEIGHT' END,
    CASE WHEN kg IS NULL THEN 'INVALID_WEIGHT' END, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN_STATUS' END]) AS code FROM docs) SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1""")
def shipment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(Q.issues(typed.shipments(_raw_shipments(spark, sf_dir)), typed.shipment_rules(), "SHIPMENTS", F.col("source_row"), F.col("deal_number")), "code")


def _raw_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of a basket; a farmer's name goes with the return flag, so most ids bear several."""
    method = F.when(F.col("l_linestatus") == "O", "Qo'l terimi").when(F.col("l_returnflag") == "R", "Машина терими").otherwise("—")
    key = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey") % 100000).alias("source_row"), F.concat(F.lit("S "), key("l_suppkey")).alias("tax_id"),
        F.when(F.col("l_returnflag") == "A", '"ALFA" FX').otherwise("Beta fx").alias("farmer_name"), F.lit("r").alias("region"), F.lit("d").alias("district"), F.lit("t").alias("contract_type"),
        key("l_orderkey").alias("contract_number"), F.lit("10,5").alias("contract_qty"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("acceptance_date"), key("l_linenumber").alias("record_no"),
        F.lit(None).cast("string").alias("pk17_number"), method.alias("method"), _money("l_quantity").alias("physical_kg"), _money("l_quantity").alias("conditioned_kg"), F.lit("1").alias("unit_price"),
        _money("l_extendedprice").alias("amount"), F.lit("b").alias("buyer_name"), F.when(F.col("l_quantity") == 13, F.array(F.lit("amount"))).otherwise(_no_errors()).alias("bad_cells"),
    )


@query(f"""SELECT CASE WHEN l_linestatus = 'O' THEN 'HAND' WHEN l_returnflag = 'R' THEN 'MACHINE' ELSE 'UNKNOWN' END AS method, count(*) AS n, count(DISTINCT l_suppkey) AS farmers, count(DISTINCT (l_orderkey, l_linenumber)) AS records,
    {d('sum(CAST(l_quantity AS DECIMAL(18,3)))', 'kg')}, {d(f"sum(CASE WHEN l_quantity <> 13 THEN {_M('l_extendedprice')} END)", 'amount')}, min(CAST(l_shipdate AS DATE)) AS first_day FROM lineitem GROUP BY 1""")
def basket_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.basket(_raw_basket(spark, sf_dir)).groupBy("method").agg(
        F.count("*").alias("n"), F.count_distinct("inn").alias("farmers"), F.count_distinct("natural_key").alias("records"), F.sum("conditioned_kg").alias("kg"), F.sum("amount").alias("amount"), F.min("acceptance_date").alias("first_day")
    )


@query("""WITH s AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag = 'A') > 1), r AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS row FROM lineitem),
    f AS (SELECT *, min(row) OVER (PARTITION BY l_orderkey, l_linenumber) AS first FROM r)
    SELECT * FROM (SELECT 'NAME_MISMATCH' AS code, count(*) AS n FROM s UNION ALL SELECT 'DUPLICATE', count(*) FROM f WHERE row <> first) WHERE n > 0""")
def harvest_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(S.harvest_repeats(typed.basket(_raw_basket(spark, sf_dir))), "code")


def _raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a ledger, some without a farmer, one column that no field knows, and a totals row."""
    key = lambda c: F.col(c).cast("string")
    line = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey") % 100000).alias("source_row"), F.when(F.col("l_quantity") != 13, F.concat(F.lit(" F"), key("l_suppkey"))).alias("farmer_name"),
        key("l_orderkey").alias("contract_number"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("acceptance_date"), key("l_linenumber").alias("acceptance_record_no"), F.lit("-").alias("pk17_number"),
        F.date_format("l_shipdate", "10:20:30 dd.MM.yyyy").alias("pk17_registered_at"), key("l_quantity").alias("physical_kg"), key("l_quantity").alias("conditioned_kg"), key("l_extendedprice").alias("amount"), F.lit("2").alias("trailer_count"),
    )
    total = line.agg(F.sum(F.col("conditioned_kg").cast("double")).cast("string").alias("conditioned_kg")).withColumns({"farmer_name": F.lit("Жами:"), "source_row": F.lit(10**15)})
    rows = line.withColumn("row_kind", F.lit("data")).unionByName(total.withColumn("row_kind", F.lit("footer")), allowMissingColumns=True)
    return rows.withColumns({"file": F.lit("ledger.xlsx"), "unknown_headers": F.array(F.lit("Бошқа")), "notes": F.array(F.lit("HEADER_BOUNDARY_GUESSED"))})


@query(f"""SELECT 'F' || l_suppkey AS farmer_name, count(*) AS n, {d('sum(CAST(l_quantity AS DECIMAL(18,3)))', 'kg')}, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE) + INTERVAL '10:20:30' HOUR TO SECOND) AS last_time, count(*) * 2 AS trailers
    FROM lineitem WHERE l_quantity <> 13 GROUP BY 1""".replace("INTERVAL '10:20:30' HOUR TO SECOND", "to_seconds(37230)"))
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.ledger(_raw_ledger(spark, sf_dir).where("row_kind = 'data'")).groupBy("farmer_name").agg(
        F.count("*").alias("n"), F.sum(F.col("conditioned_kg").cast("decimal(18,3)")).alias("kg"), F.min("acceptance_date").alias("first_day"), F.max("pk17_registered_at").alias("last_time"), F.sum("trailer_count").cast("long").alias("trailers")
    )


@query("""WITH r AS (SELECT *, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS row FROM lineitem WHERE l_quantity <> 13),
    f AS (SELECT row, min(row) OVER (PARTITION BY l_suppkey, l_orderkey, CAST(l_shipdate AS DATE), l_linenumber, l_quantity) AS first FROM r)
    SELECT * FROM (SELECT 'MISSING_FARMER_NAME' AS code, count(*) AS n FROM lineitem WHERE l_quantity = 13 UNION ALL SELECT 'DUPLICATE_OPERATION', count(*) FROM f WHERE row <> first
    UNION ALL VALUES ('GRAND_TOTAL_ROW_SKIPPED', 1), ('COLUMN_NOT_MAPPED', 1), ('HEADER_BOUNDARY_GUESSED', 1)) WHERE n > 0""")
def ledger_parse_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(typed.ledger_issues(_raw_ledger(spark, sf_dir)), "code")


@query(f"""SELECT s_suppkey AS ord, CASE WHEN s_acctbal > 0 THEN r_name ELSE n_name END AS section, n_name AS block, s_name AS display_name, '4' || s_suppkey AS tax_id, {d('CAST(s_acctbal AS DECIMAL(18,2))', 'plan_t')}
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey").cast("string")
    raw = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit(1).alias("source_row"), key.alias("ord"), F.concat(F.lit(" "), F.col("s_name")).alias("display_name"), F.when(F.col("s_acctbal") > 0, F.col("r_name")).otherwise(" ").alias("section"), F.col("n_name").alias("region_block"),
        F.concat(F.lit("4 "), key).alias("tax_id"), _money("s_acctbal").alias("plan_t"), F.lit(None).cast("string").alias("basket_name"), F.lit(None).cast("string").alias("match_method"), F.lit("0,9").alias("confidence"),
    )
    return typed.directory(raw).drop("basket_name", "match_method", "confidence")


@query(f"WITH {SQ.SOURCES} SELECT inn, {d('sum(conditioned_kg)', 'unknown_kg')} FROM harvest WHERE method = 'UNKNOWN' AND conditioned_kg > 0 AND inn IS NOT NULL GROUP BY 1")
def unknown_method_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unknown_method(ST.harvest(spark, sf_dir))


@query(f"WITH {SQ.SOURCES} SELECT inn, display_name, {d('total_kg')} FROM full_lines l WHERE total_kg > 0 ORDER BY l.total_kg DESC, display_name, inn LIMIT 12")
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_lines(SQ._Report(spark, sf_dir).lines).select("inn", "display_name", "total_kg")


@query(f"WITH {SQ.SOURCES} SELECT greatest(count(*) - 25, 0) AS rest FROM full_lines WHERE total_kg > 0")
def lines_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.beyond(SQ._Report(spark, sf_dir).lines.where("total_kg > 0"), 25)


@query(f"WITH {SQ.SOURCES} SELECT count(*) AS farmers, {SQ.SUMS} FROM full_lines WHERE block = 'NATION_3'")
def filtered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filtered_totals(S.search(SQ._Report(spark, sf_dir).lines, block="NATION_3"))


@query(f"""WITH {SQ.SOURCES} SELECT inn, display_name FROM full_lines WHERE lower(concat_ws(' ', display_name, inn)) LIKE '%77%' OR inn IN (SELECT inn FROM harvest WHERE inn IS NOT NULL AND contract_number LIKE '%77%')""")
def search_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = SQ._Report(spark, sf_dir)
    return S.search(report.lines, "77", contracts=report.harvest.select("inn", "contract_number")).select("inn", "display_name")


@query(f"""WITH {SQ.SOURCES} SELECT tx_id FROM matched m LEFT JOIN known k ON k.inn = m.match_inn
    WHERE lower(concat_ws(' ', CASE WHEN name_key IS NOT NULL THEN '"' || name_key || '" mchj' END, counterparty_inn, deal_number, k.name)) LIKE '%#00000001%'""")
def payment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = SQ._Report(spark, sf_dir)
    return S.search_payments(report.matched, report.index.farmers, "#00000001").select("tx_id")


@query(f"WITH {SQ.SOURCES} SELECT 'PLAN_DIFFERS_FROM_DIRECTORY' AS code, count(*) AS n FROM lines l JOIN directory e ON l.display_name = e.display_name AND l.block = e.block WHERE link <> 'NOT_IN_BASKET' AND abs(e.plan_t - l.plan_t) > 0.001 HAVING count(*) > 0")
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = SQ._Report(spark, sf_dir)
    return R.counts_by(S.plan_issues(S.plan_differences(report.lines, report.directory)), "code")


@query(f"WITH {SQ.BATCHES} SELECT 'DIRECTORY_MISSING' AS code, CAST(NULL AS VARCHAR) AS message UNION ALL SELECT 'REMOVED_FROM_SOURCE', CAST(count(*) AS VARCHAR) FROM acts WHERE action = 'ABSENT' HAVING count(*) > 0")
def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = SQ._batches(spark, sf_dir)
    return S.report_issues(ST.directory(spark, sf_dir).where("false"), store.compare(R.first_of_each(new, ["natural_key"], ["source_row"]), old)).select("code", "message")


@query(f"WITH {LQ.DATA_ALERTS} SELECT severity, count(*) AS n FROM found GROUP BY 1")
def issue_counts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.by_severity(LQ._data_issues(spark, sf_dir))


@query(f"WITH {LQ.DATA_ALERTS} SELECT code, count(*) AS n FROM found WHERE severity = 'YELLOW' GROUP BY 1")
def picked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(Q.picked(LQ._data_issues(spark, sf_dir), "YELLOW", "LEDGER"), "code")


@query(f"""WITH {LQ.OPS}, i AS (SELECT unnest([CASE WHEN amount < 50000 THEN 'NEGATIVE_VALUE unit_price' END, CASE WHEN contract_qty IS NULL THEN 'MISSING_CONTRACT_QTY' END, CASE WHEN conditioned_kg - 10 < 0 THEN 'NEGATIVE_VALUE conditioned_kg' END,
    CASE WHEN conditioned_kg - 10 <= 0 THEN 'INVALID_OPERATION_ROW' END]) AS code FROM star) SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1""")
def import_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices less 50 000 and weights less 10, so that some are below 0."""
    rows = T.operations(spark, sf_dir).withColumns({"unit_price": F.col("amount") - 50000, "conditioned_kg": F.col("conditioned_kg") - 10})
    found = Q.issues(rows, L.import_rules(rows.columns), "LEDGER", F.col("record_no"), F.col("contract_number"))
    return R.counts_by(found.select(F.concat_ws(" ", "code", "message").alias("code")), "code")


@query("""WITH i AS (SELECT unnest([CASE WHEN l_returnflag = 'N' THEN 'MISSING_PK17' END, CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN 'PK17_UNSIGNED' END, CASE WHEN l_quantity < 10 THEN 'MISSING_VEHICLE' END]) AS code FROM lineitem)
    SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1""")
def alerts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber"), F.when(F.col("l_returnflag") != "N", "p1").alias("pk17_number"), F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("pk17_signed_at"), F.when(F.col("l_quantity") < 10, " ").otherwise("01 A").alias("vehicle_plate")
    )
    return R.counts_by(Q.issues(rows, L.document_rules(), "LEDGER", F.col("l_linenumber"), F.lit(None)), "code")


@query(f"WITH {LQ.OPS} SELECT 'GRAND_TOTAL_MISMATCH' AS code FROM ops WHERE occurrence = 1 HAVING abs(CAST(sum(conditioned_kg) AS DOUBLE) - 1000) > 50")
def grand_total_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.mark_repeats(T.raw_operations(spark, sf_dir), L.KEY, ["source_row"])
    return L.total_issue(L.reconcile_total(rows, 1000.0)).select("code")


@query("""WITH s AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS dd, CAST(sum(CAST(l_quantity AS DECIMAL(12,1))) AS DECIMAL(18,1)) AS kg FROM lineitem GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dd) AS i, count(*) OVER (PARTITION BY k) AS days FROM s)
    SELECT k AS left_key, -k AS right_key, CASE WHEN k % 3 = 0 THEN 'SERIES' WHEN k % 3 = 1 AND days > 4 THEN 'LEADING_DAYS' ELSE 'NAME' END AS way FROM (SELECT DISTINCT k, days FROM n)""")
def series_or_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the reports are whole, a third end after four days, a third differ on every day."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.col("l_quantity").cast("decimal(12,1)")).cast("decimal(18,1)").alias("kg"))
    numbered = rows.withColumn("i", F.row_number().over(R.Window.partitionBy("key").orderBy("day")))
    kg = F.when(F.col("key") % 3 == 2, F.col("kg") + F.col("key")).otherwise(F.col("kg"))
    left = numbered.where((F.col("key") % 3 != 1) | (F.col("i") <= 4)).select("key", "day", kg.alias("kg"))
    names = lambda sign: rows.select((F.col("key") * sign).alias("key"), F.concat(F.lit('"Farm '), F.col("key").cast("string"), F.lit('" FX')).alias("name")).distinct()
    return M.match_series_or_names(left, rows.withColumn("key", -F.col("key")), names(1), names(-1))


@query("""SELECT 'first' AS reading, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n UNION ALL SELECT 'second', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'redone', (SELECT count(*) FROM orders) UNION ALL SELECT 'log', 3""")
def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, one of them done again under its number, and a log of it."""
    root, log = scratch_path(spark, "store"), scratch_path(spark, "log")
    orders, out = table(spark, sf_dir, "orders"), []
    for reading, test, version in (("first", "o_orderstatus = 'F'", 1), ("second", "o_orderstatus <> 'P'", 2), ("redone", "true", 2)):
        store.publish(orders.where(test), root, version, replace=True)
        store.append_log(spark.range(1).select(F.lit(reading).alias("event")), log)
        out.append(store.read(spark, root, version).agg(F.count("*").alias("n")).select(F.lit(reading).alias("reading"), "n"))
    out.append(spark.read.parquet(log).agg(F.count("*").alias("n")).select(F.lit("log").alias("reading"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS contract_number, {d("CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(14,2)) + 1 WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) ELSE CAST(o_totalprice AS DECIMAL(14,2)) END", 'contract_qty')} FROM orders""")
def contract_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders come with one more, finished ones with nothing or as they are; pending ones are new."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(14,2)")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("contract_number"), status.alias("status"), price.alias("price"), F.col("o_orderpriority").alias("level"))
    stored = orders.where("status <> 'P'").select("contract_number", F.col("price").alias("contract_qty"))
    came = F.when(F.col("status") == "O", F.col("price") + 1).when((F.col("status") == "F") & (F.col("level") == "1-URGENT"), F.lit(None)).otherwise(F.col("price"))
    return store.contract_dimension(orders.select("contract_number", came.cast("decimal(14,2)").alias("contract_qty")), stored, F.col("contract_number"))


@query("""SELECT n_nationkey AS id, lower(n_name) || ' (x) е' AS header, CASE WHEN n_regionkey <> 1 THEN n_name END AS kept, '12' || n_nationkey AS tax_id FROM nation""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), text.ledger_header_key(F.concat(F.lit("  "), name, F.lit(", (X):  Ё. "))).alias("header"),
        text.blank_to_null(F.when(F.col("n_regionkey") == 1, " НЕТ ").otherwise(F.concat(F.lit(" "), name))).alias("kept"), keys.tax_id(F.concat(F.lit(" 1 2 "), F.col("n_nationkey").cast("string"))).alias("tax_id"),
    )


@query("""SELECT p_partkey AS id, p_size AS whole, CAST(CAST(p_retailprice AS DECIMAL(18,3)) AS DOUBLE) AS kg, round(CAST(CAST(p_retailprice AS DECIMAL(18,3)) / 1000 AS DOUBLE), 4) AS t,
    replace(replace(replace(format('{:,.2f}', p_retailprice), ',', '_'), '.', ','), '_', ' ') AS shown FROM part""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    kg = numbers.kilograms(price)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), numbers.loose_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).cast("int").alias("whole"), kg.cast("double").alias("kg"),
        F.round(numbers.tons(kg).cast("double"), 4).alias("t"), numbers.grouped(price).alias("shown"),
    )


@query("""WITH t AS (SELECT l_suppkey AS id, CAST(sum(l_quantity) AS DOUBLE) AS top FROM lineitem GROUP BY 1), x AS (SELECT id, top / 5 AS raw, pow(10.0, floor(log10(top / 5))) AS p FROM t)
    SELECT id, CASE WHEN raw / p <= 1 THEN 1.0 WHEN raw / p <= 2 THEN 2.0 WHEN raw / p <= 2.5 THEN 2.5 WHEN raw / p <= 5 THEN 5.0 ELSE 10.0 END * p AS step FROM x""".replace("1.0 WHEN", "CAST(1 AS DOUBLE) WHEN"))
def axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("top"))
    return tops.select("id", numbers.axis_step(F.col("top")).alias("step"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30') ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS written,
    date_trunc('day', o_orderdate) + to_seconds(50700) AS banner FROM orders""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's loose times, and a banner with day, month and clock whose year comes from the data."""
    day = F.col("o_orderdate")
    months = F.array(*[F.lit(m.capitalize()) for m in dates.MONTHS])
    banner = F.concat(F.lit("as of "), F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(months, F.month(day)), F.lit(", 14:05"))
    written = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "'10:20:30 'dd.MM.yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.loose_datetime_text(written).alias("written"), dates.banner_time(banner, F.year(day)).alias("banner"))
