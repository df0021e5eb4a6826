"""The daily report over a small scenario worked out by hand; ids and names are invented."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import quality as Q
from tallyfield.plans import settlement as S

D1, D2 = datetime.date(2026, 9, 18), datetime.date(2026, 9, 19)
HARVEST = (
    "source_row long, inn string, farmer_name string, contract_number string, contract_qty_t decimal(18,3), contract_type string, acceptance_date date, date_invalid boolean, "
    "method_raw string, method string, pk17 string, physical_kg decimal(18,3), conditioned_kg decimal(18,3), amount decimal(20,0)"
)
PAYMENTS = (
    "source_row long, tx_id string, op_date date, counterparty_inn string, counterparty_name string, counterparty_account string, deal_number string, debit decimal(20,0), credit decimal(20,0), "
    "is_company_side boolean, statement_account string, client_inn string"
)
SHIPMENTS = "source_row long, deal_number string, contract_number string, seller_name string, seller_inn string, status string, shipment_kg decimal(18,3), delivery_cost decimal(20,0), deal_kg decimal(18,3), deal_amount decimal(20,0), document_date date"
DIRECTORY = "ord long, section string, block string, display_name string, basket_name string, tax_id string, plan_t decimal(18,3)"
OWN = ("2020 900000001", "77")


def kg(x):
    return None if x is None else Decimal(str(x))


@pytest.fixture(scope="module")
def report(spark):
    rows = [
        (1, "11", "ALFA FX", "501", kg(10), "Fyuchers", D1, False, "q", "HAND", "1", kg(4200), kg(4090), 321555800000),
        (2, "11", "ALFA FX", "501", kg(10), "Fyuchers", D2, False, "m", "MACHINE", "2", kg(2000), kg(2000), 100),
        (3, "11", "ALFA MCHJ", "502", kg(5), "Forvard", D2, False, "q", "HAND", "3", kg(10), kg(10), None),
        (4, "22", "BETA", "601", kg(7), "Fyuchers", D2, False, "q", "HAND", None, kg(33), kg(33), 3),
        (5, "22", "BETA", "601", kg(7), "Fyuchers", D2, False, None, "UNKNOWN", None, None, None, None),
        (6, None, "GAMMA", None, None, None, D2, False, "q", "HAND", "6", kg(5), kg(5), 5),
        (7, "33", "DELTA", "701", kg(1), "Saqlash", None, True, "q", "HAND", "7", kg(9), kg(9), -1),
        (8, "33", "DELTA", "701", kg(1), "Saqlash", D2, False, "x", "UNKNOWN", "8", kg(9), kg(-9), 9),
    ]
    legs = [
        (1, "t1", D2, "11", "Alfa", "2020 000000011", None, 500, 0, False, *OWN),
        (2, "t2", D2, "77", "OWNER", "2020 900000002", None, 0, 500, True, *OWN),
        (3, "t3", D1, None, None, None, "601", 40, 0, False, *OWN),
        (4, "t4", D2, None, None, "2020 000000011", None, 0, 100, False, *OWN),
        (5, "t5", D2, None, "beta FX", None, None, 7, 0, False, *OWN),
        (6, "t6", D2, None, "nobody", None, None, 9, 0, False, *OWN),
    ]
    ships = [
        (1, "501", "9", "ALFA", None, "ACTIVE", kg(100), 1000, kg(10000), 1, D1),
        (2, "501", "8", "ALFA", None, "PENDING", kg(50), 500, kg(10000), 1, D2),
        (3, "999", "7", "Beta", None, "ACTIVE", kg(20), 200, kg(20), 1, D1),
        (4, None, "7", "stranger", None, "ACTIVE", kg(1), 2, kg(1), 1, D1),
    ]
    entries = [
        (1, "North", "Aa", "Alfa farm", None, "11", kg(10)),
        (2, "North", "Bb", "Beta", None, None, kg(3)),
        (3, "South", "South", "Empty farm", None, "99", kg(2)),
    ]
    def make(rows, schema):
        money = [" decimal(20,0)" in f for f in schema.split(", ")]
        return spark.createDataFrame([tuple(Decimal(v) if m and v is not None else v for v, m in zip(r, money, strict=True)) for r in rows], schema)

    harvest, payments = make(rows, HARVEST), make(legs, PAYMENTS)
    state = S.row_state(harvest)
    counted = state.where("countable")
    index = S.index_of(harvest, payments)
    matched = S.matched_payments(payments, index)
    deals = S.deals(make(ships, SHIPMENTS), index, harvest, counted, matched)
    directory = make(entries, DIRECTORY)
    lines = S.farmer_lines(harvest, counted, directory, matched, deals, D2).cache()
    return {"harvest": harvest, "state": state, "payments": payments, "counted": counted, "matched": matched, "deals": deals, "directory": directory, "lines": lines, "index": index}


def test_states(report):
    assert [r["source_row"] for r in report["counted"].orderBy("source_row").collect()] == [1, 2, 3, 4, 6]
    found = Q.issues(report["state"], S.harvest_rules(), "BASKET", F.col("source_row"), F.col("contract_number"))
    by = {(r["row"], r["code"]) for r in found.collect()}
    assert by == {
        (3, "INVALID_AMOUNT"), (5, "PENDING_WEIGHING"), (6, "MISSING_INN"), (6, "MISSING_CONTRACT"), (7, "INVALID_DATE"), (7, "INVALID_AMOUNT"), (8, "NEGATIVE_WEIGHT"), (8, "UNKNOWN_HARVEST_TYPE"),
    }
    assert tuple(S.harvest_counters(report["state"]).first()) == (4, 1, 3)
    assert [tuple(r) for r in S.name_conflicts(report["harvest"]).collect()] == [("11", 2)]


def test_matching(report):
    got = {r["tx_id"]: (r["match_inn"], r["match_method"], r["confidence"], int(r["net"])) for r in report["matched"].collect()}
    assert got == {
        "t1": ("11", "INN", 1.0, 500), "t3": ("22", "CONTRACT", 0.95, 40), "t4": ("11", "ACCOUNT", 0.9, -100), "t5": ("22", "NAME", 0.8, 7), "t6": (None, "NONE", 0.0, 9),
    }
    own = S.owner_legs(report["payments"]).first()
    assert (own["legs"], int(own["debit"]), int(own["credit"])) == (1, 0, 500)


def test_deals(report):
    got = {r["deal"]: r for r in report["deals"].collect()}
    assert set(got) == {"501", "999", "—"}
    alfa = got["501"]
    assert (alfa["match_inn"], alfa["match_method"], alfa["documents"], alfa["statuses"], alfa["clearing_contracts"]) == ("11", "CONTRACT", 2, "ACTIVE, PENDING", "8, 9")
    assert (alfa["shipped_kg"], alfa["contract_kg"], alfa["accepted_kg"]) == (kg("100.000"), kg("10000.000"), kg("6090.000"))
    assert (got["999"]["match_inn"], got["999"]["match_method"]) == ("22", "NAME")
    codes = {(r["ref"], r["code"]) for r in Q.issues(report["deals"], S.deal_rules(), "M", F.lit(0), F.col("deal")).collect()}
    assert codes == {("999", "CONTRACT_NOT_FOUND"), ("—", "SHIPMENT_NOT_MATCHED")}


def test_lines(report):
    got = {r["display_name"]: r for r in report["lines"].collect()}
    assert set(got) == {"Alfa farm", "Beta", "Empty farm", "DELTA"}
    alfa = got["Alfa farm"]
    # 4 090 kg at 786 200 units; a fifth of the whole, rounded once for the farmer
    assert (int(alfa["sum_100"]), int(alfa["sum_20"])) == (321555800100, 64311160020)
    assert (int(alfa["paid_total"]), int(alfa["paid_today"]), int(alfa["picking_balance"])) == (400, 400, 64311159620)
    assert (alfa["plan_t"], alfa["total_kg"], alfa["today_machine_kg"], alfa["contracts"]) == (kg("10.000"), kg("6100.000"), kg("2000.000"), 2)
    assert alfa["achieved_pct"] == 61.0
    assert (got["Beta"]["link"], got["Empty farm"]["link"], got["DELTA"]["link"]) == ("NAME", "NOT_IN_BASKET", "NONE")
    assert (got["Empty farm"]["plan_t"], got["DELTA"]["plan_t"], got["DELTA"]["section"]) == (kg("2.000"), kg("0.000"), S.UNASSIGNED)
    assert int(got["Beta"]["sum_20"]) == 1  # a fifth of 3 is 0.6


def test_subtotals(report):
    rows = {(r["level"], r["section"], r["block"]): r for r in S.subtotals(report["lines"]).collect()}
    assert set(rows) == {
        ("block", "North", "Aa"), ("block", "North", "Bb"), ("section", "North", None), ("section", "South", None), ("section", S.UNASSIGNED, None), ("grand", None, None),
    }
    assert int(rows["grand", None, None]["sum_20"]) == 64311160021  # the sum of rounded shares
    numbers = {r["display_name"]: r["number_in_block"] for r in S.layout(report["lines"]).collect()}
    assert numbers["Alfa farm"] == 1 and numbers["Beta"] == 1


def test_days_and_view(report):
    cells = S.day_cells(report["counted"])
    days = [(r["acceptance_date"], r["total_kg"], r["cumulative_kg"]) for r in S.daily_series(cells, datetime.date(2026, 9, 20)).orderBy("acceptance_date").collect()]
    assert [(d.day, float(a), float(b)) for d, a, b in days] == [(18, 4090.0, 4090.0), (19, 2043.0, 6133.0), (20, 0.0, 6133.0)]
    wide = S.wide_days(cells, [D1, D2])
    assert {r["inn"]: r[f"{D2}_machine_kg"] for r in wide.collect()}["11"] == kg("2000.000")
    assert S.search(report["lines"], "ALFA", today_only=True).count() == 1
    assert [r["inn"] for r in S.plan_differences(report["lines"], report["directory"]).collect()] == ["22"]


def test_report_names():
    day, at = datetime.date(2026, 9, 19), datetime.time(14, 5)
    assert S.report_name(day, at, 0) == "Кунлик_терим_2026-09-19"
    assert S.report_name(day, at, 2) == "Кунлик_терим_2026-09-19_14-05"


def test_workbook_bundles(spark, sf):
    from tallyfield.plans import ledger, ledger_queries, settlement_queries
    from tallyfield.sources import settlement_tables, tables

    ten = ledger.sheets(ledger_queries.marked(spark, sf), tables.contracts(spark, sf), ledger_queries.DAY)
    assert list(ten) == ["summary", "contracts", "farmers", "clusters", "acceptance", "quality", "finance", "control", "raw_data", "data_dictionary"]
    assert all(not frame.isEmpty() for frame in ten.values())
    r = settlement_queries._Report(spark, sf)
    lines, cells = r.lines, S.day_cells(r.counted)
    nine = S.sheets(
        lines, cells, settlement_queries.DAYS, settlement_queries.LINE_DAY, r.matched, settlement_tables.shipments(spark, sf), r.deals,
        S.payment_issues(r.matched, r.index), spark.createDataFrame([("basket", 1)], "file string, batch int"),
    )
    assert len(nine) == 9 and nine["daily"].count() == lines.count()
    assert all(not frame.isEmpty() for frame in nine.values())
