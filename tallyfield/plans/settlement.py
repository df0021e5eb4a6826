"""The daily report from four sources: harvest, payments, accounts, shipments, and a directory.

harvest: source_row, inn, farmer_name, contract_number, contract_qty_t, contract_type, acceptance_date, date_invalid,
method_raw, method, pk17, physical_kg, conditioned_kg, amount (minor units), region.
payments: source_row, tx_id, op_date, counterparty_inn, counterparty_name, counterparty_account, deal_number,
debit, credit (minor units), is_company_side, statement_account, client_inn.
shipments: source_row, deal_number, contract_number, seller_name, seller_inn, status, shipment_kg, delivery_cost,
deal_kg, deal_amount, document_date. accounts: source_row, account, category, balance, holder_inn, holder_name.
directory: ord, section, block, display_name, basket_name, tax_id, plan_t.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.numbers import MINOR, percent_of
from ..functions.text import party_key
from ..operators import matching as M
from ..operators.quality import Rule, issues, united

UNASSIGNED = "Ҳудуди аниқланмаган"
KG = "decimal(28,3)"


def plan_type(column: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.coalesce(F.lower(column).rlike("|".join(cfg.plan_types)), F.lit(False))


def row_state(harvest: DataFrame) -> DataFrame:
    """harvest with not_weighed and countable. A critical issue alone doesn't keep a row from counting."""
    weight = F.coalesce("conditioned_kg", F.lit(0))
    idle = (weight == 0) & (F.coalesce("method_raw", F.lit("")) == "") & (F.coalesce("pk17", F.lit("")) == "")
    counts = ~idle & F.col("acceptance_date").isNotNull() & ~F.coalesce("date_invalid", F.lit(False)) & (weight > 0) & (F.col("method") != "UNKNOWN")
    return harvest.withColumns({"not_weighed": idle, "countable": F.coalesce(counts, F.lit(False))})


def harvest_rules() -> list[Rule]:
    """Rules over rows of row_state()."""
    weight, physical = F.coalesce("conditioned_kg", F.lit(0)), F.coalesce("physical_kg", F.lit(0))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    weighed = ~F.col("not_weighed")
    below = (weight < 0) | (physical < 0)
    bad_date = F.coalesce("date_invalid", F.lit(False))
    return [
        Rule("CRITICAL", "MISSING_INN", none("inn")),
        Rule("CRITICAL", "MISSING_CONTRACT", none("contract_number")),
        Rule("CRITICAL", "INVALID_DATE", bad_date),
        Rule("CRITICAL", "MISSING_DATE", ~bad_date & F.col("acceptance_date").isNull()),
        Rule("INFO", "PENDING_WEIGHING", F.col("not_weighed")),
        Rule("CRITICAL", "NEGATIVE_WEIGHT", weighed & below),
        Rule("WARNING", "CONDITIONED_WEIGHT_PENDING", weighed & ~below & (weight == 0) & none("pk17")),
        Rule("CRITICAL", "INVALID_WEIGHT", weighed & ~below & (weight == 0) & ~none("pk17")),
        Rule("CRITICAL", "UNKNOWN_HARVEST_TYPE", weighed & (F.col("method") == "UNKNOWN")),
        Rule("CRITICAL", "INVALID_AMOUNT", weighed & ((F.col("amount").isNull() & ~none("pk17")) | (F.col("amount") < 0))),
        Rule("WARNING", "AMOUNT_PENDING", weighed & F.col("amount").isNull() & none("pk17")),
    ]


def harvest_counters(state: DataFrame) -> DataFrame:
    """(critical, pending, valid): each row in the first of them that holds."""
    critical = None
    for r in harvest_rules():
        if r.severity == "CRITICAL":
            hit = F.coalesce(r.condition, F.lit(False))
            critical = hit if critical is None else critical | hit
    pending = F.col("not_weighed") | (F.coalesce("conditioned_kg", F.lit(0)) == 0)
    kind = F.when(critical, "critical").when(pending, "pending").otherwise("valid")
    return state.select(kind.alias("k")).agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("critical", "pending", "valid")])


def name_conflicts(harvest: DataFrame) -> DataFrame:
    """(inn, n): tax ids with more than one name."""
    names = harvest.where("inn is not null").select("inn", "farmer_name").distinct()
    return names.groupBy("inn").agg(F.count("*").alias("n")).where("n > 1")


def day_cells(counted: DataFrame) -> DataFrame:
    """(inn, acceptance_date, hand_kg, hand_sum, machine_kg, machine_sum); a method that isn't HAND is MACHINE."""
    hand = F.col("method") == "HAND"
    kg, money = F.col("conditioned_kg").cast(KG), F.coalesce("amount", F.lit(0)).cast(MINOR)
    add = lambda test, value, name, kind: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast(kind).alias(name)
    return counted.where("inn is not null").groupBy("inn", "acceptance_date").agg(
        add(hand, kg, "hand_kg", KG), add(hand, money, "hand_sum", MINOR), add(~hand, kg, "machine_kg", KG), add(~hand, money, "machine_sum", MINOR)
    )


def harvest_totals(state: DataFrame, report_date: datetime.date) -> DataFrame:
    """One pass over row_state(): a row for each farmer and name, each farmer and contract, and each contract, told apart by `part`.

    lead: number, quantity and type of the first row; owner: number and tax id of the first row that has one; then what countable rows
    add up to. GROUPING SETS send a row once for each of the three, added up before the shuffle; everything that the report
    asks of the harvest, but days, follows from these rows.
    """
    hand, today = F.col("method") == "HAND", F.col("acceptance_date") == F.lit(report_date)
    counts, kg, money = F.col("countable"), F.col("conditioned_kg").cast(KG), F.coalesce("amount", F.lit(0)).cast(MINOR)
    add = lambda test, value, name, kind: F.coalesce(F.sum(F.when(counts & test, value)), F.lit(0)).cast(kind).alias(name)
    sets = [[F.col("inn"), F.col("farmer_name")], [F.col("inn"), F.col("contract_number")], [F.col("contract_number")]]
    rows = state.groupingSets(sets, F.col("inn"), F.col("farmer_name"), F.col("contract_number")).agg(
        F.grouping_id().alias("_set"), F.min(F.struct("source_row", "contract_qty_t", "contract_type")).alias("lead"),
        F.min(F.when(F.col("inn").isNotNull(), F.struct("source_row", "inn"))).alias("owner"), F.count(F.when(counts, 1)).alias("counted"),
        add(hand, kg, "hand_kg", KG), add(~hand, kg, "machine_kg", KG), add(F.lit(True), money, "sum_100", MINOR),
        add(hand & today, kg, "today_hand_kg", KG), add(~hand & today, kg, "today_machine_kg", KG),
    )
    # the bits of a set say which of inn, farmer_name, contract_number it leaves out
    part = F.when(F.col("_set") == 0b001, "farmer").when(F.col("_set") == 0b010, "pair").otherwise("contract")
    known = F.when(F.col("_set") == 0b110, F.col("contract_number").isNotNull()).otherwise(F.col("inn").isNotNull() & ((F.col("_set") == 0b001) | F.col("contract_number").isNotNull()))
    return rows.where(known).withColumn("part", part).drop("_set")


def _totals(harvest: DataFrame, report_date: datetime.date | None = None) -> DataFrame:
    """harvest_totals() of a harvest, with its state or without, or what is given where it is that already."""
    if "part" in harvest.columns:
        return harvest
    return harvest_totals(harvest if "countable" in harvest.columns else row_state(harvest), report_date or datetime.date.max)


def farmer_names(totals: DataFrame) -> DataFrame:
    """(inn, farmer_name, source_row): every name of every farmer with the first row that has it."""
    return totals.where("part = 'farmer'").select("inn", "farmer_name", F.col("lead.source_row").alias("source_row"))


@dataclass
class Index:
    """What rows of other sources are matched against; keys: all of it in one table."""

    farmers: DataFrame
    contracts: DataFrame
    accounts: DataFrame
    names: DataFrame
    keys: DataFrame


def index_of(harvest: DataFrame, payments: DataFrame) -> Index:
    """harvest: as such, or its harvest_totals()."""
    totals, order = _totals(harvest), F.col("source_row")
    written_names = farmer_names(totals)
    known, names = M.farmers(written_names, order), M.unique_names(written_names)
    contracts = totals.where("part = 'contract' and owner is not null").select(F.col("contract_number").alias("contract"), F.col("owner.inn").alias("inn"))
    accounts = M.account_bridge(payments, known, order)
    return Index(known, contracts, accounts, names, M.match_keys(known, contracts, accounts, names))


def matched_payments(payments: DataFrame, index: Index) -> DataFrame:
    """Legs of others than the owner, with their net and the farmer that they match."""
    legs = payments.where(~F.coalesce("is_company_side", F.lit(False))).withColumn("net", (F.col("debit") - F.col("credit")).cast(MINOR))
    return M.match(legs, index.keys, "counterparty_inn", "deal_number", "counterparty_account", "counterparty_name")


def owner_legs(payments: DataFrame) -> DataFrame:
    own = payments.where(F.coalesce("is_company_side", F.lit(False)))
    return own.agg(F.count("*").alias("legs"), *[F.coalesce(F.sum(c), F.lit(0)).cast(MINOR).alias(c) for c in ("debit", "credit")])


def paid_by(matched: DataFrame, key: str, report_date: datetime.date) -> DataFrame:
    rows = matched.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    return rows.agg(
        F.sum("net").cast(MINOR).alias("paid_total"), F.coalesce(F.sum(F.when(F.col("op_date") == F.lit(report_date), F.col("net"))), F.lit(0)).cast(MINOR).alias("paid_today")
    )


def deals(shipments: DataFrame, index: Index, harvest: DataFrame, counted: DataFrame | None, matched: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A row for each deal: what its first shipment says, and what its counted shipments add up to.

    harvest: as such, or its harvest_totals(); what counts is in either, so counted is not looked at.
    """
    rows = shipments.withColumn("deal", F.coalesce("deal_number", F.lit("—")))
    rows = M.match(rows, index.keys, "seller_inn", "deal_number", None, "seller_name")
    counts = F.col("status").isin(*cfg.counted_statuses)
    first = F.min_by(F.struct("match_inn", "match_method", "confidence", "seller_name", "deal_kg", "deal_amount"), "source_row")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    out = rows.groupBy("deal").agg(
        first.alias("f"), listed("contract_number").alias("clearing_contracts"), listed("status").alias("statuses"), F.count("*").alias("documents"),
        F.coalesce(F.sum(F.when(counts, F.col("shipment_kg"))), F.lit(0)).cast(KG).alias("shipped_kg"),
        F.coalesce(F.sum(F.when(counts, F.col("delivery_cost"))), F.lit(0)).cast(MINOR).alias("shipped_value"),
        F.max("document_date").alias("last_document_date"), F.coalesce(F.min("deal_kg") < F.max("deal_kg"), F.lit(False)).alias("deal_kg_differs"),
    ).select("deal", "f.*", "clearing_contracts", "statuses", "documents", "shipped_kg", "shipped_value", "last_document_date", "deal_kg_differs")
    known = _totals(harvest).where("part = 'contract'").select(
        F.col("contract_number").alias("deal"), (F.col("lead.contract_qty_t") * 1000).cast(KG).alias("contract_kg"), (F.col("hand_kg") + F.col("machine_kg")).cast(KG).alias("accepted_kg")
    )
    paid = matched.where("deal_number is not null").groupBy(F.col("deal_number").alias("deal")).agg(F.sum("net").cast(MINOR).alias("paid_net"))
    out = out.join(known, "deal", "left").join(paid, "deal", "left")
    return out.withColumns({"accepted_kg": F.coalesce("accepted_kg", F.lit(0)).cast(KG), "paid_net": F.coalesce("paid_net", F.lit(0)).cast(MINOR)})


def deal_rules() -> list[Rule]:
    known, by_name = F.col("match_inn").isNotNull(), ~F.col("match_method").isin("CONTRACT", "INN")
    return [
        Rule("WARNING", "SHIPMENT_NOT_MATCHED", ~known),
        Rule("WARNING", "CONTRACT_NOT_FOUND", known & by_name),
        Rule("WARNING", "CONTRACT_QTY_MISMATCH", F.abs(F.col("contract_kg") - F.col("deal_kg")) > 1),
        Rule("WARNING", "DEAL_QTY_INCONSISTENT", F.col("deal_kg_differs")),
    ]


def shipment_farmers(deal_rows: DataFrame) -> DataFrame:
    """Deals added up by farmer, or by the seller's name where no farmer matches."""
    key = F.coalesce("match_inn", F.concat(F.lit("name:"), F.coalesce("seller_name", "deal")))
    add = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return deal_rows.groupBy(key.alias("farmer_key")).agg(
        F.count("*").alias("deals"), *[add(c, KG) for c in ("contract_kg", "deal_kg", "shipped_kg", "accepted_kg")], *[add(c, MINOR) for c in ("shipped_value", "paid_net")]
    )


def account_owners(accounts: DataFrame, payments: DataFrame, index: Index) -> DataFrame:
    """accounts with owner_inn and owner_kind: a holder that is a farmer, else the owner by id or code, else a farmer by code or name."""
    codes = M.owner_bridge(payments, F.col("source_row"))
    keys = index.keys.unionByName(codes.select(F.lit("OWNER_CODE").alias("way"), F.col("code").alias("key"), F.col("owner").alias("found")))
    keys = keys.unionByName(codes.select(F.lit("OWNER").alias("way"), F.col("owner").alias("key"), F.col("owner").alias("found")).distinct())
    ways = [
        ("INN", "holder_inn", None), ("OWNER", "holder_inn", None), ("OWNER_CODE", "account", M.client_code),
        ("ACCOUNT", "account", M.client_code), ("NAME", "holder_name", M.name_key), ("WORDS", "holder_name", M.words_key),
    ]
    rows = M.first_hits(accounts, keys, ways)
    kind = F.when(F.col("way").isin("OWNER", "OWNER_CODE"), "OWNER").when(F.col("way").isNotNull(), "FARMER").otherwise("UNKNOWN")
    return rows.withColumn("owner_kind", kind).withColumnRenamed("found", "owner_inn").drop("way")


def account_totals(owned: DataFrame) -> DataFrame:
    return owned.where("owner_kind = 'OWNER'").groupBy("category").agg(F.sum("balance").cast(MINOR).alias("balance"))


def farmer_links(harvest: DataFrame, directory: DataFrame) -> DataFrame:
    """Farmers and directory entries linked; harvest: as such, or its harvest_totals()."""
    known = farmer_names(_totals(harvest)).groupBy("inn").agg(F.min_by("farmer_name", "source_row").alias("name"), F.min("source_row").alias("ord"))
    return M.link_directory(known, directory)


def farmer_figures(totals: DataFrame, matched: DataFrame, deal_rows: DataFrame, report_date: datetime.date, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """What harvest, contracts, payments and deals add up to for each tax id: four sources, one grouping."""
    today = F.col("op_date") == F.lit(report_date)
    planned = plan_type(F.col("lead.contract_type"), cfg)
    parts = [
        totals.where("part = 'farmer'").select("inn", "hand_kg", "machine_kg", "sum_100", "today_hand_kg", "today_machine_kg"),
        totals.where("part = 'pair'").select("inn", F.when(planned, F.col("lead.contract_qty_t")).cast(KG).alias("contract_plan_t"), F.lit(1).alias("contracts")),
        matched.where("match_inn is not null").select(F.col("match_inn").alias("inn"), F.col("net").alias("paid_total"), F.when(today, F.col("net")).alias("paid_today")),
        deal_rows.where("match_inn is not null").select(F.col("match_inn").alias("inn"), "shipped_kg", "shipped_value", F.lit(1).alias("deals")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    money = ("sum_100", "paid_total", "paid_today", "shipped_value")
    kind = lambda c: "long" if c in ("contracts", "deals") else MINOR if c in money else KG
    return rows.groupBy("inn").agg(*[F.sum(c).cast(kind(c)).alias(c) for c in rows.columns if c != "inn"])


def farmer_lines(
    harvest: DataFrame, counted: DataFrame | None, directory: DataFrame, matched: DataFrame, deal_rows: DataFrame, report_date: datetime.date, cfg: EngineConfig = DEFAULT,
    links: DataFrame | None = None,
) -> DataFrame:
    """A line for every farmer and every directory entry without one: plan, weights, money, payments, shipments.

    harvest: as such, or its harvest_totals() for the report's day; links: farmer_links(), where they are there. The picking share is rounded
    for each farmer, and subtotals add the rounded values.
    """
    totals = _totals(harvest, report_date)
    links = farmer_links(totals, directory) if links is None else links
    entries = directory.select(F.col("ord").alias("entry_ord"), "section", "block", "display_name", F.col("tax_id").alias("entry_inn"), F.col("plan_t").alias("entry_plan_t"))
    rows = links.join(entries, "entry_ord", "left").withColumn("inn", F.coalesce("inn", "entry_inn"))
    rows = rows.join(farmer_figures(totals, matched, deal_rows, report_date, cfg), "inn", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    in_basket = F.col("name").isNotNull()
    plan_t = F.when(in_basket, F.coalesce("contract_plan_t", F.lit(0))).otherwise(F.coalesce("entry_plan_t", F.lit(0))).cast(KG)
    rows = rows.select(
        "inn", "entry_ord", "link", F.coalesce("section", F.lit(UNASSIGNED)).alias("section"), F.coalesce("block", F.lit(UNASSIGNED)).alias("block"),
        F.coalesce("display_name", "name", F.lit("—")).alias("display_name"), plan_t.alias("plan_t"), zero("contracts", "long"),
        *[zero(c, KG) for c in ("hand_kg", "machine_kg", "today_hand_kg", "today_machine_kg", "shipped_kg")],
        *[zero(c, MINOR) for c in ("sum_100", "paid_total", "paid_today", "shipped_value")], zero("deals", "long"),
    )
    rows = rows.withColumn("sum_20", percent_of(F.col("sum_100"), cfg.picking_share_pct))
    kg = F.col("hand_kg") + F.col("machine_kg")
    share = F.round((kg.cast("double") / 10) / F.when(F.col("plan_t") > 0, F.col("plan_t").cast("double")), 4)
    return rows.withColumns({"picking_balance": (F.col("sum_20") - F.col("paid_total")).cast(MINOR), "total_kg": kg.cast(KG), "achieved_pct": share})


SUMS = ("plan_t", "hand_kg", "machine_kg", "today_hand_kg", "today_machine_kg", "sum_100", "sum_20", "paid_total", "paid_today", "picking_balance", "shipped_kg", "shipped_value")


def levels(lines: DataFrame) -> DataFrame:
    """Blocks within sections, sections, blocks, all: one grouping of the lines that subtotals, regions and figures are read from.

    level: 0 a section's block, 1 a section, 2 a block, 3 all.
    """
    today = F.col("today_hand_kg") + F.col("today_machine_kg")
    sets = [[F.col("section"), F.col("block")], [F.col("section")], [F.col("block")], []]
    return lines.groupingSets(sets, F.col("section"), F.col("block")).agg(
        F.grouping_id().alias("level"), F.count("*").alias("farmers"), F.min("block").alias("least"), F.max("block").alias("most"), F.min("section").alias("first_section"),
        *[F.sum(c).alias(c) for c in SUMS], F.sum("total_kg").alias("total_kg"), F.sum(today).alias("today_kg"),
        F.count(F.when(F.col("total_kg") > 0, 1)).alias("with_harvest"), F.count(F.when(today > 0, 1)).alias("with_harvest_today"),
    )


def subtotals(lines: DataFrame) -> DataFrame:
    """(level, section, block, farmers, sums): blocks, sections, all. A section whose one block bears its name has no block line."""
    rows = levels(lines).where("level <> 2")
    level = F.when(F.col("level") == 0, "block").when(F.col("level") == 1, "section").otherwise("grand")
    own = (F.col("level") == 1) & (F.col("least") == F.col("section")) & (F.col("most") == F.col("section"))
    named = rows.withColumn("single", F.max(own).over(Window.partitionBy("section")))  # a row for each block of a section
    return named.where(~((F.col("level") == 0) & F.col("single"))).select(level.alias("level"), "section", "block", "farmers", *SUMS)


def layout(lines: DataFrame) -> DataFrame:
    """lines with their place in the report: by directory order, then those without an entry by name, numbered in their block."""
    late = F.col("entry_ord").isNull()
    order = [late, F.col("entry_ord"), F.col("display_name"), F.col("inn")]
    return lines.withColumn("number_in_block", F.row_number().over(Window.partitionBy("section", "block").orderBy(*order)))


def region_totals(lines: DataFrame) -> DataFrame:
    return levels(lines).where("level = 2").select("block", F.col("first_section").alias("section"), "total_kg", "today_kg", F.col("with_harvest").alias("farmers"))


def kpis(lines: DataFrame, counted: DataFrame, deal_rows: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of sixteen figures. counted: rows with contract_number, as many for a contract as there are."""
    whole = lambda c, name, kind=KG: F.coalesce(c, F.lit(0)).cast(kind).alias(name)
    own = levels(lines).where("level = 3").select(
        whole("today_hand_kg", "today_hand_kg"), whole("today_machine_kg", "today_machine_kg"), whole("today_kg", "today_total_kg"),
        whole("hand_kg", "season_hand_kg"), whole("machine_kg", "season_machine_kg"), whole("total_kg", "season_total_kg"),
        F.col("with_harvest").alias("farmers_with_harvest"), F.col("with_harvest_today").alias("farmers_today"),
        whole("paid_today", "paid_today", MINOR), whole("paid_total", "paid_total", MINOR), whole("picking_balance", "picking_balance", MINOR),
    )
    s = lambda c, kind=KG: F.coalesce(F.sum(c), F.lit(0)).cast(kind)
    contracts = counted.agg(F.count_distinct("contract_number").alias("contracts"))
    shipped = deal_rows.agg(s("shipped_kg").alias("shipped_kg"), s("shipped_value", MINOR).alias("shipped_value"), F.count("*").alias("shipment_deals"))
    free = totals.agg(F.coalesce(F.sum(F.when(F.col("category") == "FREE", F.col("balance"))), F.lit(0)).cast(MINOR).alias("rkp_free_balance"))
    return own.crossJoin(contracts).crossJoin(shipped).crossJoin(free)  # one row each


def daily_series(cells: DataFrame, report_date: datetime.date) -> DataFrame:
    """Every day from the first counted one to the later of the last and the report date, with running weight."""
    days = cells.groupBy("acceptance_date").agg(F.sum("hand_kg").alias("hand_kg"), F.sum("machine_kg").alias("machine_kg"))
    ends = days.agg(F.coalesce(F.min("acceptance_date"), F.lit(report_date)).alias("a"), F.greatest(F.max("acceptance_date"), F.lit(report_date)).alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias("acceptance_date"))
    rows = calendar.join(days, "acceptance_date", "left").select("acceptance_date", *[F.coalesce(c, F.lit(0)).cast(KG).alias(c) for c in ("hand_kg", "machine_kg")])
    total = (F.col("hand_kg") + F.col("machine_kg")).cast(KG)
    running = Window.orderBy("acceptance_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return rows.withColumn("total_kg", total).withColumn("cumulative_kg", F.sum("total_kg").over(running))


def wide_days(cells: DataFrame, days: list[datetime.date]) -> DataFrame:
    """A row for each farmer, with columns for every day given."""
    return cells.groupBy("inn").pivot("acceptance_date", days).agg(F.sum("hand_kg").alias("hand_kg"), F.sum("machine_kg").alias("machine_kg"))


def plan_differences(lines: DataFrame, directory: DataFrame) -> DataFrame:
    """Lines of farmers whose contracts and directory entry plan another quantity."""
    theirs = directory.select(F.col("display_name").alias("_d"), F.col("block").alias("_b"), F.col("plan_t").alias("directory_plan_t"))
    same = lines.join(theirs, (F.col("display_name") == F.col("_d")) & (F.col("block") == F.col("_b")))
    return same.where((F.col("link") != "NOT_IN_BASKET") & (F.abs(F.col("directory_plan_t") - F.col("plan_t")) > 0.001)).select("inn", "display_name", "plan_t", "directory_plan_t")


def plan_issues(differences: DataFrame) -> DataFrame:
    """plan_differences() as issues."""
    return issues(differences, [Rule("WARNING", "PLAN_DIFFERS_FROM_DIRECTORY", F.lit(True))], "MATCHING", F.lit(None).cast("long"), F.col("inn"))


def harvest_repeats(harvest: DataFrame) -> DataFrame:
    """Issues over several rows of a harvest: tax ids with names that differ as names go, and rows that repeat a natural key."""
    written = harvest.where("inn is not null").select("inn", "farmer_name").distinct()
    named = written.select("inn", party_key(F.col("farmer_name")).alias("key")).where("key <> ''").distinct()
    several = named.groupBy("inn").agg(F.count("*").alias("n")).where("n > 1")
    names = issues(several, [Rule("WARNING", "NAME_MISMATCH", F.lit(True))], "BASKET", F.lit(None).cast("long"), F.col("inn"))
    first = harvest.groupBy("natural_key").agg(F.min("source_row").alias("first"))
    again = harvest.select("natural_key", "source_row").join(first, "natural_key").where("source_row <> first")
    return names.unionByName(issues(again, [Rule("WARNING", "DUPLICATE", F.lit(True))], "BASKET", F.col("source_row").cast("long"), F.col("natural_key")))


def report_issues(directory: DataFrame, actions: DataFrame) -> DataFrame:
    """Issues of a report as a whole: no directory, and stored rows that the last source lacks. actions: store.compare()."""
    none, at = F.lit(None).cast("string"), F.lit(None).cast("long")
    empty = directory.agg(F.count("*").alias("n"))
    removed = actions.agg(F.count(F.when(F.col("action") == "ABSENT", 1)).alias("n"))
    parts = [(empty, Rule("WARNING", "DIRECTORY_MISSING", F.col("n") == 0), "REPORT"), (removed, Rule("INFO", "REMOVED_FROM_SOURCE", F.col("n") > 0, F.col("n").cast("string")), "BASKET")]
    first, second = (issues(frame, [rule], source, at, none) for frame, rule, source in parts)
    return first.unionByName(second)


def unknown_method(harvest: DataFrame) -> DataFrame:
    """(inn, unknown_kg): weight whose picking method can't be told."""
    rows = harvest.where((F.col("method") == "UNKNOWN") & (F.col("conditioned_kg") > 0) & F.col("inn").isNotNull())
    return rows.groupBy("inn").agg(F.sum("conditioned_kg").cast(KG).alias("unknown_kg"))


def payment_issues(matched: DataFrame, index: Index) -> DataFrame:
    names = index.farmers.select(F.col("inn").alias("match_inn"), F.col("name").alias("_name"))
    rows = matched.join(names, "match_inn", "left")
    other = (F.col("match_method") == "INN") & F.col("counterparty_name").isNotNull() & (party_key(F.col("_name")) != party_key(F.col("counterparty_name")))
    rules = [Rule("WARNING", "PAYMENT_NOT_MATCHED", F.col("match_inn").isNull()), Rule("WARNING", "NAME_MISMATCH", other)]
    return issues(rows, rules, "MATCHING", F.col("source_row"), F.col("tx_id"))


def directory_issues(links: DataFrame) -> DataFrame:
    rules = [Rule("INFO", "DIRECTORY_LINKED_BY_NAME", F.col("link") == "NAME"), Rule("WARNING", "FARMER_NOT_MATCHED", F.col("link") == "NONE")]
    return issues(links, rules, "MATCHING", F.lit(None).cast("long"), F.col("inn"))


def account_issues(owned: DataFrame) -> DataFrame:
    return issues(owned, [Rule("WARNING", "ACCOUNT_NOT_MATCHED", F.col("owner_kind") == "UNKNOWN")], "MATCHING", F.col("source_row"), F.col("account"))


def all_issues(
    state: DataFrame, payments: DataFrame, index: Index, matched: DataFrame, deal_rows: DataFrame, links: DataFrame, lines: DataFrame, directory: DataFrame, owned: DataFrame,
) -> DataFrame:
    """Every issue of one report in one frame: (severity, code, source, row, ref, message)."""
    none = F.lit(None).cast("long")
    return united(
        issues(state, harvest_rules(), "BASKET", F.col("source_row").cast("long"), F.col("contract_number")), issues(deal_rows, deal_rules(), "MATCHING", none, F.col("deal")),
        payment_issues(matched, index), directory_issues(links), plan_issues(plan_differences(lines, directory)), account_issues(owned),
    )


def statement_check(payments: DataFrame, footer_debit: Column) -> DataFrame:
    """One row: the sum of debits against the statement's footer; credits are not held against it."""
    return payments.agg(F.coalesce(F.sum("debit"), F.lit(0)).cast(MINOR).alias("debit")).select("debit", (F.col("debit") != footer_debit).alias("mismatch"))


def web_view(lines: DataFrame) -> DataFrame:
    """Lines as JSON, in units and tons."""
    units, tons = lambda c: (F.col(c) / 100).cast("double").alias(c), lambda c: (F.col(c) / 1000).cast("double").alias(c.replace("_kg", "_t"))
    return lines.select(F.to_json(F.struct("inn", "section", "block", "display_name", units("sum_100"), units("paid_total"), tons("total_kg"), "achieved_pct")).alias("json"))


def search(lines: DataFrame, text: str = "", block: str | None = None, today_only: bool = False, contracts: DataFrame | None = None) -> DataFrame:
    """Lines of one block or all, of those who delivered today or all, whose names, id or one of whose contracts has a text in it.

    contracts: (inn, contract_number), as many rows as there are.
    """
    rows = lines if block is None else lines.where(F.col("block") == block)
    rows = rows.where(F.col("today_hand_kg") + F.col("today_machine_kg") > 0) if today_only else rows
    if not text:
        return rows
    hit = F.lower(F.concat_ws(" ", *[c for c in ("display_name", "basket_name", "inn") if c in lines.columns])).contains(text.lower())
    if contracts is None:
        return rows.where(hit)
    theirs = contracts.where(F.lower("contract_number").contains(text.lower())).select(F.col("inn").alias("_inn")).distinct()
    return rows.join(theirs, F.col("inn") == F.col("_inn"), "left").where(hit | F.col("_inn").isNotNull()).drop("_inn")


def search_payments(matched: DataFrame, farmers: DataFrame, text: str) -> DataFrame:
    """Legs in whose counterparty, ids, deal or farmer's name a text stands. farmers: (inn, name)."""
    named = matched.join(farmers.select(F.col("inn").alias("match_inn"), F.col("name").alias("farmer")), "match_inn", "left")
    return named.where(F.lower(F.concat_ws(" ", "counterparty_name", "counterparty_inn", "deal_number", "farmer")).contains(text.lower()))


def filtered_totals(lines: DataFrame) -> DataFrame:
    """One row: the sums over the lines that a filter left."""
    return lines.agg(F.count("*").alias("farmers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


#: Fixed value: sections that stand for clusters.
CLUSTER_SECTION = "(?i)кластер|cluster"


def top_lines(lines: DataFrame, k: int = 12) -> DataFrame:
    """The k lines with most weight that are no cluster's."""
    rows = lines.where((F.col("total_kg") > 0) & ~F.coalesce(F.col("section").rlike(CLUSTER_SECTION), F.lit(False)))
    return rows.orderBy(F.desc("total_kg"), "display_name", "inn").limit(k)


def report_name(day: datetime.date, at: datetime.time, same_day: int) -> str:
    """A report's name: its day, and the time where the day has a report already."""
    return f"Кунлик_терим_{day.isoformat()}" + (f"_{at:%H-%M}" if same_day else "")


def sheets(lines: DataFrame, cells: DataFrame, days: list[datetime.date], report_date: datetime.date, matched: DataFrame, shipments: DataFrame, deal_rows: DataFrame, found: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The nine sheets of the daily workbook: name -> frame."""
    return {
        "daily": layout(lines).join(wide_days(cells, days), "inn", "left"), "farmers": lines, "dynamics": daily_series(cells, report_date), "payments": matched,
        "shipments": shipments, "deals": deal_rows, "shipment_farmers": shipment_farmers(deal_rows), "data_quality": found, "import_info": files,
    }
