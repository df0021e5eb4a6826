"""Reports over one ledger of acceptance operations.

The operations frame has, beside the columns of sources.tables.operations: is_duplicate and is_valid.
Weights and money are decimals, so sums do not depend on the order of rows; shares become doubles at the end.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.numbers import ratio
from ..operators import relational as R
from ..operators.quality import Rule, issues

NO_CLUSTER, UNKNOWN = "Кластерсиз", "Номаълум"
KEY = ("contract_number", "record_no")


def marked(operations: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """operations with is_duplicate (a later row of its identity) and is_valid (a weight above 0)."""
    rows = R.mark_repeats(operations, KEY, ["source_row"])
    return rows.withColumn("is_valid", F.coalesce(F.col(cfg.weight_column) > 0, F.lit(False)))


def working_set(operations: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """First rows that are valid, of the buyer that the settings name; a row without a buyer is out then."""
    rows = operations.where("not is_duplicate and is_valid")
    rows = rows if cfg.buyer is None else rows.where(F.col("buyer") == cfg.buyer)
    return rows.withColumn("kg", F.coalesce(F.col(cfg.weight_column), F.lit(0)))


def pct(part: Column, whole: Column) -> Column:
    return F.round(ratio(part.cast("double") * 100, whole.cast("double")), 4)


def contract_status(share: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return (
        F.when(share == 0, "NOT_STARTED").when(share > 100, "OVER").when(share == 100, "COMPLETED")
        .when(share >= cfg.near_completion_pct, "NEAR_COMPLETION").otherwise("IN_PROGRESS")
    )


def achievement_light(share: Column) -> Column:
    return F.when(share >= 100, "green").when(share >= 90, "yellow").when(F.coalesce(share, F.lit(0.0)) == 0, "red").otherwise("none")


def contract_performance(work: DataFrame, contracts: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A row for every contract, those without operations among them, so that NOT_STARTED is reachable."""
    done = work.groupBy("contract_number").agg(F.sum("kg").alias("accepted"), F.count("*").alias("operations"))
    rows = contracts.select("contract_number", "contract_qty").join(done, "contract_number", "left")
    rows = rows.withColumns({"accepted": F.coalesce("accepted", F.lit(0)), "operations": F.coalesce("operations", F.lit(0))})
    over = F.col("accepted") - F.col("contract_qty")
    rows = rows.withColumn("achieved_pct", pct(F.col("accepted"), F.col("contract_qty")))
    return rows.select(
        "contract_number", "contract_qty", "accepted", F.greatest(-over, F.lit(0)).alias("remaining"), F.greatest(over, F.lit(0)).alias("over"),
        "achieved_pct", contract_status(F.col("achieved_pct"), cfg).alias("status"), "operations",
    )


def _per_contract(work: DataFrame, *keys: str) -> DataFrame:
    """A row for each (keys, contract): the contract's quantity once, and sums over its operations."""
    m = lambda c: F.when(F.col(c).isNotNull(), F.col(c))
    return work.groupBy(*keys, "contract_number").agg(
        F.min_by("contract_qty", "source_row").alias("qty"), F.sum("kg").alias("kg"), F.count("*").alias("n"), F.sum("amount").alias("amount"),
        F.sum(F.when(F.col("amount").isNotNull(), F.col("kg"))).alias("priced_kg"),
        F.sum(m("moisture_pct")).alias("moisture"), F.count("moisture_pct").alias("n_moisture"),
        F.sum(m("impurity_pct")).alias("impurity"), F.count("impurity_pct").alias("n_impurity"),
    )


def _rolled(per: DataFrame, *keys: str) -> DataFrame:
    total = per.groupBy(*keys).agg(
        F.sum("qty").alias("contract_qty"), F.sum("kg").alias("accepted"), F.sum("n").alias("deliveries"), F.sum("amount").alias("amount"),
        F.count("contract_number").alias("contracts"), F.sum("priced_kg").alias("priced_kg"),
        *[F.round(F.sum(c).cast("double") / F.nullif(F.sum(f"n_{c}"), F.lit(0)).cast("double"), 4).alias(f"avg_{c}") for c in ("moisture", "impurity")],
    )
    price = F.round(ratio(F.col("amount").cast("double"), F.col("priced_kg").cast("double")), 4)
    return total.withColumns({"achieved_pct": pct(F.col("accepted"), F.col("contract_qty")), "avg_price": price}).drop("priced_kg")


def management_summary(work: DataFrame, as_of: datetime.date, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: quantities of distinct contracts against what was accepted, today's weight, money, counts."""
    total = _rolled(_per_contract(work).withColumn("all", F.lit(1)), "all").drop("all")
    day = work.agg(F.coalesce(F.sum(F.when(F.col("acceptance_date") == F.lit(as_of), F.col("kg"))), F.lit(0)).alias("today"), F.count_distinct("farmer_id").alias("farmers"))
    over = F.col("accepted") - F.col("contract_qty")
    rows = total.crossJoin(F.broadcast(day))  # two rows of totals
    return rows.select(
        "contract_qty", "accepted", F.greatest(-over, F.lit(0)).alias("remaining"), F.greatest(over, F.lit(0)).alias("over"), "achieved_pct",
        "today", "amount", "avg_price", "contracts", "farmers", "deliveries",
    )


def farmer_analytics(work: DataFrame) -> DataFrame:
    names = work.groupBy("farmer_id").agg(F.min_by("farmer_name", "source_row").alias("farmer_name"))
    return _rolled(_per_contract(work, "farmer_id"), "farmer_id").join(names, "farmer_id")


def cluster_analytics(work: DataFrame) -> DataFrame:
    keyed = work.withColumn("cluster", F.coalesce("cluster", F.lit(NO_CLUSTER)))
    farmers = keyed.select("cluster", "farmer_id").distinct().groupBy("cluster").agg(F.count("*").alias("farmers"))
    return _rolled(_per_contract(keyed, "cluster"), "cluster").join(farmers, "cluster")


def top_farmers(farmers: DataFrame, k: int = 10) -> DataFrame:
    return R.top_k(farmers, k, F.coalesce("achieved_pct", F.lit(0.0)).desc(), F.col("farmer_id"))


def bottom_farmers(farmers: DataFrame, k: int = 10) -> DataFrame:
    return R.top_k(farmers.where("contract_qty > 0"), k, F.coalesce("achieved_pct", F.lit(0.0)).asc(), F.col("farmer_id"))


def quality_bands(work: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(measure, band, n): moisture and impurity in bands."""
    marks = F.array(
        F.struct(F.lit("impurity").alias("measure"), R.bands(F.col("impurity_pct"), cfg.impurity_warn, cfg.impurity_critical).alias("band")),
        F.struct(F.lit("moisture").alias("measure"), R.bands(F.col("moisture_pct"), cfg.moisture_warn, cfg.moisture_critical).alias("band")),
    )
    return work.select(F.inline(marks)).where("band is not null").groupBy("measure", "band").agg(F.count("*").alias("n"))


def quality_summary(work: DataFrame) -> DataFrame:
    out = []
    for c in ("moisture", "impurity"):
        v = F.col(f"{c}_pct")
        out += [F.round(F.sum(v).cast("double") / F.count(v).cast("double"), 4).alias(f"avg_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    return work.agg(*out)


def finance(work: DataFrame, as_of: datetime.date) -> DataFrame:
    price = F.round(F.col("amount") / F.when(F.col("kg") > 0, F.col("kg")), 4)
    rows = work.withColumn("price", price.cast("decimal(18,4)"))
    return rows.agg(
        F.sum("amount").alias("amount"), F.coalesce(F.sum(F.when(F.col("acceptance_date") == F.lit(as_of), F.col("amount"))), F.lit(0)).alias("amount_today"),
        F.round(F.sum("price").cast("double") / F.count("price").cast("double"), 4).alias("avg_price"),
        F.round(R.weighted_mean(F.col("amount"), F.col("kg")).cast("double"), 4).alias("weighted_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FEES if c in work.columns],
    )


#: The sums of money beside the price, and the weights from the full vehicle to the reported one.
FEES = ("markup", "discount", "transport_fee", "seed_cotton_fee", "other_fee_total")
STAGES = ("gross_kg", "tare_kg", "physical_kg", "calculated_kg", "conditioned_kg")


def weight_bridge(work: DataFrame) -> DataFrame:
    """(stage_no, stage, kg, change, change_pct): the weight at each stage, and against the stage before."""
    sums = work.agg(*[F.sum(s).cast("decimal(28,7)").alias(s) for s in STAGES])
    rows = sums.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("kg")) for s in STAGES])).alias("stage_no", "x"))
    rows = rows.select("stage_no", "x.*")
    before = F.lag("kg").over(R.Window.orderBy("stage_no"))  # one row for each stage
    return rows.select("stage_no", "stage", "kg", (F.col("kg") - before).alias("change"), pct(F.col("kg") - before, before).alias("change_pct"))


def daily_trend(work: DataFrame) -> DataFrame:
    days = work.where("acceptance_date is not null").groupBy("acceptance_date").agg(F.sum("kg").alias("kg"), F.count("*").alias("operations"))
    return R.running_by_day(days, "acceptance_date", "kg", "cumulative_kg")


def dense_daily(work: DataFrame) -> DataFrame:
    """Every calendar day with hand, machine and running weights."""
    kg = lambda m: F.sum(F.when(F.col("method") == m, F.col("kg")).otherwise(0)).alias(f"{m.lower()}_kg")
    days = work.groupBy("acceptance_date").agg(kg("HAND"), kg("MACHINE"))
    full = R.dense_days(days, "acceptance_date", {})
    full = full.select("acceptance_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hand_kg", "machine_kg")])
    return R.running_by_day(full.withColumn("kg", F.col("hand_kg") + F.col("machine_kg")), "acceptance_date", "kg", "cumulative_kg")


def contract_alerts(performance: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    share = F.col("achieved_pct")
    rules = [
        Rule("RED", "CONTRACT_OVER", F.col("status") == "OVER"),
        Rule("YELLOW", "NEAR_COMPLETION", F.col("status") == "NEAR_COMPLETION"),
        Rule("RED", "NO_ACCEPTANCE", F.col("status") == "NOT_STARTED"),
        Rule("YELLOW", "LOW_ACHIEVEMENT", (share > 0) & (share < cfg.low_achievement_pct)),
    ]
    return issues(performance, rules, "CONTRACT", F.col("contract_number"), F.col("contract_number"))


def data_rules(cfg: EngineConfig = DEFAULT) -> list[Rule]:
    """Rules over single operations, repeats among them; columns that a source lacks are given as null by the caller."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    conversion = F.col("conditioned_kg") / F.when(F.col("physical_kg") > 0, F.col("physical_kg"))
    first = ~F.col("is_duplicate")
    return [
        Rule("RED", "MISSING_CONTRACT_NUMBER", first & blank("contract_number")),
        Rule("YELLOW", "MISSING_CONTRACT_QTY", first & F.col("contract_qty").isNull()),
        Rule("YELLOW", "MISSING_LAB_RESULT", first & (F.col("moisture_pct").isNull() | F.col("impurity_pct").isNull())),
        Rule("RED", "ZERO_WEIGHT", first & (F.coalesce(F.col(cfg.weight_column), F.lit(0)) <= 0)),
        Rule("RED", "ZERO_OR_NEGATIVE_PRICE", first & (F.coalesce("amount", F.lit(0)) <= 0)),
        Rule("INFO", "DUPLICATE_OPERATION", F.col("is_duplicate")),
        Rule("YELLOW", "HIGH_MOISTURE", first & (F.col("moisture_pct") > cfg.moisture_critical)),
        Rule("YELLOW", "HIGH_IMPURITY", first & (F.col("impurity_pct") > cfg.impurity_critical)),
        Rule("YELLOW", "ABNORMAL_WEIGHT_CONVERSION", first & ((conversion < float(cfg.least_conversion)) | (conversion > float(cfg.most_conversion)))),
    ]


def document_rules() -> list[Rule]:
    """Rules over the papers of an operation: signed document, signature, vehicle."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return [
        Rule("YELLOW", "MISSING_PK17", empty("pk17_number")),
        Rule("YELLOW", "PK17_UNSIGNED", ~empty("pk17_number") & F.col("pk17_signed_at").isNull()),
        Rule("INFO", "MISSING_VEHICLE", empty("vehicle_plate")),
    ]


#: The measures of an operation that can't be below 0.
MEASURES = (
    "contract_qty", "gross_kg", "tare_kg", "physical_kg", "impurity_pct", "calculated_kg", "moisture_pct", "conditioned_kg", "unit_price", "amount",
)


def import_rules(columns: list[str], cfg: EngineConfig = DEFAULT) -> list[Rule]:
    """Rules that an import is held to before it is stored."""
    negative = [Rule("WARNING", "NEGATIVE_VALUE", F.col(c) < 0, F.lit(c)) for c in MEASURES if c in columns]
    weight = F.coalesce(F.col(cfg.weight_column) > 0, F.lit(False))
    return [
        *negative,
        Rule("WARNING", "MISSING_CONTRACT_NUMBER", F.col("contract_number").isNull()),
        Rule("WARNING", "MISSING_CONTRACT_QTY", F.col("contract_qty").isNull()),
        Rule("CRITICAL", "INVALID_OPERATION_ROW", ~weight),
    ]


def reconcile_total(operations: DataFrame, sheet_total: float, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: the sum of first rows, invalid ones among them, against a sheet's own total."""
    total = operations.where("not is_duplicate").agg(F.sum(cfg.weight_column).alias("computed"))
    sheet = F.lit(sheet_total).cast("decimal(28,3)")
    limit = F.greatest(F.lit(float(cfg.total_tolerance_kg)), F.lit(abs(sheet_total) * cfg.total_tolerance_pct / 100))
    gap = F.abs(F.col("computed") - sheet)
    return total.select("computed", sheet.alias("sheet"), gap.alias("difference"), (gap.cast("double") > limit).alias("mismatch"))


def total_issue(reconciled: DataFrame) -> DataFrame:
    """reconcile_total() as an issue, none where the totals agree."""
    message = F.concat_ws(" against ", F.col("sheet").cast("string"), F.col("computed").cast("string"))
    return issues(reconciled, [Rule("WARNING", "GRAND_TOTAL_MISMATCH", F.col("mismatch"), message)], "LEDGER", F.lit(None).cast("int"), F.lit(None))


def sheets(operations: DataFrame, contracts: DataFrame, as_of: datetime.date, cfg: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """The ten sheets of the ledger's workbook: name -> frame. operations: marked()."""
    work = working_set(operations, cfg)
    performance = contract_performance(work, contracts, cfg)
    data = issues(operations, data_rules(cfg), "LEDGER", F.col("record_no"), F.col("contract_number"))
    control = contract_alerts(performance, cfg).unionByName(data.withColumn("row", F.col("row").cast("long")))
    spark = operations.sparkSession
    return {
        "summary": management_summary(work, as_of, cfg), "contracts": performance, "farmers": farmer_analytics(work), "clusters": cluster_analytics(work),
        "acceptance": daily_trend(work), "quality": quality_bands(work, cfg), "finance": finance(work, as_of), "control": control,
        "raw_data": operations, "data_dictionary": spark.createDataFrame(dictionary(), "field string, meaning string"),
    }


def period(operations: DataFrame) -> DataFrame:
    return operations.agg(F.min("acceptance_date").alias("first_day"), F.max("acceptance_date").alias("last_day"))


def drill_down(operations: DataFrame, farmer: int | None = None, day: datetime.date | None = None, contract: int | None = None, most: int = 300) -> DataFrame:
    """The operations that a viewer picked; a filter that is not given holds for all."""
    rows = operations
    for column, value in (("farmer_id", farmer), ("acceptance_date", day), ("contract_number", contract)):
        rows = rows if value is None else rows.where(F.col(column) == F.lit(value))
    return rows.orderBy("acceptance_date", "contract_number", "record_no", "source_row").limit(most)


def dictionary() -> list[tuple[str, str]]:
    """What the columns of the reports mean."""
    return [
        ("contract_qty", "agreed quantity of the contract, counted once"), ("accepted", "reporting weight of first, valid operations"),
        ("remaining", "quantity not yet accepted, never below 0"), ("over", "quantity beyond the contract, never below 0"),
        ("achieved_pct", "accepted against agreed quantity"), ("avg_price", "money against weight, over rows that have both"),
    ]
