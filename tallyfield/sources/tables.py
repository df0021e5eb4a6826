"""Star-schema tables as the domain sees them: operations, payments, shipments, a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order over the rows of one (contract, record): which of them counts as first.
OPERATION_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _decimal(column: str, kind: str) -> Column:
    return F.col(column).cast(kind)


def contract_qty() -> Column:
    """The quantity of an order as a contract: 1/2500 of its price, exact."""
    return (_decimal("o_totalprice", "decimal(14,2)") * F.lit("0.0004").cast("decimal(5,4)")).cast("decimal(18,6)")


def raw_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as acceptance operations, with a mark on repeats of a (contract, record). No dimension yet."""
    line = table(spark, folder, "lineitem")
    one, share = F.lit(1).cast("decimal(3,2)"), lambda c: _decimal(c, "decimal(4,2)")
    physical = _decimal("l_quantity", "decimal(9,3)")
    calculated = (physical * (one - share("l_discount"))).cast("decimal(18,5)")
    return line.select(
        F.col("l_orderkey").alias("contract_number"),
        F.col("l_linenumber").alias("record_no"),
        F.struct(*OPERATION_ORDER).alias("source_row"),
        F.col("l_suppkey").alias("farmer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("acceptance_date"),
        (physical * F.lit("1.25").cast("decimal(3,2)")).cast("decimal(18,5)").alias("gross_kg"),
        physical.cast("decimal(18,3)").alias("physical_kg"),
        (physical * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,5)").alias("tare_kg"),
        calculated.alias("calculated_kg"),
        (calculated * (one - share("l_tax"))).cast("decimal(18,7)").alias("conditioned_kg"),
        (share("l_discount") * 100).cast("decimal(9,2)").alias("impurity_pct"),
        (share("l_tax") * 100).cast("decimal(9,2)").alias("moisture_pct"),
        _decimal("l_extendedprice", "decimal(18,2)").alias("amount"),
        (_decimal("l_extendedprice", "decimal(18,2)") * share("l_tax")).cast("decimal(22,4)").alias("markup"),
        (_decimal("l_extendedprice", "decimal(18,2)") * share("l_discount")).cast("decimal(22,4)").alias("discount"),
        (physical * 2).cast("decimal(18,3)").alias("transport_fee"),
        F.when(F.col("l_returnflag") == "R", physical * 3).cast("decimal(18,3)").alias("seed_cotton_fee"),
        (physical * 5).cast("decimal(18,3)").alias("other_fee_total"),
        F.col("l_returnflag").alias("grade"),
        F.when(F.col("l_linestatus") == "O", "HAND").otherwise("MACHINE").alias("method"),
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("contract_number"), contract_qty().alias("contract_qty"), F.col("o_orderpriority").alias("contract_type"),
        F.col("o_custkey").alias("buyer_id"), F.col("o_orderstatus").alias("contract_state"), F.col("o_orderdate").cast("date").alias("contract_date"),
    )


def farmers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as farmers, with block and section."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    supplier = table(spark, folder, "supplier")
    # nations are a fixed list of countries
    return supplier.join(F.broadcast(places), supplier.s_nationkey == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("farmer_id"), F.col("s_name").alias("farmer_name"), F.col("n_name").alias("block"),
        F.col("r_name").alias("cluster"), F.col("s_acctbal").cast("decimal(18,2)").alias("balance"),
    )


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """The star: operations with farmer (inner), contract and buyer (left)."""
    buyers = table(spark, folder, "customer").select(F.col("c_custkey").alias("buyer_id"), F.col("c_mktsegment").alias("buyer"))
    star = raw_operations(spark, folder).join(farmers(spark, folder), "farmer_id")
    return star.join(contracts(spark, folder), "contract_number", "left").join(buyers, "buyer_id", "left")


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as debits and errors as credits of a payer; sign-ups are the owner's own legs."""
    kinds = F.col("event_type")
    money = (F.col("value").cast("decimal(18,2)") * 100).cast("decimal(20,0)")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("tx_id"), F.col("ts").alias("op_time"), F.col("ts").cast("date").alias("op_date"),
        F.col("user_id").alias("payer_id"), kinds.alias("kind"),
        F.when(kinds == "purchase", money).otherwise(0).cast("decimal(20,0)").alias("debit"),
        F.when(kinds == "error", money).otherwise(0).cast("decimal(20,0)").alias("credit"),
        (kinds == "signup").alias("is_company_side"), F.get_json_object("props", "$.k").cast("bigint").alias("deal_no"), "props",
    )
