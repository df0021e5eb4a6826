"""The star-schema tables in the shape of the daily report's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import client_code
from ..operators.relational import first_of_each
from .tables import table

MINOR = "decimal(20,0)"


def _minor(column: str) -> Column:
    return (F.col(column).cast("decimal(18,2)") * 100).cast(MINOR)


def _inn(number: Column) -> Column:
    return F.concat(F.lit("S"), number.cast("string"))


def harvest(spark: SparkSession, folder: str) -> DataFrame:
    """First line items of each (order, number), with their supplier and order."""
    line = table(spark, folder, "lineitem").withColumn("source_row", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    once = first_of_each(line, ["l_orderkey", "l_linenumber"], ["source_row"])
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    rows = once.join(orders, once.l_orderkey == orders.o_orderkey).join(supplier, once.l_suppkey == supplier.s_suppkey)
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    signed = F.col("l_tax") > 0
    return rows.select(
        number.alias("source_row"), F.when(F.col("l_suppkey") % 50 != 49, _inn(F.col("l_suppkey"))).alias("inn"), F.col("s_name").alias("farmer_name"),
        F.col("l_orderkey").cast("string").alias("contract_number"), (F.col("o_totalprice").cast("decimal(14,2)") * F.lit("0.0004").cast("decimal(5,4)")).cast("decimal(18,3)").alias("contract_qty_t"),
        F.col("o_orderpriority").alias("contract_type"), F.col("l_shipdate").cast("date").alias("acceptance_date"), F.lit(False).alias("date_invalid"),
        F.col("l_linestatus").alias("method_raw"), F.when(F.col("l_linestatus") == "O", "HAND").when(F.col("l_returnflag") == "R", "UNKNOWN").otherwise("MACHINE").alias("method"),
        F.when(signed, F.col("l_linenumber").cast("string")).alias("pk17"), F.col("l_quantity").cast("decimal(18,3)").alias("physical_kg"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("decimal(18,3)")).otherwise(F.lit(0).cast("decimal(18,3)")).alias("conditioned_kg"),
        F.when(F.col("l_quantity") != 13, _minor("l_extendedprice")).alias("amount"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and errors as legs with different things known of the payer; sign-ups as the owner's own legs."""
    user, kind = F.col("user_id"), F.col("event_type")
    way = user % 4
    code = F.lpad((user % 90).cast("string"), 9, "0")
    legs = table(spark, folder, "events").where(kind.isin("purchase", "error", "signup"))
    return legs.select(
        F.col("event_id").alias("source_row"), F.col("event_id").cast("string").alias("tx_id"), F.col("ts").cast("date").alias("op_date"),
        F.when(way == 0, _inn(user % 90)).alias("counterparty_inn"),
        F.when(way == 3, F.concat(F.lit("\"SUPPLIER#"), F.lpad((user % 90).cast("string"), 9, "0"), F.lit("\" MCHJ"))).alias("counterparty_name"),
        F.when(way.isin(0, 2), F.concat(F.lit("2020 8000 "), code)).alias("counterparty_account"),
        F.when(way == 1, (F.col("event_id") % 20000).cast("string")).alias("deal_number"),
        F.when(kind == "purchase", _minor("value")).otherwise(0).cast(MINOR).alias("debit"), F.when(kind == "error", _minor("value")).otherwise(0).cast(MINOR).alias("credit"),
        (kind == "signup").alias("is_company_side"), F.lit("2020 8000 999999999").alias("statement_account"), F.lit("OWNER").alias("client_inn"),
    ).withColumn("counterparty_account", F.when(F.col("is_company_side"), F.concat(F.lit("2020 8000 "), F.lpad((F.col("source_row") % 5 + 900000000).cast("string"), 9, "0"))).otherwise(F.col("counterparty_account")))


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as shipment documents, two to a deal."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("source_row"), (key - key % 2).cast("string").alias("deal_number"), (key % 1000).cast("string").alias("contract_number"),
        F.concat(F.lit("seller "), (key % 97).cast("string")).alias("seller_name"), F.lit(None).cast("string").alias("seller_inn"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CANCELLED").alias("status"),
        (F.col("o_totalprice").cast("decimal(14,2)") * F.lit("0.0002").cast("decimal(5,4)")).cast("decimal(18,3)").alias("shipment_kg"), _minor("o_totalprice").alias("delivery_cost"),
        (F.col("o_totalprice").cast("decimal(14,2)") * F.lit("0.0004").cast("decimal(5,4)")).cast("decimal(18,3)").alias("deal_kg"), _minor("o_totalprice").alias("deal_amount"),
        F.col("o_orderdate").cast("date").alias("document_date"),
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts of suppliers, some of which belong to the owner by their code."""
    key = F.col("s_suppkey")
    code = F.when(key % 10 == 0, F.lpad((key % 5 + 900000000).cast("string"), 9, "0")).otherwise(F.lpad(key.cast("string"), 9, "0"))
    return table(spark, folder, "supplier").select(
        key.alias("source_row"), F.concat(F.lit("2020 8000 "), code).alias("account"), F.when(key % 3 == 0, "FREE").when(key % 3 == 1, "BLOCKED").otherwise("IN_TRANSIT").alias("category"),
        _minor("s_acctbal").alias("balance"), F.when(key % 4 == 1, _inn(key)).alias("holder_inn"), F.when(key % 4 == 2, F.col("s_name")).alias("holder_name"),
    )


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as directory entries: every seventh stands under an old name alone, every fifth has no tax id; customers have no harvest."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))  # a fixed list of countries
    key = F.col("s_suppkey")
    renamed = key % 7 == 6
    ours = table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("ord"), F.col("r_name").alias("section"), F.col("n_name").alias("block"), F.when(renamed, F.concat(F.lit("Old "), "s_name")).otherwise(F.col("s_name")).alias("display_name"),
        F.lit(None).cast("string").alias("basket_name"), F.when((key % 5 != 4) & ~renamed, _inn(key)).alias("tax_id"), F.abs(F.col("s_acctbal").cast("decimal(18,3)")).alias("plan_t"),
    )
    who = F.col("c_custkey")
    others = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (who + 10_000_000).alias("ord"), F.col("r_name").alias("section"), F.col("n_name").alias("block"), F.col("c_name").alias("display_name"),
        F.lit(None).cast("string").alias("basket_name"), F.concat(F.lit("C"), who.cast("string")).alias("tax_id"), F.abs(F.col("c_acctbal").cast("decimal(18,3)")).alias("plan_t"),
    )
    return ours.unionByName(others)


def codes(rows: DataFrame, account: str) -> DataFrame:
    return rows.withColumn("code", client_code(F.col(account)))
