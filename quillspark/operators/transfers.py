"""Transfers between wallets: flattened legs and the graph of who sent to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = "struct<address:string,arkhamEntity:map<string,string>,arkhamLabel:map<string,string>>"
TRANSFER = f"struct<hash:string,transactionHash:string,token:struct<symbol:string,address:string>,value:double,amount:double,valueUsd:double,amountUsd:double,chain:string,timestamp:string,fromAddress:{ADDRESS},toAddress:{ADDRESS},fromAddresses:array<{ADDRESS}>,toAddresses:array<{ADDRESS}>>"


def flat_address(a: Column, prefix: str) -> list[Column]:
    part = lambda f, k: F.try_element_at(a[f], F.lit(k))
    return [a["address"].alias(f"{prefix}_address"), part("arkhamEntity", "name").alias(f"{prefix}_entity"), part("arkhamEntity", "type").alias(f"{prefix}_entity_type"), part("arkhamLabel", "name").alias(f"{prefix}_label")]


def _sides(many: str, one: str) -> Column:
    t = F.col("t")
    return F.when(F.size(t[many]) > 0, t[many]).when(t[one].isNotNull(), F.array(t[one])).otherwise(F.array(F.lit(None).cast(ADDRESS)))


def flatten_legs(pages: DataFrame, direction: str = "direction", wallet: str = "base_wallet", source_columns: tuple[str, ...] = ()) -> DataFrame:
    """A row for each leg. ``in``: every sender with the first receiver; ``out``: the first sender with every receiver; else all with all.

    ``pages`` has ``transfer`` (a TRANSFER struct). A source column that clashes becomes ``src_<name>``. A zero amount stays zero.
    """
    t = pages.withColumnRenamed("transfer", "t").withColumn("_from", _sides("fromAddresses", "fromAddress")).withColumn("_to", _sides("toAddresses", "toAddress"))
    d = F.col(direction)
    t = t.withColumn("_from", F.when(d == "out", F.slice("_from", 1, 1)).otherwise(F.col("_from"))).withColumn("_to", F.when(d == "in", F.slice("_to", 1, 1)).otherwise(F.col("_to")))
    legs = F.flatten(F.transform("_from", lambda f: F.transform("_to", lambda to: F.struct(f.alias("f"), to.alias("to")))))
    t = t.withColumn("leg", F.explode(legs)).withColumn("f", F.col("leg.f")).withColumn("to", F.col("leg.to"))
    core = [
        F.coalesce("t.hash", "t.transactionHash").alias("tx_hash"), F.col("t.token.symbol").alias("token_symbol"), F.col("t.token.address").alias("token_address"), F.coalesce("t.value", "t.amount").alias("amount"),
        F.coalesce("t.valueUsd", "t.amountUsd").alias("amount_usd"), F.col("t.chain").alias("chain"), F.col("t.timestamp").alias("timestamp"), d.alias("direction_reported"), F.col(wallet).alias("base_wallet"),
        *flat_address(F.col("f"), "from"), *flat_address(F.col("to"), "to"),
    ]
    taken = {"tx_hash", "token_symbol", "token_address", "amount", "amount_usd", "chain", "timestamp", "direction_reported", "base_wallet", "status", "error"} | {f"{s}_{k}" for s in ("from", "to") for k in ("address", "entity", "entity_type", "label")}
    own = [F.col(c).alias(f"src_{c}" if c in taken else c) for c in source_columns]
    return t.select(*core, *own, F.lit("OK").alias("status"), F.lit("").alias("error"))


def status_rows(inputs: DataFrame, legs: DataFrame, errors: DataFrame, address: str) -> DataFrame:
    """``address, status, error`` of every input: Skipped (blank), Error, No Results or OK; pages read before an error count."""
    a = F.trim(F.coalesce(F.col(address), F.lit("")))
    got = legs.groupBy(F.col("base_wallet").alias("_a")).agg(F.count("*").alias("legs"))
    bad = errors.select(F.col("base_wallet").alias("_b"), F.col("error").alias("_e"))
    j = inputs.select(a.alias("address")).join(got, F.col("address") == F.col("_a"), "left").join(bad, F.col("address") == F.col("_b"), "left")
    status = F.when(F.col("address") == "", "Skipped").when(F.col("legs") > 0, "OK").when(F.col("_e").isNotNull(), "Error").otherwise("No Results")
    return j.select("address", status.alias("status"), F.coalesce("_e", F.lit("")).alias("error"))


EDGE = ("tx_hash", "token_symbol", "token_address", "amount", "amount_usd", "chain", "timestamp", "base_wallet")


def edges(legs: DataFrame, order: str) -> DataFrame:
    """``from, to``, the first leg's details and how many legs there are."""
    ok = legs.where((F.coalesce("from_address", F.lit("")) != "") & (F.coalesce("to_address", F.lit("")) != ""))
    g = ok.groupBy(F.col("from_address").alias("from"), F.col("to_address").alias("to")).agg(F.min_by(F.struct(*EDGE), order).alias("e"), F.count("*").alias("count"))
    return g.select("from", "to", *(F.col(f"e.{c}").alias(c) for c in EDGE), "count")


def nodes(legs: DataFrame, order: str) -> DataFrame:
    """``address, label``: the label first seen."""
    side = lambda p, k: legs.select(F.col(f"{p}_address").alias("address"), F.coalesce(f"{p}_entity", f"{p}_label", f"{p}_address").alias("label"), (F.col(order) * 2 + k).alias("_o"))
    return side("from", 0).unionByName(side("to", 1)).where("address <> ''").groupBy("address").agg(F.min_by("label", "_o").alias("label"))


