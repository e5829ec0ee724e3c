"""The event and function catalogs of the indexed contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.naming import RESERVED, identifier, let, snake_case

ABI = ("array<struct<type:string,name:string,topic0:string,selector:string,"
       "inputs:array<struct<name:string,type:string,indexed:boolean>>>>")


def event_catalog(abis: DataFrame) -> DataFrame:
    """One row per selected event of ``abis(contract, address, abi, selected)``.

    An event name that occurs twice in a contract gets its topic's first four
    digits appended to the table name; a selected name the ABI lacks is an error.
    Everything is decided inside the ABI's own row, so nothing shuffles.
    """
    chosen = F.coalesce("selected", F.array().cast("array<string>"))

    def picked(events: Column) -> Column:
        unknown = F.array_except(chosen, F.transform(events, lambda e: e["name"]))
        wanted = F.filter(events, lambda e: (F.size(chosen) == 0) | F.array_contains(chosen, e["name"]))
        return F.when(F.size(unknown) > 0, F.raise_error(
            F.concat("contract", F.lit(": event not found in ABI: "), F.array_join(unknown, ", ")))).otherwise(wanted)

    def selected(abi: Column) -> Column:
        return F.when(abi.isNull(), F.raise_error(F.concat("contract", F.lit(": ABI must be a JSON array")))).otherwise(
            let(F.filter(abi, lambda e: e["type"] == "event"), picked))

    read = abis.select("contract", F.lower("address").alias("address"), snake_case(F.col("contract")).alias("_name"),
                       let(F.from_json("abi", ABI), selected).alias("_wanted"))
    # outer: Spark would else ask whether the list is empty before it, and so read every ABI three times
    one = read.select("contract", "address", "_name", "_wanted", F.explode_outer("_wanted").alias("e")).filter("e IS NOT NULL")
    twice = F.size(F.filter("_wanted", lambda e: e["name"] == F.col("e.name"))) > 1
    base = F.concat_ws("_", "_name", snake_case(F.col("e.name")))
    name = F.concat_ws("_", base, F.when(twice, F.substring("e.topic0", 3, 4)))
    return one.select("contract", "address", F.col("e.name").alias("event"), F.col("e.topic0").alias("topic0"),
                      identifier(name).alias("table_name"), F.col("e.inputs").alias("inputs"))


def function_catalog(abis: DataFrame) -> DataFrame:
    return (
        abis.select("contract", F.lower("address").alias("address"), F.explode(F.from_json("abi", ABI)).alias("e"))
        .filter("e.type = 'function'")
        .select("contract", "address", F.col("e.selector").alias("selector"), F.col("e.name").alias("name"))
    )


def _stored_names(inputs: Column) -> Column:
    """array<struct<name, view_name, abi_type, indexed>> in parameter order."""
    def one(p, i):
        def column(view):
            name = F.when(p["type"] == "address", F.concat(view, F.lit("_id"))).otherwise(view)
            return F.struct(name.alias("name"), view.alias("view_name"), p["type"].alias("abi_type"),
                            F.coalesce(p["indexed"], F.lit(False)).alias("indexed"))

        raw = F.when(F.length(p["name"]) > 0, snake_case(p["name"])).otherwise(F.concat(F.lit("arg"), i.cast("string")))
        return let(let(raw, lambda r: F.when(r.isin(*RESERVED), F.concat(F.lit("param_"), r)).otherwise(r)), column)
    return F.transform(inputs, one)


def event_columns(catalog: DataFrame) -> DataFrame:
    """One row per parameter: stored and viewed name; a duplicate of either in one event is an error."""
    def clash(cols, field):
        names = F.transform(cols, lambda c: c[field])
        return F.size(F.array_distinct(names)) < F.size(names)

    def checked(cols):
        return F.when(clash(cols, "name"), F.raise_error(F.concat("event", F.lit(": column name collision")))).when(
            clash(cols, "view_name"), F.raise_error(F.concat("event", F.lit(": view column name collision")))).otherwise(cols)

    x = catalog.withColumn("_cols", let(_stored_names(F.col("inputs")), checked))
    return x.select("table_name", F.posexplode_outer("_cols").alias("pos", "c")).filter("pos IS NOT NULL").select(
        "table_name", "pos", "c.name", "c.view_name", "c.abi_type", "c.indexed")


def is_transfer(inputs: Column, topic0: Column) -> Column:
    """An ERC-20 shaped Transfer; ERC-721 logs the same topic with its third parameter indexed."""
    third = F.try_element_at(inputs, F.lit(3))
    return F.coalesce(
        (topic0 == V.TRANSFER_TOPIC) & (F.size(inputs) == 3)
        & (F.try_element_at(inputs, F.lit(1))["type"] == "address")
        & (F.try_element_at(inputs, F.lit(2))["type"] == "address")
        & (third["type"] == "uint256") & ~F.coalesce(third["indexed"], F.lit(False)),
        F.lit(False),
    )
