"""Names and storage types derived from an ABI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IDENTIFIER = 63

# Columns a parameter may not take the name of.
RESERVED = ["block_number", "tx_hash", "log_index", "block_time", "tx_index", "_ingested_at"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a column named twice is worked out twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snake_case(c: Column) -> Column:
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    c = F.regexp_replace(c, "[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(c, "^_+|_+$", ""))


def identifier(c: Column) -> Column:
    """The name itself, or an error when it would be cut short."""
    def checked(name: Column) -> Column:
        text = F.concat(F.lit("identifier exceeds 63 bytes: "), name)
        return F.when(F.octet_length(name) > MAX_IDENTIFIER, F.raise_error(text)).otherwise(name)

    return let(c, checked)


def storage_type(abi_type: Column) -> Column:
    return (
        F.when(abi_type.endswith("]") | abi_type.startswith("tuple"), "json")
        .when(abi_type == "address", "integer")
        .when(abi_type == "bool", "boolean")
        .when(abi_type == "string", "text")
        .when(abi_type.rlike(r"^bytes(\d+)?$"), "binary")
        .when(abi_type.rlike(r"^u?int\d*$"), "numeric(78,0)")
        .otherwise(F.raise_error(F.concat(F.lit("Unknown ABI type: "), abi_type)))
    )
