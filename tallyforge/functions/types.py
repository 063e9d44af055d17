"""Types of functions that are defined before a session exists."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

_NAMES: dict[str, DataType] = {"string": StringType(), "binary": BinaryType(), "boolean": BooleanType(), "int": IntegerType(), "array<string>": ArrayType(StringType())}


def struct(fields: str) -> StructType:
    """The struct of `name type, name type`."""
    return StructType([StructField(n, _NAMES[kind]) for n, kind in (f.split() for f in fields.split(", "))])


STRING = StringType()
