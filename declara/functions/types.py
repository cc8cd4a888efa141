"""Declared column types as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Names without parameters.
PLAIN = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "BINARY": T.BinaryType(), "STRING": T.StringType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(),
    "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "TIMESTAMP_LTZ": T.TimestampType(),
    "TIMESTAMP_TZ": T.TimestampType(), "VARIANT": T.VariantType(), "OBJECT": T.VariantType(), "ARRAY": T.VariantType(), "GEOGRAPHY": T.StringType(), "GEOMETRY": T.StringType(),
}


class UnknownType(ValueError):
    pass


def spark_type(declared: str) -> T.DataType:
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", declared)
    name = m[1].upper() if m else ""
    if name in ("NUMBER", "DECIMAL", "NUMERIC"):
        return T.DecimalType(int(m[2] or 38), int(m[3] or 0))
    if name not in PLAIN:
        raise UnknownType(f"no Spark type for {declared!r}")
    return PLAIN[name]
