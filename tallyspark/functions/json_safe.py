"""Rows as JSON records that any parser takes: a conversion that follows the schema, however nested.

Numbers without a JSON form (NaN, infinities) become null, days and times become ISO text, bytes Base64, intervals
and variants text, and map keys text.  Decimals stay exact numbers.  Nulls are kept as nulls, so every record has
every field.  The conversion is built from the schema once; rows are converted by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.FloatType, T.DoubleType)
_PLAIN = (T.StringType, T.BooleanType, T.IntegralType, T.DecimalType, T.NullType)


def changes(kind: T.DataType) -> bool:
    """Whether values of a type have to be converted at all."""
    if isinstance(kind, T.StructType):
        return any(changes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return changes(kind.elementType)
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, T.StringType) or changes(kind.valueType)
    return not isinstance(kind, _PLAIN)


def json_safe(c: Column, kind: T.DataType) -> Column:
    """The column with JSON-safe values, in the same shape."""
    if not changes(kind):
        return c
    if isinstance(kind, T.StructType):
        whole = F.struct(*[json_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), whole)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.transform(F.map_keys(c), lambda k: _key_text(k, kind.keyType))
        # keys that come to the same text would be an error of the map: the last one of them counts, as in any JSON reader
        entries = F.arrays_zip(keys.alias("k"), F.transform(F.map_values(c), lambda v: json_safe(v, kind.valueType)).alias("v"))
        names = F.array_distinct(keys)
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"].eqNullSafe(n)), -1)["v"]))
    if isinstance(kind, _NUMBERS):
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def _key_text(k: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(json_safe(k, kind))
    return F.base64(k) if isinstance(kind, T.BinaryType) else k.cast("string")


def to_json_records(df: DataFrame, keep: list[str] = (), name: str = "record") -> DataFrame:
    """The columns ``keep`` as they are, and all columns of each row as one JSON object."""
    safe = F.struct(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.to_json(safe, {"ignoreNullFields": "false"}).alias(name))
