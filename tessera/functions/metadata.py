"""Column functions on metadata: entity values with types, and JSON texts read by key and type."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the schema of a JSON value starts with, by kind, and the type it is read as.
KINDS = {"text": (("STRING",), "string"), "number": (("BIGINT", "DOUBLE", "DECIMAL"), "double"), "whole": (("BIGINT",), "bigint"), "flag": (("BOOLEAN",), "boolean"), "list": (("ARRAY",), "array<string>")}


def coerced(value: Column, kind: str) -> Column:
    """An entity's text as whole, number or flag; what isn't one is 0 or false. Other kinds stay text."""
    if kind == "flag":
        return F.coalesce(F.lower(F.trim(value)).isin("true", "1"), F.lit(False))
    if kind in ("whole", "number"):
        return F.coalesce(F.trim(value).try_cast("bigint" if kind == "whole" else "double"), F.lit(0))
    return value


def padded(value: Column) -> Column:
    """struct<value, formatted>: a number as it was written; compares and groups by value first."""
    return F.when(value.isNotNull(), F.struct(coerced(value, "whole").alias("value"), value.alias("formatted")))


def field(data: Column, key: str, kind: str) -> Column:
    """An entry of a JSON text by its exact kind: text, number, whole, flag or list; null where it is another or missing."""
    starts, cast = KINDS[kind]
    found = F.try_variant_get(F.try_parse_json(data), f"$['{key}']", "variant")
    shape = F.schema_of_variant(found)
    fits = F.lit(False)
    for s in starts:
        fits = fits | shape.startswith(s)
    return F.when(fits, F.try_variant_get(found, "$", cast))


def numbers(data: Column, key: str) -> Column:
    """A scalar or an array of numbers as an array; empty where there is none (echo times, flip angles)."""
    found = F.try_variant_get(F.try_parse_json(data), f"$['{key}']", "variant")
    one, many = F.try_variant_get(found, "$", "double"), F.try_variant_get(found, "$", "array<double>")
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), F.filter(many, lambda x: x.isNotNull())).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<double>"))


def as_struct(data: Column, schema: str, mandatory: list[str]) -> Column:
    """A JSON text as a struct of the schema; null as a whole where a mandatory field is missing or has another type."""
    s = F.from_json(data, schema)
    whole = F.lit(True)
    for m in mandatory:
        whole = whole & s[m].isNotNull()
    return F.when(whole, s)


def total(data: Column, keys: list[str]) -> Column:
    """The sum of whole entries (channel counts); missing ones count 0."""
    return sum((F.coalesce(field(data, k, "whole"), F.lit(0)) for k in keys), F.lit(0))


def snake_keys(data: Column) -> Column:
    """A JSON text whose keys, at every depth, are in snake case; null where it isn't JSON. Values stay as they are."""

    @F.pandas_udf("string")
    def converted(texts):
        import pandas as pd

        def snake(name: str) -> str:
            return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()

        def walk(v):
            if isinstance(v, dict):
                return {snake(k): walk(x) for k, x in v.items()}
            return [walk(x) for x in v] if isinstance(v, list) else v

        def one(t):
            try:
                return None if t is None else json.dumps(walk(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return pd.Series([one(t) for t in texts])

    return converted(data)


def lookup(inherited, path: str):
    """key, value of one path, from the rows of associations.inherited()."""
    return inherited.where(F.col("path") == path).select("key", "value")


def repetition_time(inherited):
    """tr: the one repetition time of all rows, to five digits; several, or none, are an error."""
    tr = F.round(F.col("value").try_cast("double"), 5)
    found = inherited.where("key = 'RepetitionTime'").agg(F.min(tr).alias("low"), F.max(tr).alias("high"))
    text = F.when(F.col("low").isNull(), F.lit("no repetition time")).otherwise(F.concat_ws(" ", F.lit("several repetition times, from"), "low", F.lit("to"), "high"))
    return found.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(text).cast("double")).alias("tr"))


def world(affine: list[list[float]] | Column, i: Column, j: Column, k: Column) -> list[Column]:
    """x, y, z of a voxel by the three upper rows of a 4 x 4 matrix, given as numbers or as a column of header tables."""
    if isinstance(affine, Column):
        affine = [[F.get(F.get(affine, r), c) for c in range(4)] for r in range(3)]
    return [(i * r[0] + j * r[1] + k * r[2] + r[3]).alias(n) for n, r in zip("xyz", affine, strict=False)]
