"""JSON columns changed in part, with Spark's VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(column: Column, patch: Column) -> Column:
    """The JSON of patch where it is given (not null) and valid, else that of column."""
    return F.to_json(F.coalesce(F.try_parse_json(patch), F.try_parse_json(column)))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _fields(v: Column) -> Column:
    return v.cast("map<string,variant>")


def _merged(old: Column, new: Column, depth: int) -> Column:
    """new, but objects on both sides are merged by field for depth levels; fields that new sets to null go."""
    if not depth:
        return new
    kept = lambda k, v: F.coalesce(~F.is_variant_null(v), F.lit(False))
    pick = lambda k, a, b: F.when(b.isNull(), a).when(a.isNotNull() & _is_object(a) & _is_object(b), _merged(a, b, depth - 1)).otherwise(b)
    both = F.map_filter(F.map_zip_with(_fields(old), _fields(new), pick), lambda k, v: kept(k, v) | ~F.map_contains_key(_fields(new), k))
    return F.when(_is_object(old) & _is_object(new), F.to_variant_object(both)).otherwise(new)


def merged(column: Column, patch: Column, depth: int = 3) -> Column:
    """JSON of column with the fields of patch put in, objects in objects for depth levels (deeper ones and arrays are replaced whole).

    A field that patch sets to null is taken out; a null patch, or one that is no JSON, changes nothing; where either side is no object,
    patch replaces it. Fields come in the order of their names.
    """
    old, new = F.try_parse_json(column), F.try_parse_json(patch)
    return F.to_json(F.when(new.isNull(), old).when(old.isNull(), new).otherwise(_merged(old, new, depth)))
