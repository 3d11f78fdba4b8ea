"""Checks and rewrites of schemas, nested fields included; nothing here reads a row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    """Dotted names of all fields; arrays and maps are passed through."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield f"{prefix}{f.name}"
            yield from field_paths(f.dataType, f"{prefix}{f.name}.")
    elif isinstance(kind, T.ArrayType):
        yield from field_paths(kind.elementType, prefix)
    elif isinstance(kind, T.MapType):
        yield from field_paths(kind.valueType, prefix)


def forbidden_fields(frame: DataFrame, names: set[str]) -> list[str]:
    """Fields of any depth whose last name is among ``names``, case aside."""
    lower = {n.lower() for n in names}
    return [p for p in field_paths(frame.schema) if p.rsplit(".", 1)[-1].lower() in lower]


def reject_fields(frame: DataFrame, names: set[str]) -> DataFrame:
    if found := forbidden_fields(frame, names):
        raise ValueError(f"fields that may not leave: {', '.join(found)}")
    return frame


def only_fields(frame: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns, all of which must exist."""
    if missing := [c for c in allowed if c not in frame.columns]:
        raise ValueError(f"columns that lack: {', '.join(missing)}")
    return frame.select(*allowed)


def renamed(kind: T.DataType, names: dict[str, str]) -> T.DataType:
    """The type with struct fields renamed at every depth."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(names.get(f.name, f.name), renamed(f.dataType, names), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(renamed(kind.elementType, names), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, renamed(kind.valueType, names), kind.valueContainsNull)
    return kind


def rename_fields(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns and nested fields renamed; a cast by position, so no value changes."""
    return frame.select(*(F.col(f"`{f.name}`").cast(renamed(f.dataType, names)).alias(names.get(f.name, f.name)) for f in frame.schema.fields))
