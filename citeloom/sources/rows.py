"""Stored rows and the objects they stand for: nested parts are JSON texts in a row and structs in an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = "struct<tableId string, rowIndex int, columnIndex int, columnName string, rowSpanId string, isHeader boolean>"
LOCATION = "struct<page int, startPage int, endPage int, charStart long, charEnd long, lineStart int, lineEnd int, fieldPath string>"
BBOX = "array<struct<page int, x double, y double, width double, height double>>"
#: Columns of stored spans and chunks that are JSON, with their types; all but ids may be absent.
SPANS = {"table_location": TABLE, "location": LOCATION, "bbox": BBOX, "metadata": "map<string,string>"}
CHUNKS = {"source_span_ids": "array<string>", "metadata": "map<string,string>"}


def _empty(kind: str) -> Column | None:
    return F.create_map().cast(kind) if kind.startswith("map") else F.array().cast(kind) if kind == "array<string>" else None


def decoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows with JSON columns read; a text that is empty or no JSON gives what an absent one does: no struct, an empty map, no ids."""
    made = {}
    for c, kind in kinds.items():
        value, none = F.from_json(F.when(F.try_parse_json(c).isNotNull(), F.col(c)), kind), _empty(kind)
        made[c] = value if none is None else F.coalesce(value, none)
    return rows.withColumns(made)


def encoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows with those columns written as JSON; an absent map is an empty object, other absent values stay null."""
    made = {c: F.to_json(F.coalesce(F.col(c), _empty(kind)) if kind.startswith("map") else F.col(c)) for c, kind in kinds.items()}
    return rows.withColumns(made)
