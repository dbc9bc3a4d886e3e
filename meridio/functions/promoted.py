"""Promoted properties: taken out of the map at ingest, put back for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridio.functions.props import PROMOTED

#: Of each kind of promoted column: the variant type that it takes, and the column's own.
KINDS = {"string": ("STRING", "string"), "bool": ("BOOLEAN", "boolean"), "bool?": ("BOOLEAN", "boolean"), "uint8": ("BIGINT", "int")}


def fits(kind: str, value: Column) -> Column:
    """The value is of the column's type; scores are 0 to 255."""
    right = F.coalesce(F.schema_of_variant(value) == KINDS[kind][0], F.lit(False))
    return right & F.coalesce(F.try_variant_get(value, "$", "bigint").between(0, 255), F.lit(False)) if kind == "uint8" else right


def split(events: DataFrame) -> DataFrame:
    """Promoted keys of `auto` become columns where their type fits; other values stay in the map."""
    auto, out = F.col("auto"), {}
    for key, (column, kind) in PROMOTED.items():
        v = auto[key]
        found = F.when(fits(kind, v), F.try_variant_get(v, "$", KINDS[kind][1]))
        empty = {"string": F.lit(""), "bool": F.lit(False)}.get(kind, F.lit(None))
        had = F.col(column) if column in events.columns else empty
        out[column] = F.coalesce(found.cast("short") if kind == "uint8" else found, had.cast("short") if kind == "uint8" else had)
    of = lambda kind: [k for k, (_, x) in PROMOTED.items() if x == kind]
    moved = lambda k, v: (k.isin(of("string")) & fits("string", v)) | (k.isin(of("bool") + of("bool?")) & fits("bool", v)) | (k.isin(of("uint8")) & fits("uint8", v))
    return events.withColumns(out | {"auto": F.map_filter("auto", lambda k, v: ~moved(k, v))})


def merged(events: DataFrame) -> Column:
    """`auto` with the promoted columns that are set, as strings; a non-empty string of the map itself wins."""
    text = {"string": lambda c: c, "bool": lambda c: F.when(c, "true"), "bool?": lambda c: c.cast("string"), "uint8": lambda c: c.cast("string")}
    each = F.array(*[F.struct(F.lit(key).alias("key"), F.coalesce(text[kind](F.col(column)), F.lit("")).alias("value")) for key, (column, kind) in PROMOTED.items() if column in events.columns])
    own = lambda key: F.coalesce(F.try_variant_get(F.try_element_at("auto", key), "$", "string"), F.lit(""))
    stays = lambda key: F.coalesce(F.schema_of_variant(F.try_element_at("auto", key)) == "STRING", F.lit(False)) & (own(key) != "")
    added = F.map_from_entries(F.transform(F.filter(each, lambda e: (e["value"] != "") & ~stays(e["key"])), lambda e: F.struct(e["key"], e["value"].cast("variant"))))
    return F.map_concat(F.map_filter("auto", lambda k, _: ~F.map_contains_key(added, k)), added)
