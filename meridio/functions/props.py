"""Property projections, time buckets, and aggregations.

Events have property maps `auto` (keys begin with $) and `custom`, of VARIANT values, and promoted
columns. An absent property projects to the empty string, and to a null number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Promoted keys, their columns and kinds.
PROMOTED = {
    "$bot_score": ("bot_score", "uint8"), "$verified_bot": ("verified_bot", "bool?"), "$mobile": ("mobile", "bool"),
    "$country": ("country", "string"), "$region": ("region", "string"), "$city": ("city", "string"),
    "$browser": ("browser", "string"), "$browserVersion": ("browser_version", "string"), "$os": ("os", "string"),
    "$osVersion": ("os_version", "string"), "$device": ("device", "string"), "$platform": ("platform", "string"),
    "$url": ("url", "string"), "$utmSource": ("utm_source", "string"), "$utmMedium": ("utm_medium", "string"),
    "$utmCampaign": ("utm_campaign", "string"), "$pathname": ("pathname", "string"), "$hostname": ("hostname", "string"),
    "$referrer": ("referrer", "string"), "$referrerDomain": ("referrer_domain", "string"), "$channel": ("channel", "string"),
    "$locale": ("locale", "string"), "$screenSize": ("screen_size", "string"), "$utmTerm": ("utm_term", "string"),
    "$utmContent": ("utm_content", "string"), "$pageTitle": ("page_title", "string"),
}
STRING_COLUMNS = [c for c, kind in PROMOTED.values() if kind == "string"]
COOKIELESS = "cookieless-"
OTHERS = "$others"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(text: Column) -> Column:
    """A double, or null where the string isn't exactly a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def double_string(x: Column) -> Column:
    """Whole doubles without a fraction, as 100 for 100.0."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def variant_string(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), "").when(kind.isin("DOUBLE", "FLOAT"), double_string(F.try_variant_get(v, "$", "double"))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def variant_number(v: Column) -> Column:
    """The number of a double or integer value, else what its string parses to; booleans have none."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", parse_number(F.try_variant_get(v, "$", "string"))).when(
        kind.isin("DOUBLE", "FLOAT", "BIGINT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double")
    )


def prop_string(name: str) -> Column:
    """The property as a string, empty if absent. A plain key reads auto first, then custom."""
    if name in PROMOTED:
        column, kind = PROMOTED[name]
        c = F.col(column)
        return F.coalesce(c if kind == "string" else c.cast("string"), F.lit(""))
    auto = variant_string(F.col("auto")[name])
    if name.startswith("$"):
        return auto
    return F.coalesce(F.nullif(auto, F.lit("")), variant_string(F.col("custom")[name]))


def prop_number(name: str) -> Column:
    """The property as filters compare it: by its typed value, or a parsed string; null if it has no number."""
    if name in PROMOTED and PROMOTED[name][1] in ("string", "uint8"):
        c = F.col(PROMOTED[name][0])
        return parse_number(c) if PROMOTED[name][1] == "string" else c.cast("double")
    auto = F.col("auto")[name]
    return F.when(variant_string(auto) != "", variant_number(auto)).otherwise(variant_number(F.col("custom")[name]))


def path_string(document: Column, path: str) -> Column:
    """A dotted path of a profile's properties, as a string."""
    return variant_string(F.try_variant_get(document, json_path(path), "variant"))


def path_number(document: Column, path: str) -> Column:
    return variant_number(F.try_variant_get(document, json_path(path), "variant"))


def json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def bucket(ts: Column, granularity: str, timezone: str = "") -> Column:
    """The start of the minute, hour, day, week (from Sunday) or month, as an instant."""
    local = F.from_utc_timestamp(ts, timezone) if timezone and timezone != "UTC" else ts
    if granularity == "week":
        out = F.date_trunc("week", local + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    else:
        out = F.date_trunc(granularity, local)
    return F.to_utc_timestamp(out, timezone) if timezone and timezone != "UTC" else out


def identified(include_cookieless: bool) -> Column:
    """Whether an event counts where users are counted."""
    return F.lit(True) if include_cookieless else ~F.startswith(F.col("distinct_id"), F.lit(COOKIELESS))


def aggregation(kind: str, prop: str = "", when: Column | None = None, include_cookieless: bool = False, approximate: bool = False) -> Column:
    """An aggregate over the rows where `when` holds; 0 where there are none.

    Counts of users leave out cookieless ids inside the aggregate, so others in one scan keep them.
    """
    user = F.col("distinct_id")
    on = F.lit(True) if when is None else when
    users = F.approx_count_distinct if approximate else F.count_distinct
    if kind == "total":
        return F.count(F.when(on, 1)).cast("double")
    if kind in ("unique_users", "per_user_avg"):
        of = on & identified(include_cookieless)
        n = users(F.when(of, user)).cast("double")
        return n if kind == "unique_users" else F.coalesce(F.count(F.when(of, 1)) / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    x = F.when(on, parse_number(prop_string(prop)))
    return F.coalesce(getattr(F, kind)(x), F.lit(0.0))
