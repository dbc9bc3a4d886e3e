"""Dashboards: all tiles over one window, failures kept apart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from meridio.plans.router import Rollups, execute
from meridio.plans.spec import Request, Spec
from meridio.sources.tables import Tables

AT_ONCE, DEFAULT_DAYS = 8, 30


@dataclass(frozen=True)
class Tile:
    name: str
    spec: Spec
    granularity: str = ""


@dataclass
class Rendered:
    tile: Tile
    rows: list | None = None
    error: str | None = None


def preset(name: str, now: datetime, timezone: str = "UTC") -> tuple[datetime, datetime]:
    """'24h' is the last hours; '7d' begins at local midnight six days ago. now is naive UTC."""
    n = int(name[:-1])
    if name.endswith("h"):
        return now - timedelta(hours=n), now
    if not name.endswith("d") or n < 1:
        raise ValueError(f"unknown range {name}")
    zone = ZoneInfo(timezone or "UTC")
    local = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone)
    start = (local - timedelta(days=n - 1)).replace(hour=0, minute=0, second=0, microsecond=0)
    return start.astimezone(ZoneInfo("UTC")).replace(tzinfo=None), now


def window(now: datetime, override: tuple[datetime, datetime] | str | None = None, default: str = f"{DEFAULT_DAYS}d", timezone: str = "UTC") -> tuple[datetime, datetime]:
    if isinstance(override, tuple):
        return override
    return preset(override or default, now, timezone)


def prior(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The window of equal length before."""
    return start - (end - start), start


def request(tile: Tile, start: datetime, end: datetime, timezone: str, now: datetime) -> Request:
    return Request(tile.spec, start, end, tile.granularity or "day", timezone, now)


def render(tables: Tables, tiles: list[Tile], start: datetime, end: datetime, now: datetime, timezone: str = "", rollups: Rollups | None = None) -> list[Rendered]:
    """Tiles run as jobs side by side; an error is that of its tile alone."""

    def one(tile: Tile) -> Rendered:
        try:
            found: DataFrame = execute(tables, request(tile, start, end, timezone, now), rollups)
            return Rendered(tile, rows=found.collect())  # bounded by the range caps and limits of specs
        except Exception as e:  # noqa: BLE001  a tile's failure is a message on it
            return Rendered(tile, error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(one, tiles))
