"""Daily salts of cookieless ids: kept for today and yesterday, then gone for good."""

from __future__ import annotations

import secrets
from datetime import date, datetime, timedelta

from pyspark.sql import SparkSession

from meridio.sources.shared import file_system

DAYS = 2


def accepted(now: datetime) -> list[date]:
    """The days whose events may still be given an id: a day's salt lives until the second midnight after its start."""
    return [now.date() - timedelta(days=i) for i in range(DAYS)]


def rotate(spark: SparkSession, folder: str, now: datetime, mint=lambda: secrets.token_bytes(32)) -> dict[str, bytes]:
    """The salts of the accepted days by day, minted where there is none; those of other days are deleted.

    The first writer of a day's file wins, and all others read what it wrote.
    """
    fs, root = file_system(spark, folder)
    fs.mkdirs(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    days = {d.isoformat() for d in accepted(now)}
    for status in fs.listStatus(root):
        if status.getPath().getName() not in days:
            fs.delete(status.getPath(), True)
    out = {}
    for day in sorted(days):
        at = path(f"{folder}/{day}")
        if not fs.exists(at):
            draft = path(f"{folder}/{day}.{secrets.token_hex(8)}")
            stream = fs.create(draft, False)
            stream.write(bytearray(mint()))
            stream.close()
            # a rename to a file that is there fails on most stores, and leaves the first writer's on all others that were asked before
            if fs.exists(at) or not fs.rename(draft, at):
                fs.delete(draft, True)
        stream = fs.open(at)
        out[day] = bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
    return out
