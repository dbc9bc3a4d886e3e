"""Sessions of cookieless visitors: 30 minutes without an event end one.

In batches the events are in order, and gaps are found by a window. In a stream they come in any order:
the state of a visitor is the open session and the time of its last event, which never goes back. An event
too far before it, as of a batch sent late, has a session of the fixed half-hour that it falls in.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridio.functions.props import COOKIELESS
from meridio.sources.tables import ZERO

GAP_SECONDS, STATE_HOURS = 1800, 24
#: Events are taken as long as a salt may live: none that has an id is too late.
LATE = "2 days"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "sessions.meridio")
VISITOR = ["project_id", "distinct_id"]


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in NAMESPACE."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def name_of(distinct_id: str, day: str, mark: str, millis: int) -> str:
    return f"{distinct_id}|{day}|{mark}{millis}"


def wants_session() -> Column:
    return F.startswith(F.col("distinct_id"), F.lit(COOKIELESS)) & F.coalesce(F.col("session_id"), F.lit("")).isin("", ZERO)


def sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """events with session_id where a cookieless one has none: the same for the same events, however often it runs."""
    order = Window.partitionBy(*VISITOR, "__wants").orderBy("occur_time", "event_id")
    gap = F.unix_micros("occur_time") - F.lag(F.unix_micros("occur_time")).over(order)
    begins = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), F.col("occur_time"))
    marked = events.withColumn("__wants", wants_session()).withColumn("__begins", begins)
    start = F.last("__begins", ignorenulls=True).over(order)
    name = F.concat_ws("|", "distinct_id", F.date_format(start, "yyyy-MM-dd"), F.concat(F.lit("s"), F.unix_millis(start).cast("string")))
    return marked.withColumn("session_id", F.when(F.col("__wants"), uuid5(name)).otherwise(F.col("session_id"))).drop("__wants", "__begins")


def assign(distinct_id: str, times: list[pd.Timestamp], state: tuple[str, int] | None, gap_seconds: int = GAP_SECONDS) -> tuple[list[str], tuple[str, int] | None]:
    """Session ids of a visitor's events in the order that they came, and the state after them: (open session, its last time in milliseconds)."""
    gap, out = gap_seconds * 1000, []
    for t in times:
        ms, day = int(t.value // 1_000_000), t.strftime("%Y-%m-%d")
        if state is not None and abs(ms - state[1]) <= gap:
            state = state[0], max(ms, state[1])
        elif state is None or ms > state[1]:
            state = str(uuid.uuid5(NAMESPACE, name_of(distinct_id, day, "s", ms))), ms
        else:
            out.append(str(uuid.uuid5(NAMESPACE, name_of(distinct_id, day, "w", ms // gap * gap))))
            continue
        out.append(state[0])
    return out, state


def stream_sessions(stream: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """project_id, distinct_id, event_id, occur_time, session_id of a stream's cookieless events without a session."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = state.getOption
        held = tuple(held) if held is not None else None
        for frame in frames:
            frame = frame.sort_values(["occur_time", "event_id"])
            ids, held = assign(key[1], list(frame["occur_time"]), held, gap_seconds)
            yield frame.assign(session_id=ids)
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + STATE_HOURS * 3_600_000, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("occur_time", LATE).where(wants_session()).select(*VISITOR, "event_id", "occur_time")
    schema = "project_id string, distinct_id string, event_id string, occur_time timestamp, session_id string"
    return rows.groupBy(*VISITOR).applyInPandasWithState(run, schema, "session string, last long", "append", GroupStateTimeout.EventTimeTimeout)
