"""Staged event frames with the burst flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..plans.timeslice import flag_repeat_within
from ..plans.rollup import EVENT_TYPES
from ..sources.streams import Streams

# what has to repeat for an event to count as a burst; searches carry no item
BURST_KEYS = {
    "product_buy": ["client_id", "sku"],
    "add_to_cart": ["client_id", "sku"],
    "remove_from_cart": ["client_id", "sku"],
    "page_visit": ["client_id", "url"],
    "search_query": ["client_id"],
}


def staged(streams: Streams, event_type: str, p: Params) -> DataFrame:
    """One stream with ``is_burst_repeat``; rows are flagged, never dropped."""
    return flag_repeat_within(streams.by_type()[event_type], BURST_KEYS[event_type], p.burst_seconds)


def staged_flags(streams: Streams, p: Params) -> DataFrame:
    """``(event_type, client_id, is_burst_repeat)`` over all five streams."""
    out = None
    for name in EVENT_TYPES:
        part = staged(streams, name, p).select(F.lit(name).alias("event_type"), "client_id", "is_burst_repeat")
        out = part if out is None else out.unionByName(part)
    return out


def unified_events(streams: Streams) -> DataFrame:
    """All events of all types with a type tag; duplicates stay."""
    return streams.events.select("client_id", "event_ts", "event_type")
