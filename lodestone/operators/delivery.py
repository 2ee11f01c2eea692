"""Delivery of entries to a consumer group: acknowledgement, retries with doubling delay, expiry.

One entry of a key is open at a time. What happens to it is a list of transitions (at, status,
attempt): ``delivered`` when it is opened, ``waiting`` when an attempt has failed and another is
due, ``retry`` when that one begins, ``failed`` when none is left, ``completed`` when it is
acknowledged, ``expired`` when it has been open for too long. Retries and expiry come from
timers, at their due times, whether or not anything else happens then.

The rules are two plain functions on a small state. In batches they run over sorted rows
(:func:`delivered`), in streams with timers on event time
(:func:`lodestone.streaming.jobs.deliveries`); both give the same transitions.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import carried


class Rules(NamedTuple):
    """Retries beyond the first attempt, seconds before the first of them, seconds an entry may be open."""

    retries: int = 3
    delay: float = 2.0
    ttl: float = 3600.0


class Entry:
    """The open entry of a key, if any: since when, which attempt, and when the next one is due."""

    def __init__(self, opened: float | None = None, attempt: int = 0, due: float | None = None):
        self.opened, self.attempt, self.due = opened, attempt, due

    def next_timer(self, rules: Rules) -> float | None:
        if self.opened is None:
            return None
        end = self.opened + rules.ttl
        return end if self.due is None else min(self.due, end)


def advance(entry: Entry, now: float, rules: Rules) -> list[tuple[float, str, int]]:
    """Transitions of all timers due at ``now`` or before; an expiry comes before a retry of the same time."""
    out = []
    while (at := entry.next_timer(rules)) is not None and at <= now:
        if at == entry.opened + rules.ttl:
            out.append((at, "expired", entry.attempt))
            entry.opened = entry.due = None
        else:
            entry.attempt, entry.due = entry.attempt + 1, None
            out.append((at, "retry", entry.attempt))
    return out


def happen(entry: Entry, now: float, kind: str, rules: Rules) -> list[tuple[float, str, int]]:
    """Transitions up to and by an event. ``kind``: ``ack``, ``error``, ``end`` (only lets time pass) or anything else.

    Any event but the end opens an entry if none is open. Of an open one an acknowledgement
    counts at any time, an error only while an attempt runs, anything else not at all.
    """
    out = advance(entry, now, rules)
    if kind == "end":
        return out
    if entry.opened is None:
        entry.opened, entry.attempt, entry.due = now, 0, None
        return [*out, (now, "delivered", 0)]
    if kind == "ack":
        entry.opened = entry.due = None
        return [*out, (now, "completed", entry.attempt)]
    if kind == "error" and entry.due is None:
        if entry.attempt >= rules.retries:
            entry.opened = None
            return [*out, (now, "failed", entry.attempt)]
        entry.due = now + rules.delay * 2**entry.attempt
        return [*out, (now, "waiting", entry.attempt)]
    return out


_TRANSITIONS = pa.list_(pa.struct([("at", pa.float64()), ("status", pa.string()), ("attempt", pa.int32())]))


def delivered(events: DataFrame, key: str, seconds: str, tie: str, kind: str, rules: Rules, until: float) -> DataFrame:
    """(key, at, status, attempt): all transitions of ``events`` up to the time ``until``, those of timers included.

    Events are taken by time, then ``tie``; the state of a key is its open entry. Events after ``until`` don't count.
    """
    chosen = events.where(F.col(seconds) <= until).select(F.col(key).alias(key), F.col(seconds).cast("double").alias("seconds"), F.col(tie).cast("long").alias("tie"), F.col(kind).cast("string").alias("kind"))
    ends = chosen.select(key).distinct().select(key, F.lit(float(until)).alias("seconds"), F.lit((1 << 63) - 1).alias("tie"), F.lit("end").alias("kind"))
    step = lambda entry, t, what: [{"at": a, "status": s, "attempt": n} for a, s, n in happen(entry, t, what or "", rules)]
    found = carried(chosen.union(ends), key, ["seconds", "tie"], ["seconds", "kind"], Entry, step, ("transitions", "array<struct<at:double,status:string,attempt:int>>", _TRANSITIONS))
    return found.select(key, F.explode("transitions").alias("x")).select(key, "x.at", "x.status", "x.attempt")
