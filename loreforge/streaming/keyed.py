"""Keyed state in event-time order, with timers.

``in_order`` runs one machine for each key of a stream.  Events wait in the key's state
until the watermark has passed them and are then given to the machine in order of time
and id; a timer that the machine has set fires between them, or with no further event of
the key once the watermark has passed it.  What comes out therefore depends on the
events alone, not on how they fall into micro-batches, and a query that is started again
goes on from its checkpoint.  Events that arrive at or behind the watermark are dropped, and
those that it has not passed yet are still waiting when a query over all available input
ends.

Defined results: events without key or time are left out; events of one time go by id;
a timer at the very time of an event fires after it.  A key's state holds the events of
the delay, and whatever its machine keeps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: What a machine keeps (JSON), when it wants to be woken (microseconds), and its rows.
Step = tuple[object, int | None, list[tuple]]


@dataclass(frozen=True)
class Machine:
    """``event(kept, at, id, fields)`` and ``wake(kept, at)`` each give the next Step; ``kept`` is None at first and is dropped when it is None again."""

    event: Callable[[object, int, object, list], Step]
    wake: Callable[[object, int], Step] | None = None
    #: Which events, by their fields, the machine is given at all.
    wants: Callable[[list], bool] = lambda fields: True


def _listed(column: pd.Series) -> list:
    """Plain values of a column, None for what is missing."""
    values = column.tolist()
    return [None if pd.isna(v) else v for v in values] if column.hasnans else values


def in_order(stream: DataFrame, fields: list[str], machine: Machine, output: str, delay: str, wanted: Column | None = None) -> DataFrame:
    """Rows (key, *output) of one machine for each key of a stream of (key, at, id, *fields); ``at`` is a timestamp.

    Events that are not ``wanted`` (over the fields) move the watermark on and go no further.
    """
    named = StructType.fromDDL(output).names
    key_type = stream.schema["key"].dataType.simpleString()
    ready = stream.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    if wanted is not None:  # names the time, so that Spark does not put it before the watermark
        ready = ready.where(F.when(F.col("at").isNotNull(), wanted))
    ready = ready.select("key", "at", F.unix_micros("at").alias("us"), "id", *fields)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        kept, timer, waiting = json.loads(state.get[0]) if state.exists else (None, None, [])
        for batch in batches:
            rows = zip(*(_listed(batch[c]) for c in ("us", "id", *fields)))
            waiting += [[us, ident, rest] for us, ident, *rest in rows if us > passed and machine.wants(rest)]
        waiting.sort(key=lambda e: (e[0], e[1] is not None, e[1]))
        out, n = [], 0
        while True:
            due = waiting[n][0] if n < len(waiting) and waiting[n][0] < passed else None
            if due is not None and (timer is None or due <= timer):
                kept, timer, rows = machine.event(kept, *waiting[n])
                n += 1
            elif timer is not None and timer < passed:
                kept, timer, rows = machine.wake(kept, timer)
            else:
                break
            out += rows
        waiting = waiting[n:]
        if kept is None and timer is None and not waiting:
            state.remove()
        else:
            state.update((json.dumps([kept, timer, waiting]),))
            nexts = [e[0] for e in waiting[:1]] + [t for t in (timer,) if t is not None]
            if nexts:
                state.setTimeoutTimestamp(max(min(nexts), passed) // 1000 + 1)
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=["key", *named])

    return ready.groupBy("key").applyInPandasWithState(run, f"key {key_type}, {output}", "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def only(machine: Machine) -> Machine:
    """The machine over those events whose first field is true; the others still move the watermark on."""

    def event(kept, at, ident, fields):
        return machine.event(kept, at, ident, fields[1:])

    return Machine(event, machine.wake, lambda fields: bool(fields[0]))


def strikes(limit: int) -> Machine:
    """Rows (at, id, strikes, quarantined) whenever the strikes of a key change; the field is whether an event is a success, which clears them.

    Events that are neither (null) do nothing.
    """

    def event(kept, at, ident, fields):
        count = 0 if fields[0] else (kept or 0) + 1
        changed = [(at, ident, count, count >= limit)] if count or kept else []
        return count or None, None, changed

    return Machine(event, None, lambda fields: fields[0] is not None)


def respawns(limit: int, seconds: int) -> Machine:
    """Rows (at, id, recent, capped) for each event: those of the key in the ``seconds`` up to it, itself included, and whether that is over the cap.

    Times in state are let go by a timer once the key has been quiet for the window.
    """
    span = seconds * 1_000_000

    def event(kept, at, ident, fields):
        times = [t for t in kept or [] if t > at - span] + [at]
        return times, at + span, [(at, ident, len(times), len(times) > limit)]

    return Machine(event, lambda kept, at: (None, None, []))


def stalls(seconds: int) -> Machine:
    """Rows (since, at) when a key was quiet for ``seconds``: work pending, the worker idle, and no more completed than before.

    Fields are pending, completed and idle.  A quiet stretch is reported once, at its
    end or as soon as it is long enough, whichever comes first in event time.
    """
    span = seconds * 1_000_000

    def event(kept, at, ident, fields):
        pending, completed, idle = fields
        last, since, told = kept or (None, None, False)
        quiet = bool(pending and pending > 0 and idle and last in (None, completed))
        if not quiet:
            return [completed, None, False], None, []
        since, told = (at, False) if since is None else (since, told)
        return [completed, since, told], None if told else since + span, []

    def wake(kept, at):
        completed, since, _ = kept
        return [completed, since, True], None, [(since, at)]

    return Machine(event, wake)


def debounced(seconds: float) -> Machine:
    """Rows (first, last, n, kind) once a key has had no event for ``seconds``: what its events (Added, Modified, Deleted) amount to.

    That is told by the first, before which the key was there unless it is Added, and the
    last, after which it is there unless it is Deleted; what neither was nor is there
    gives no row.
    """
    span = int(seconds * 1_000_000)

    def event(kept, at, ident, fields):
        first, _, n, opened, _ = kept or (at, at, 0, fields[0], None)
        return [first, at, n + 1, opened, fields[0]], at + span, []

    def wake(kept, at):
        first, last, n, opened, closed = kept
        new, gone = opened == "Added", closed == "Deleted"
        return None, None, [] if new and gone else [(first, last, n, "Added" if new else "Deleted" if gone else "Modified")]

    return Machine(event, wake)
