"""Rules over streams whose rows come out of order, with timers.

A session's rows wait in the state of its bucket until the watermark has passed them, and are then
fed to the rule in order of (stamp, rank, id). What comes out therefore doesn't depend
on how the rows were cut into micro-batches, nor on the order in which they came,
as long as none is later than the watermark allows; later ones are dropped.

A rule may also ask to be woken: ``wake(state)`` is the stamp at which ``woken(state,
session, stamp)`` is to be called unless a row comes before. The bucket's timer is
set to the earliest of its first waiting row and the rule's stamps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.folds import Rule, bucket, fed_together, plain_rows, rank_of, woken

#: What ``transformWithState`` needs.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


class Settled(StatefulProcessor):
    """State of a bucket of sessions: waiting rows, a list for each micro-batch, the rule's states and the stamp of the timer."""

    def __init__(self, rule: Rule, names: list[str]) -> None:
        self.rule, self.names = rule, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.kept = handle.getValueState("kept", "states string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, found = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            part = part[part.stamp_us // 1000 >= now]
            found += [[_plain(v) for v in row] for row in plain_rows(part[["session", "stamp_us", "id", *self.rule.columns]])]
        if found:
            self.waiting.appendValue((json.dumps(found),))
            self._set(min(row[1] for row in found))
        return iter(())

    def _set(self, stamp_us: int, anew: bool = False) -> None:
        """A timer for when the watermark has passed a stamp, unless an earlier one is set."""
        ms = stamp_us // 1000 + 1
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and not anew and old <= ms:
            return
        if old is not None and not anew:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        states = dict(json.loads(self.kept.get()[0])) if self.kept.exists() else {}
        rows = [row for some in self.waiting.get() for row in json.loads(some[0])]
        ready = sorted((r for r in rows if r[1] // 1000 < now), key=lambda r: (r[0], r[1], rank_of(self.rule, r[3:]), r[2]))
        left = [r for r in rows if r[1] // 1000 >= now]
        out = fed_together(self.rule, states, ready)
        following = [min(r[1] for r in left)] if left else []
        if hasattr(self.rule, "wake"):
            for session, state in states.items():
                out += woken(self.rule, state, session, now * 1000)
            following += [at for state in states.values() if (at := self.rule.wake(state)) is not None]
        self.kept.update((json.dumps(list(states.items())),))
        self.waiting.clear()
        if left:
            self.waiting.put([(json.dumps(left),)])
        self.timer.clear()
        if following:
            self._set(min(following), anew=True)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def settled_folded(rows: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """A stream's rows (session, stamp_us, id, ...) through a rule, in order of their stamps.

    A bucket's state holds its sessions' rows of the last ``late``, and what the rule keeps. The
    state store must be that of ``PROVIDER``.
    """
    struct = T.StructType.fromDDL(rule.schema)
    timed = rows.select("session", "stamp_us", "id", *rule.columns).withColumn("at", F.timestamp_micros("stamp_us")).withWatermark("at", late)
    return timed.withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(Settled(rule, struct.names), struct, "Append", "EventTime")
