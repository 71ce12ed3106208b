"""Rules that go through a session's rows in order of their stamps, over tables and over streams.

A rule has ``start()``, its state before any row, made of what JSON holds, and
``step(state, row)``, which changes the state and returns the rows to put out. The
same rule folds a table, where each task reads its sorted rows and holds one
session's state, and a stream, where Spark keeps the states of the sessions, those of
a bucket of sessions together: Spark's own work for a key is then done for a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Generator, Iterable, Iterator
from itertools import groupby
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Rule(Protocol):
    """``columns``: what a row has beside session, stamp_us and id, in this order. ``schema``: what comes out.

    A rule may have ``rank``, the name of a column of whole numbers by which rows of one stamp are
    ordered before their ids, and ``wake`` and ``woken`` (see ``settled``).
    """

    columns: tuple[str, ...]
    schema: str

    def start(self): ...

    def step(self, state, session: int, stamp: int, key: int, *values) -> list[tuple]: ...


def rank_of(rule: Rule, values: list) -> int:
    rank = getattr(rule, "rank", None)
    return 0 if rank is None else values[rule.columns.index(rank)]


def woken(rule: Rule, state, session: int, before_us: int) -> list[tuple]:
    """What a rule puts out when it is woken before a stamp, as often as it asks to."""
    out: list[tuple] = []
    while hasattr(rule, "wake") and (at := rule.wake(state)) is not None and at < before_us:
        out += rule.woken(state, session, at)
    return out


def fed(rule: Rule, state, session: int, stamp: int, key: int, values: list) -> list[tuple]:
    """A row's output, after that of being woken before it."""
    return woken(rule, state, session, stamp) + rule.step(state, session, stamp, key, *values)


def fed_together(rule: Rule, states: dict, rows: Iterable[tuple]) -> list[tuple]:
    """The output of rows (session, stamp, id, *values) that are in order and by session; ``states`` has the sessions' states.

    A rule whose steps ask for what is dear to work out for one session alone has ``steps``, a
    generator of questions that returns what ``step`` does, and ``answers`` to many questions:
    each session goes on to its next question, and the questions of all are answered at once.
    """

    def through(session, some) -> Generator[object, object, list[tuple]]:
        state, out = states.setdefault(session, None) or rule.start(), []
        states[session] = state
        for _, stamp, key, *values in some:
            if hasattr(rule, "steps"):
                out += woken(rule, state, session, stamp)
                out += yield from rule.steps(state, session, stamp, key, *values)
            else:
                out += fed(rule, state, session, stamp, key, values)
        return out

    out: list[tuple] = []
    asking = [(through(session, list(some)), None) for session, some in groupby(rows, lambda row: row[0])]
    while asking:
        questions, still = [], []
        for session, answer in asking:
            try:
                questions.append(session.send(answer))
                still.append(session)
            except StopIteration as end:
                out += end.value
        asking = list(zip(still, rule.answers(questions), strict=True)) if still else []
    return out


def folded(rows: DataFrame, rule: Rule) -> DataFrame:
    """A table's rows through a rule, each session by itself in order of (stamp_us, rank, id)."""
    struct = T.StructType.fromDDL(rule.schema)
    arrow = to_arrow_schema(struct)
    names = ("session", "stamp_us", "id", *rule.columns)

    def run(batches):
        states: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            out = fed_together(rule, states, zip(*(b.column(n).to_pylist() for n in names), strict=True))
            last = b.column("session")[-1].as_py()
            states = {last: states[last]}  # the only one that may go on
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    rank = [rule.rank] if getattr(rule, "rank", None) else []
    ordered = rows.select(*names).repartition("session").sortWithinPartitions("session", "stamp_us", *rank, "id")
    return ordered.mapInArrow(run, struct)


#: Sessions of a stream are dealt to so many buckets.
BUCKETS = 4096


def bucket() -> Column:
    return F.pmod(F.hash("session"), F.lit(BUCKETS)).alias("bucket")


def plain_rows(rows: pd.DataFrame) -> Iterator[tuple]:
    """Rows with None for what is missing."""
    return rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)


def stream_folded(rows: DataFrame, rule: Rule, late: str = "10 minutes", idle_ms: int = 90 * 86_400_000) -> DataFrame:
    """A stream's rows through a rule.

    A micro-batch's rows of a bucket of sessions are sorted and fed together, so it should be
    kept small (files or offsets a trigger); rows that come ``late`` are dropped, and
    the state of a session without rows for ``idle_ms`` of their own time is forgotten.
    """
    struct = T.StructType.fromDDL(rule.schema)
    names, inputs = struct.names, ["session", "stamp_us", "id", *rule.columns]

    def step(key: tuple, found: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.getCurrentWatermarkMs()
        held = {session: (until, state) for session, until, state in (json.loads(kept.get[0]) if kept.exists else [])}
        parts, out = [part for part in found if len(part)], []
        if parts:
            rows = pd.concat(parts).sort_values(["session", "stamp_us", "id"])
            newest = rows.groupby("session")["stamp_us"].max()
            states = {session: held[session][1] for session in newest.index.tolist() if session in held}
            out = fed_together(rule, states, plain_rows(rows[inputs]))
            held |= {session: (max(stamp // 1000, now) + idle_ms, states[session]) for session, stamp in zip(newest.index.tolist(), newest.tolist(), strict=True)}
        held = {session: x for session, x in held.items() if x[0] > now}
        if held:
            kept.update((json.dumps([(session, *x) for session, x in held.items()]),))
            kept.setTimeoutTimestamp(min(until for until, _ in held.values()))
        else:
            kept.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = rows.select(*inputs).withColumn("at", F.timestamp_micros("stamp_us")).withWatermark("at", late)
    return timed.withColumn("bucket", bucket()).groupBy("bucket").applyInPandasWithState(step, struct, "state string", "append", GroupStateTimeout.EventTimeTimeout)
