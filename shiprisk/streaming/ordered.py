"""Event-time ordered keyed streams.

Rows of a key may arrive out of order, in any number of micro-batches and
Arrow chunks. ``in_time_order`` keeps them in keyed state until the watermark
has passed them, then hands them to a step function, sorted by (event time,
tie), once and in order, whatever the files, batches and chunk sizes were. A
timer on the watermark releases the rows of keys that get no more input, and
drops the state of keys that have been idle. State holds the rows of the last
``delay`` and one small record for each key. Keys are dealt to ``PARTS`` parts
by hash, and each call reads and writes the state of one part in bulk: calls
and state requests in a batch are bounded by the parts, not by the keys.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The process that sets up a stream's state on the driver does not see shipped packages: what is in here travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of the keys. A stream's checkpoint depends on it.
PARTS = 256


@dataclass(frozen=True)
class Step:
    """``run(memory, rows)``: memory is a tuple of ``memory_schema`` or None, rows are (micros, tie, *values) in order;
    returns (memory, output tuples without the key). Memory is dropped ``keep_us`` after the key's last row. ``at_time(memory,
    micros)``, if given, is asked once the watermark has reached a time; it returns (memory, outputs, when to ask again or None)."""
    memory_schema: str
    output: T.StructType
    run: Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]]
    keep_us: int
    at_time: Callable[[tuple, int], tuple[tuple, list[tuple], int | None]] | None = None


class _InOrder(StatefulProcessor):
    """One call serves a part of the keys: their waiting rows and memories are two lists, read and written whole."""

    def __init__(self, step: Step, keys: list[str], key_types: list[str], values: list[str], value_types: list[str], out: T.StructType):
        self.step, self.keys, self.key_types, self.values, self.value_types, self.out = step, keys, key_types, values, value_types, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        of = [f"k{i} {t}" for i, t in enumerate(self.key_types)]
        columns = [*of, "us long", "tie long", *(f"{v} {t}" for v, t in zip(self.values, self.value_types))]
        self.waiting = handle.getListState("waiting", ", ".join(columns))
        self.memory = handle.getListState("memory", ", ".join([*of, "last_us long", self.step.memory_schema]))

    def _advance(self, waiting: list[tuple], watermark_ms: int) -> list[tuple]:
        """Rows behind the watermark go to the step, key by key; what still waits is stored, and a timer set for the next thing to do.
        Rows are (keys..., micros, tie, values...)."""
        bound, width = watermark_ms * 1000, len(self.keys)
        ready: dict[tuple, list[tuple]] = {}
        for r in sorted((r for r in waiting if r[width] <= bound), key=lambda r: r[width:width + 2]):
            ready.setdefault(r[:width], []).append(r[width:])
        rest = [r for r in waiting if r[width] > bound]
        known = {tuple(m[:width]): tuple(m[width:]) for m in self.memory.get()} if self.memory.exists() else {}
        had, out, due = bool(known), [], []
        for key, rows in ready.items():
            memory, made = self.step.run(known[key][1:] if key in known else None, rows)
            known[key] = (rows[-1][0], *memory)
            out += [(*key, *o) for o in made]
        if self.step.at_time:
            for key, (last, *memory) in known.items():
                memory, made, again = self.step.at_time(tuple(memory), bound)
                known[key] = (last, *memory)
                out += [(*key, *o) for o in made]
                due += [again] if again is not None else []
        known = {key: m for key, m in known.items() if m[0] + self.step.keep_us > bound}
        for state, rows, before in ((self.memory, [(*key, *m) for key, m in known.items()], had), (self.waiting, rest, True)):
            if rows:
                state.put(rows)
            elif before and state.exists():
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due += [min(r[width] for r in rest)] if rest else []
        due += [min(m[0] for m in known.values()) + self.step.keep_us] if known else []
        if due:  # strictly after the watermark, or it would never fire
            self.handle.registerTimer(max(-(-min(due) // 1000), watermark_ms + 1))
        return out

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.out.names)
        for f in self.out.fields:
            if isinstance(f.dataType, T.TimestampType):
                frame[f.name] = pd.to_datetime(frame[f.name], unit="us", utc=True)
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        for pdf in rows:
            waiting += zip(*(pdf[k].tolist() for k in self.keys), pdf["us"].tolist(), pdf["tie"].tolist(), *(pdf[v].where(pdf[v].notna(), None).tolist() for v in self.values))
        out = self._advance(waiting, timerValues.getCurrentWatermarkInMs())
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        out = self._advance(waiting, timerValues.getCurrentWatermarkInMs())
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def in_time_order(events: DataFrame, keys: list[str], ts: str, tie: str, values: list[str], step: Step, delay: str) -> DataFrame:
    """The step's outputs for each key, with the key's columns first. ``ts`` is a timestamp, ``tie`` a whole number; rows with a null
    key, time or tie have no place in an order and are left out. Values may be null."""
    rows = events.where(" and ".join(f"`{c}` is not null" for c in [*keys, ts, tie])).withWatermark(ts, delay)
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField(k, types[k]) for k in keys] + step.output.fields)
    sent = rows.select(*keys, ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), *values)
    processor = _InOrder(step, keys, [types[k].simpleString() for k in keys], values, [types[v].simpleString() for v in values], out)
    return sent.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS))).groupBy("_part").transformWithStateInPandas(processor, out, "Append", "EventTime")


def stationary_step(min_us: int, keep_us: int, on_silence: bool = False) -> Step:
    """One alert a run, at the ping that crosses ``min_us`` in the same cell; ``on_silence`` also where no ping has come by then.
    Values: the cell."""
    def run(memory, rows):
        cell, start, alerted = memory or (None, None, False)
        out = []
        for us, _, here in rows:
            if start is None or here != cell:
                cell, start, alerted = here, us, False
            elif not alerted and us - start >= min_us:
                alerted = True
                out.append((cell, start, us, us // 1_000_000 - start // 1_000_000))
        return (cell, start, alerted), out

    def silent(memory, now):
        cell, start, alerted = memory
        if alerted or start + min_us > now:
            return memory, [], None if alerted else start + min_us
        return (cell, start, True), [(cell, start, start + min_us, (start + min_us) // 1_000_000 - start // 1_000_000)], None

    output = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("start_ts", T.TimestampType()),
                           T.StructField("alert_ts", T.TimestampType()), T.StructField("stationary_seconds", T.LongType())])
    return Step("cell string, start_us long, alerted boolean", output, run, keep_us, silent if on_silence else None)


def reuse_step(ttl_us: int) -> Step:
    """Whether the key's last request came at most ``ttl_us`` earlier; the validity time is also when memory goes. Values: none."""
    def run(memory, rows):
        last, out = memory[0] if memory else None, []
        for us, tie in rows:
            out.append((tie, us, last is not None and us - last <= ttl_us))
            last = us
        return (last,), out

    output = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("cache_hit", T.BooleanType())])
    return Step("us long", output, run, ttl_us + 1)
