"""Streams with state of their own: running counts and earlier values of each key, and op ids with a memory that ends.

They use ``transformWithStateInPandas``, so they need the RocksDB state store
(``run_to_table(..., rocksdb=True)``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Names that begin with an underscore do not reach the processor.
_AT = "sample_at_us"


class _Running(StatefulProcessor):
    """Per key: how often each condition has held, the last sample's values, and the last ``history`` of them."""

    def __init__(self, counts: list[str], previous: list[str], kept: str, history: int):
        self.counts, self.previous, self.kept, self.history = counts, previous, kept, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "at long, samples long, counts array<long>")
        self.last = handle.getValueState("last", self.kept) if self.previous else None
        self.recent = handle.getListState("recent", "at long") if self.history else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(_AT, kind="stable", ignore_index=True)
        at, samples, counts = self.so_far.get() if self.so_far.exists() else (None, 0, [0] * len(self.counts))
        fresh = pd.Series(True, batch.index) if at is None else batch[_AT] > at
        late, batch = batch[~fresh].copy(), batch[fresh].reset_index(drop=True)
        late["late"] = True
        out = batch.copy()
        out["late"] = False
        out["samples"] = samples + 1 + batch.index.to_numpy()
        for c, n in zip(self.counts, counts, strict=True):
            out[f"{c}_so_far"] = n + batch[c].astype("int64").cumsum()
        for c in self.previous:
            out[f"previous_{c}"] = batch[c].shift(1)
        if len(batch):
            if self.previous:
                if self.last.exists():
                    out.loc[0, [f"previous_{c}" for c in self.previous]] = list(self.last.get())
                self.last.update(tuple(batch[c].iloc[-1].item() for c in self.previous))
            if self.history:
                kept = [r[0] for r in self.recent.get()] if self.recent.exists() else []
                kept = (kept + batch[_AT].tolist())[-self.history :]
                self.recent.put([(int(x),) for x in kept])
            self.so_far.update((int(batch[_AT].iloc[-1]), int(samples + len(batch)), [int(out[f"{c}_so_far"].iloc[-1]) for c in self.counts]))
        if self.history:
            held = [r[0] for r in self.recent.get()] if self.recent.exists() else []
            out["span_us"] = held[-1] - held[0] if held else 0
        yield out
        if len(late):
            yield late.reindex(columns=out.columns)

    def close(self) -> None:
        pass


def running(stream: DataFrame, by: list[str], at: str, conditions: dict[str, Column], previous: tuple[str, ...] = (), history: int = 0) -> DataFrame:
    """Each sample with how often each condition has held so far (``<name>_so_far``), ``samples`` and the sample before (``previous_<column>``, numbers).

    The streaming twin of the segmented scans.  Samples of a key go by ``at``: a
    micro-batch is put in order, and a sample that is not newer than the key's last
    one is ``late``: it is returned, with nulls, and changes nothing.  A key's rows of
    one micro-batch are in one task.  ``history`` keeps so many last times of a key;
    ``span_us`` is what they span after the batch.
    """
    named = [f"held_{c}" for c in conditions]
    rows = stream.withColumn(_AT, F.unix_micros(F.col(at).cast("timestamp")))
    for name, c in zip(named, conditions.values(), strict=True):
        rows = rows.withColumn(name, F.coalesce(c, F.lit(False)))
    for c in previous:
        rows = rows.withColumn(c, F.col(c).cast("double"))
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema] + [T.StructField("late", T.BooleanType()), T.StructField("samples", T.LongType())]
    fields += [T.StructField(f"{n}_so_far", T.LongType()) for n in named] + [T.StructField(f"previous_{c}", T.DoubleType()) for c in previous]
    fields += [T.StructField("span_us", T.LongType())] if history else []
    processor = _Running(named, list(previous), ", ".join(f"{c} double" for c in previous), history)
    out = rows.groupBy(*by).transformWithStateInPandas(processor, T.StructType(fields), "Append", "None")
    for name, c in zip(named, conditions, strict=True):
        out = out.withColumnRenamed(f"{name}_so_far", f"{c}_so_far").withColumnRenamed(name, f"{c}_held")
    return out.drop(_AT)


class _FirstOfOp(StatefulProcessor):
    """One op id: the seq that its first record had, until its memory ends."""

    def __init__(self, columns: list[str], seq: str, at: str, keep_ms: int):
        self.columns, self.seq, self.at, self.keep_ms = columns, seq, at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "seq long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.seq, kind="stable", ignore_index=True)
        known = self.first.exists()
        if not known:
            self.first.update((int(batch[self.seq].iloc[0]),))
            self.handle.registerTimer(int(batch[self.at].iloc[0].timestamp() * 1000) + self.keep_ms)
        kind = "repeated" if known else "first"
        n = self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0
        self.kinds.updateValue((kind,), (n + len(batch),))
        batch["effective_seq"] = self.first.get()[0]
        batch["is_first"] = [not known and i == 0 for i in range(len(batch))]
        yield batch[[*self.columns, "effective_seq", "is_first"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.kinds.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_of_op(stream: DataFrame, op: str, seq: str, at: str, keep_seconds: int, late: str = "0 seconds") -> DataFrame:
    """All records with ``effective_seq`` (what the first of their op id had) and ``is_first``; an id is forgotten once the watermark is ``keep_seconds`` past its first record.

    Unlike deduplication within a watermark repeats are returned, with the seq that they stand for.
    """
    rows = stream.withWatermark(at, late)
    fields = [T.StructField(f.name, f.dataType, True) for f in stream.schema] + [T.StructField("effective_seq", T.LongType()), T.StructField("is_first", T.BooleanType())]
    return rows.groupBy(op).transformWithStateInPandas(_FirstOfOp(stream.columns, seq, at, 1000 * keep_seconds), T.StructType(fields), "Append", "EventTime")
