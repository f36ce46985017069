"""Keyed state in buckets of keys.

Spark calls a pandas state function once per group and micro-batch, and each
call costs milliseconds (a frame and a state row of its own) however few rows
the group has. With one group per key that cost grows with the number of keys.
Here a group is a bucket of keys by hash: its rows are sorted once, the step of
every key runs over plain rows, and one state row holds the keys that are live.

A step sees the state of its own key only, with the calls of ``GroupState``;
timeouts are kept per key and fire as Spark's do (a key without rows in a batch
whose deadline is before the watermark).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

#: Groups per micro-batch at most. A running checkpoint keeps the number it began with.
BUCKETS = 1024


@dataclass(frozen=True)
class Keyed:
    """``step(key, rows, state)`` returns the output rows (tuples of ``out``) for the
    rows of one key in a micro-batch: tuples of ``columns``, sorted by ``order``."""

    step: Callable[[int, Iterable[tuple], KeyState], list[tuple]]
    key: str
    order: str
    columns: tuple[str, ...]
    out: T.StructType
    state: T.StructType


class KeyState:
    """The state of one key in a bucket."""

    def __init__(self, value: tuple | None, watermark_ms: int, timed_out: bool = False):
        self.get, self.hasTimedOut, self.deadline, self._watermark_ms = value, timed_out, None, watermark_ms

    @property
    def exists(self) -> bool:
        return self.get is not None

    def update(self, value: tuple) -> None:
        self.get = value

    def remove(self) -> None:
        self.get = self.deadline = None

    def setTimeoutTimestamp(self, ms: int) -> None:
        self.deadline = ms

    def getCurrentWatermarkMs(self) -> int:
        return self._watermark_ms


def _column(values: tuple, kind: T.DataType):
    """A pandas column; whole numbers and booleans keep their type beside nulls."""
    import pandas as pd
    import pyarrow as pa

    name = kind.simpleString()
    if name not in ("bigint", "int", "boolean"):
        return pd.Series(values, dtype=object)
    found = pa.array(values, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[name])
    mask = found.is_null().to_numpy(zero_copy_only=False)
    plain = found.fill_null(False if name == "boolean" else 0).to_numpy(zero_copy_only=False)
    return pd.Series((pd.arrays.BooleanArray if name == "boolean" else pd.arrays.IntegerArray)(plain.copy(), mask.copy()))


def _frame(rows: list[tuple], out: T.StructType):
    import pandas as pd

    return pd.DataFrame({f.name: _column(c, f.dataType) for f, c in zip(out.fields, zip(*rows))})


def per_key(k: Keyed) -> Callable:
    """The step as a state function whose groups are single keys."""
    def fn(key, pdfs, state):
        import pandas as pd

        rows = () if state.hasTimedOut else pd.concat(list(pdfs)).sort_values(k.order)[list(k.columns)].itertuples(index=False, name=None)
        if out := k.step(int(key[0]), rows, state):
            yield _frame(out, k.out)
    return fn


def _runs(pdf, k: Keyed) -> Iterator[tuple[int, Iterable[tuple]]]:
    """The rows of every key in order."""
    import numpy as np

    keys = pdf[k.key].to_numpy()
    order = np.lexsort((pdf[k.order].to_numpy(), keys))
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
    columns = [pdf[c].to_numpy()[order].tolist() for c in k.columns]
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        yield int(keys[a]), zip(*(c[a:b] for c in columns))


def per_bucket(k: Keyed) -> Callable:
    """The step as a state function whose groups are buckets of keys."""
    def fn(key, pdfs, state):
        import pandas as pd

        watermark, held, live, out = state.getCurrentWatermarkMs(), {}, [], []
        if state.exists:
            ids, deadlines, *values = state.get
            held = dict(zip(ids, zip(deadlines, zip(*values))))

        def call(i: int, rows: Iterable[tuple], s: KeyState) -> None:
            out.extend(k.step(i, rows, s))
            if s.exists:
                live.append((i, s.deadline, *s.get))

        if not state.hasTimedOut:
            for i, rows in _runs(pd.concat(list(pdfs)), k):
                call(i, rows, KeyState(held.pop(i, (None, None))[1], watermark))
        for i, (deadline, value) in held.items():
            if deadline is not None and deadline < watermark:
                call(i, (), KeyState(value, watermark, timed_out=True))
            else:
                live.append((i, deadline, *value))
        if live:
            columns = [list(c) for c in zip(*live)]
            state.update(tuple(columns))
            if deadlines := [d for d in columns[1] if d is not None]:
                state.setTimeoutTimestamp(min(deadlines))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(out, k.out)
    return fn


def stateful(stream: DataFrame, k: Keyed, buckets: int = BUCKETS) -> DataFrame:
    """The step over a stream with a watermark, its state kept by key with event-time timeouts."""
    schema = T.StructType([T.StructField("key", T.ArrayType(T.LongType())), T.StructField("deadline_ms", T.ArrayType(T.LongType())),
                           *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in k.state.fields]])
    rows = stream.withColumn("bucket", F.pmod(F.xxhash64(k.key), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(per_bucket(k), k.out, schema, "append", GroupStateTimeout.EventTimeTimeout)
