"""Sequential next-fit in parallel: exact placement by composed transitions.

Next-fit puts each item behind the one before, or opens a row where it no longer fits, so a
place depends on all items before it. But what a stretch of items does to the state depends on one number, the
fill of the open row that it starts with: it decides at which item the stretch first opens a row, and from
there on everything is settled. So a stretch is a step function of the entry fill, of at most as many steps as a row has
items; two neighbouring stretches compose to such a function again, with no more steps than a row has
places. That gives a prefix scan:

1. items are dealt into parts by range of their order; each part yields its function as a stream;
2. functions are composed ``FAN_IN`` at a time, level by level;
3. downwards, each group hands its members the state they start with;
4. each part places its items from there.

No task reads more than a part of the lengths or ``FAN_IN`` functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators.order import LAST_ROWS, PART_ROWS, ordered_parts, parts_for

#: Functions that one task composes.
FAN_IN = 64
#: Columns of a function's steps, sorted by ``LOW``, the least entry fill of a step. Where a row is opened
#: (``OPENED``), ``FILL`` and ``ITEMS`` of the open row do not depend on the entry; else they are added to it.
LOW, OPENED, FILL, ROWS, ITEMS = range(5)
#: A state: fill and number of the open row, items in it.
START = (0, 0, 0)


def _jumps(sums: np.ndarray, capacity: int) -> np.ndarray:
    """For a row that begins at each item the item that begins the next one (their number: none)."""
    return np.searchsorted(sums, sums[:-1] + capacity, "right") - 1


def steps_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The function of a stretch of items, each of at most ``capacity``."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    jump = _jumps(sums, capacity)
    deepest = int(np.searchsorted(sums, capacity, "right")) - 1  # the first row ends here if it was empty
    first = np.arange(min(deepest, n - 1), -1, -1)
    first = first[sizes[first] > 0]
    last, rows = first.copy(), np.ones(len(first), dtype=np.int64)
    while len(last):
        onward = jump[last] < n
        if not onward.any():
            break
        last[onward] = jump[last[onward]]
        rows += onward
    steps = np.stack([np.maximum(0, capacity - sums[first + 1] + 1), np.ones_like(first), sums[n] - sums[last], rows, n - last], axis=1)
    if sums[n] <= capacity:  # all fit
        steps = np.concatenate([[[0, 0, sums[n], 0, n]], steps])
    return _tidy(steps)


def _tidy(steps: np.ndarray) -> np.ndarray:
    """Steps without empty ones and without neighbours that are the same."""
    low = steps[:, LOW]
    steps = steps[np.append(low[1:] > low[:-1], True)]
    new = np.append(True, (steps[1:, 1:] != steps[:-1, 1:]).any(axis=1))
    return steps[new]


def _at(steps: np.ndarray, fill) -> np.ndarray:
    return np.searchsorted(steps[:, LOW], fill, "right") - 1


def composed(one: np.ndarray, other: np.ndarray, capacity: int) -> np.ndarray:
    """First ``one``, then ``other``."""
    out = []
    highs = np.append(one[1:, LOW] - 1, capacity)
    for (low, opened, fill, rows, items), high in zip(one.tolist(), highs.tolist(), strict=True):
        if opened:
            reached = other[_at(other, fill)].tolist()
            out.append([low, 1, reached[FILL] + (0 if reached[OPENED] else fill), rows + reached[ROWS], reached[ITEMS] + (0 if reached[OPENED] else items)])
            continue
        for step in other[_at(other, low + fill) : _at(other, high + fill) + 1].tolist():
            at = max(low, step[LOW] - fill)
            out.append([at, 1, *step[FILL:]] if step[OPENED] else [at, 0, fill + step[FILL], rows, items + step[ITEMS]])
    return _tidy(np.array(out, dtype=np.int64))


def applied(steps: np.ndarray, state: tuple[int, int, int]) -> tuple[int, int, int]:
    """The state (fill, row, items) behind a stretch."""
    fill, row, items = state
    step = steps[_at(steps, fill)].tolist()
    if step[OPENED]:
        return step[FILL], row + step[ROWS], step[ITEMS]
    return fill + step[FILL], row, items + step[ITEMS]


def placed(sizes: np.ndarray, state: tuple[int, int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Row, start and segment of each item of a stretch, and the state behind it."""
    fill, row, items = state
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    jump = _jumps(sums, capacity)
    heads, at = [], int(np.searchsorted(sums, capacity - fill, "right")) - 1
    while at < n:
        heads.append(at)
        at = int(jump[at])
    number = np.searchsorted(heads, np.arange(n), "right") if heads else np.zeros(n, dtype=np.int64)
    begin = np.array([0, *heads])[number]
    open_row = number == 0
    starts = sums[:-1] - sums[begin] + np.where(open_row, fill, 0)
    segments = np.arange(n) - begin + np.where(open_row, items, 0)
    end = (int(sums[n] - sums[heads[-1]]), row + len(heads), n - heads[-1]) if heads else (fill + int(sums[n]), row, items + n)
    return row + number, starts, segments, end


def _packed(steps: np.ndarray) -> bytes:
    return np.ascontiguousarray(steps, dtype="<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(-1, 5)


_STATES = "part int, fill int, row bigint, items bigint"


def entry_states(functions: DataFrame, parts: int, capacity: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, fill, row, items): the state with which each part starts, from (part, steps) of all."""

    def group(table: DataFrame) -> DataFrame:
        return table.withColumn("group", F.expr(f"part div {fan_in}").cast("int"))

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for steps in table.sort_by("part")["steps"].to_pylist():
            total = _unpacked(steps) if total is None else composed(total, _unpacked(steps), capacity)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "steps": pa.array([_packed(total)], pa.binary())})

    def hand_on(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, out = tuple(table[c][0].as_py() for c in ("fill", "row", "items")), []
        for part, steps in zip(table["part"].to_pylist(), table["steps"].to_pylist(), strict=True):
            out.append((part, *state))
            state = applied(_unpacked(steps), state)
        columns = zip(*out, strict=True)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("part", pa.int32()), ("fill", pa.int32()), ("row", pa.int64()), ("items", pa.int64())), columns, strict=True)})

    levels = [functions]
    while parts > fan_in:
        levels.append(group(levels[-1]).groupBy("group").applyInArrow(compose, "part int, steps binary"))
        parts = -(-parts // fan_in)
    states = functions.sparkSession.createDataFrame([(0, *START)], _STATES)
    for level in reversed(levels):
        above = states.withColumnRenamed("part", "group")
        states = group(level).join(above, "group").groupBy("group").applyInArrow(hand_on, _STATES)
    return states


def next_fit(lengths: DataFrame, capacity: int, *, key: str, length: str, part_rows: int = PART_ROWS, last_rows: int = LAST_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Next-fit of ``lengths`` in key order: (key, n, row, start, segment); n is at most the capacity."""
    items = lengths.select(key, F.least(F.col(length), F.lit(capacity)).cast("int").alias("n"))
    parts = parts_for(items, items.count(), part_rows, last_rows)

    def work():
        total = None

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal total
            own = steps_of(batch.column(1).to_numpy().astype(np.int64), capacity)
            total = own if total is None else composed(total, own, capacity)
            return []

        return step, lambda: [_packed(total)]

    rows, functions = ordered_parts(items, [key, "n"], parts, [], [T.StructField("steps", T.BinaryType())], work, "next-fit")
    # a partition count that the session raised shows in the numbers
    most = (functions.agg(F.max("part")).first()[0] or 0) + 1
    states = entry_states(functions, most, capacity, fan_in)
    part = rows.columns[-1]

    def place(batches):
        current, state = None, START
        for batch in batches:
            numbers = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if own.column(2)[0].as_py() != current:
                    current, state = own.column(2)[0].as_py(), tuple(own.column(i)[0].as_py() for i in (3, 4, 5))
                row, start, segment, state = placed(own.column(1).to_numpy().astype(np.int64), state, capacity)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(row, pa.int64()), pa.array(start.astype(np.int32)), pa.array(segment.astype(np.int32))], names=[key, "n", "row", "start", "segment"]
                )

    kind = dict(lengths.dtypes)[key]
    met = rows.select(key, "n", F.col(part).alias("part")).join(states if most > part_rows else F.broadcast(states), "part")  # one state a part
    in_order = met.repartition(parts, "part").sortWithinPartitions("part", key, "n").select(key, "n", "part", "fill", F.col("row").alias("first"), "items")
    return in_order.mapInArrow(place, f"`{key}` {kind}, n int, row bigint, start int, segment int")
