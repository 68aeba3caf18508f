"""Data-parallel gradients: sums of rows in tasks, added up in a tree of bounded fan-in.

A task sends on the sums over its rows, each tensor cut into slices. Slices of one place are
added up ``FAN_IN`` at a time, level by level, so no group ever holds more than ``FAN_IN`` parts
of ``SLICE`` values, whatever the number of tasks or the size of a tensor; after ceil(log(tasks) /
log(FAN_IN)) levels one part of each slice is left, and what comes to the driver is one model. Parts are
added in the order of the tasks, so a sum does not depend on when they arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.schedule import ModelConfig
from lexispark.model.transformer import Params, loss_sums

#: Parts that one group of the tree adds up, and float64 values of a slice of a tensor.
FAN_IN = 16
SLICE = 1 << 16
#: Rows that a step sees at once, and bytes of one feature of the positions that a model sees at once (a row at
#: least): what it keeps of them stays in a core's cache.
ROWS_AT_A_TIME = 8
POSITIONS_BYTES = 8192
#: Bytes that glibc's allocator keeps, once a task has freed as many, instead of giving each step's pages back.
KEPT = 16 << 20

_PARTS = "name string, slice int, part int, data binary"
_ARROW = pa.schema([("name", pa.string()), ("slice", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])

#: From parameters and columns of rows to (sum of losses, their number, gradients of the sum).
Sums = Callable[[Params, dict[str, pa.Array]], tuple[float, float, Params]]


def sliced(name: str, values: np.ndarray, part: int, size: int = SLICE) -> Iterator[dict]:
    """The rows that stand for one tensor of one task."""
    flat = np.ascontiguousarray(values, dtype="<f8").ravel()
    for i in range(-(-len(flat) // size)):
        yield {"name": name, "slice": i, "part": part, "data": flat[i * size : (i + 1) * size].tobytes()}


def levels(tasks: int, fan_in: int = FAN_IN) -> int:
    """Levels of the tree until one part is left."""
    n = 0
    while tasks > 1:
        tasks, n = -(-tasks // fan_in), n + 1
    return n


def tree_sum(parts: DataFrame, tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Sums by (name, slice) of parts numbered below ``tasks``."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        name, at, group = (k.as_py() for k in key)
        if table.num_rows > fan_in:
            raise AssertionError(f"{table.num_rows} parts of {name} in one group; {fan_in} are allowed")
        total = None
        for _, data in sorted(zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True)):
            value = np.frombuffer(data, "<f8")
            total = value.copy() if total is None else total + value
        return pa.Table.from_pylist([{"name": name, "slice": at, "part": group, "data": total.tobytes()}], schema=_ARROW)

    for _ in range(levels(tasks, fan_in)):
        parts = parts.withColumn("group", F.expr(f"part div {fan_in}").cast("int")).groupBy("name", "slice", "group").applyInArrow(add, _PARTS)
    return parts


def gradient_sums(rows: DataFrame, params: Params, sums: Sums, *, tasks: int | None = None, dealt: int | None = None, fan_in: int = FAN_IN, size: int = SLICE, at_a_time: int = ROWS_AT_A_TIME) -> tuple[float, float, Params]:
    """(sum of losses, their number, gradients of the sum) over all rows, ``at_a_time`` of them at once.

    Rows are dealt evenly to ``tasks`` tasks, by default as many as the cluster runs at a time; those that lie in
    ``dealt`` partitions already stay there. If it turns out that they lie in more, a few parts are left for the driver.
    """
    spark = rows.sparkSession
    tasks = dealt or tasks or spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast(params)
    names = rows.columns

    def run(batches):
        part, total, found = TaskContext.get().partitionId(), np.zeros(2), None
        np.empty(KEPT, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, at_a_time):
                columns = {n: batch.column(i).slice(at, at_a_time) for i, n in enumerate(names)}
                loss, n, grads = sums(shared.value, columns)
                total += (loss, n)
                if found is None:
                    found = {k: g.astype(float) for k, g in grads.items()}
                else:
                    for k, g in grads.items():
                        found[k] += g
        if found is not None:
            for name, values in [("_loss", total), *found.items()]:
                for row in sliced(name, values, part, size):
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    try:
        parts = tree_sum((rows if dealt else rows.repartition(tasks)).mapInArrow(run, _PARTS), tasks, fan_in).collect()
    finally:
        shared.destroy()
    if not parts:
        raise ValueError("no rows to train on")
    pieces: dict[str, dict[int, np.ndarray]] = {}
    for r in sorted(parts, key=lambda r: (r["name"], r["slice"], r["part"])):
        found, value = pieces.setdefault(r["name"], {}), np.frombuffer(bytes(r["data"]), "<f8")
        found[r["slice"]] = found[r["slice"]] + value if r["slice"] in found else value
    flat = {k: np.concatenate(list(v.values())) for k, v in pieces.items()}
    loss, n = flat.pop("_loss")
    return float(loss), float(n), {k: flat[k].reshape(v.shape) for k, v in params.items() if k in flat}


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix, plain values as a vector."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(column)
    if (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("rows of different lengths")
    return flat.reshape(len(column), width)


def model_sums(c: ModelConfig) -> Sums:
    """Cross-entropy sums of rows of inputs, targets and optionally mask, segments and weight."""

    def sums(params: Params, rows: dict[str, pa.Array]) -> tuple[float, float, Params]:
        part = {n: matrix(v) for n, v in rows.items()}
        return loss_sums(params, c, part["inputs"], part["targets"], part.get("mask"), part.get("segments"), weights=part.get("weight"))

    return sums


def distributed_gradients(rows: DataFrame, params: Params, c: ModelConfig, *, tasks: int | None = None, dealt: int | None = None, fan_in: int = FAN_IN, size: int = SLICE) -> tuple[float, Params]:
    """Mean loss and gradients over rows of inputs, targets and optionally mask and segments; with a
    column ``weight`` the weighted sums instead. Passes run in the precision of the parameters, sums over steps and
    tasks are double."""
    names = [n for n in ("inputs", "targets", "mask", "segments", "weight") if n in rows.columns]
    total, count, grads = gradient_sums(rows.select(*names), params, model_sums(c), tasks=tasks, dealt=dealt, fan_in=fan_in, size=size, at_a_time=max(1, POSITIONS_BYTES // params["embed"].itemsize // c.context))
    n = 1.0 if "weight" in names else max(1.0, count)
    return total / n, {k: g / n for k, g in grads.items()}
