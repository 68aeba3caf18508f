"""Global order without one big task: row numbers and prefix sums of any depth.

Rows are dealt into parts by range of the whole order, so many rows of one first column do not
share a part, and the number of parts follows the number of rows. Each part is added up in its own task; the parts'
totals are a table like any other, whose prefix sums are taken in the same way, level by level, until
few rows are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.session import store

#: Rows of a part, about (ranges are cut by a sample), and rows that one task may order alone.
PART_ROWS = 1 << 17
LAST_ROWS = 1 << 12


def parts_for(df: DataFrame, n: int, part_rows: int = PART_ROWS, last_rows: int = LAST_ROWS) -> int:
    """Number of parts of ``n`` rows: at most ``part_rows`` each, and if there is enough to do, one
    for each of the session's shuffle partitions."""
    spread = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // last_rows))
    return max(1, spread, -(-n // part_rows))


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one if ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Makes, for one part, a function from each of its batches in order to the arrays to add to it, and a
#: function without arguments to the values that stand for the part at its end.
PartWork = Callable[[], tuple[Callable[[pa.RecordBatch], list[pa.Array]], Callable[[], list]]]


def ordered_parts(df: DataFrame, order: list[str], parts: int, added: list[T.StructField], summary: list[T.StructField], work: PartWork, label: str) -> tuple[DataFrame, DataFrame]:
    """Deal ``df`` out by range of ``order``, go through each part in order, and store both what its
    rows and what the part itself gave: (rows with ``part`` and ``added``, parts with ``part`` and ``summary``).

    A part is read as a stream; nothing of it is held.
    """
    part = fresh("part", df)
    row_fields = [*df.schema.fields, T.StructField(part, T.IntegerType()), *added]
    nullable = lambda f: T.StructField(f.name, f.dataType, True)
    closing, place = fresh("closing", df), len(df.columns)
    kept = [T.StructField(fresh(f"_summary{i}", df), f.dataType) for i, f in enumerate(summary)]
    schema = T.StructType([*map(nullable, row_fields), T.StructField(closing, T.BooleanType()), *kept])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        number, (step, end) = TaskContext.get().partitionId(), work()
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen, n = True, batch.num_rows
                blank = [pa.nulls(n, arrow.field(f.name).type) for f in kept]
                columns = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, number, np.int32)), *step(batch), pa.array(np.zeros(n, bool)), *blank], schema=arrow)
        if seen:
            nothing = [pa.nulls(1, arrow.field(f.name).type) for f in row_fields]
            nothing[place] = pa.array([number], pa.int32())
            values = [pa.array([v], arrow.field(f.name).type) for f, v in zip(kept, end(), strict=True)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([True]), *values], schema=arrow)

    stored = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), label)
    rows = stored.where(~F.col(closing)).select(*[f.name for f in row_fields])
    return rows, stored.where(F.col(closing)).select(F.col(part).alias("part"), *[F.col(k.name).alias(f.name) for k, f in zip(kept, summary, strict=True)])


def with_prefix_sum(df: DataFrame, order: list[str], value: Column, name: str = "offset", *, part_rows: int = PART_ROWS, last_rows: int = LAST_ROWS, n: int | None = None) -> DataFrame:
    """Add the exclusive running sum of ``value`` in the global order of ``order`` (nulls first).

    ``order`` must be unique for the result to be determined. Up to ``last_rows`` rows are summed by
    one window; more are dealt into parts of about ``part_rows``, and the parts' totals are summed by the
    same function. So no task orders more than a part, at any number of rows.
    """
    n = df.count() if n is None else n
    if n <= last_rows:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value.cast("bigint")).over(before), F.lit(0).cast("bigint")))
    measure, local, part = fresh("_value", df), fresh("_local", df), fresh("part", df)
    weighed = df.withColumn(measure, F.coalesce(value.cast("bigint"), F.lit(0)))
    at = len(df.columns)

    def work():
        total = 0

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal total
            x = batch.column(at).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(x)
            total = int(ends[-1])
            return [pa.array(ends - x)]

        return step, lambda: [total]

    parts = parts_for(df, n, part_rows, last_rows)
    rows, totals = ordered_parts(weighed, order, parts, [T.StructField(local, T.LongType())], [T.StructField("total", T.LongType())], work, "prefix")
    begin, m = fresh("_begin", df), totals.count()
    starts = with_prefix_sum(totals, ["part"], F.col("total"), begin, part_rows=part_rows, last_rows=last_rows, n=m).select(F.col("part").alias(part), begin)
    joined = rows.join(starts if m > part_rows else F.broadcast(starts), part)  # one row a part
    return joined.withColumn(name, F.col(begin) + F.col(local)).select(*df.columns, name)


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index", **sizes) -> DataFrame:
    """Add the 0-based global row number."""
    return with_prefix_sum(df, order, F.lit(1), name, **sizes)
