"""Prefix sums over a sorted table of any size.

Rows are range-partitioned and sorted by the given order; each task sums its own
rows as they stream by, and the totals of the partitions (one row each) give
every partition its start.  No task sees more than its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ship_package
from .blocks import cut, fresh


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with one long column per entry of ``sums`` (name -> SQL expression,
    never null): the sum over all rows before this one in ``order``.

    Rows that tie in ``order`` come in any sequence, so the order should tell
    apart all rows that differ.  Written once to the checkpoint folder.
    """
    ship_package(rows.sparkSession)
    part = fresh([*rows.columns, *sums], "_part")
    own = {n: fresh([*rows.columns, *sums, part], f"_own_{n}") for n in sums}
    wide = rows.select("*", *[F.expr(e).cast("long").alias(own[n]) for n, e in sums.items()])
    names = list(sums)
    more = [*names, part]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema] + [f"`{n}` long" for n in more])

    def run(batches):
        number, at = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for b in batches:
            arrays, cols = list(b.columns), list(b.schema.names)
            for n in names:
                mine = b.column(b.schema.get_field_index(own[n])).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(mine) + at[n]
                arrays.append(pa.array(ends - mine))
                cols.append(n)
                at[n] = int(ends[-1]) if len(ends) else at[n]
            arrays.append(pa.array(np.full(b.num_rows, number, np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, [*cols, part])

    placed = cut(wide.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, fields))
    # One row per partition: the window and the broadcast are bounded by their number.
    ends = placed.groupBy(part).agg(*[F.max(F.col(n) + F.col(own[n])).alias(own[n]) for n in names])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(part, *[F.coalesce(F.sum(own[n]).over(before), F.lit(0)).alias(own[n]) for n in names])
    full = placed.drop(*own.values()).join(F.broadcast(starts), part)
    return full.select(*rows.columns, *[(F.col(n) + F.col(own[n])).alias(n) for n in names])
