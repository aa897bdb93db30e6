"""Places of rows within their groups, whatever the size of a group."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from nearwise.session import materialize

#: Rows that one range of the order holds, about.
ROWS_PER_RANGE = 250_000


def ranges(rows: DataFrame) -> int:
    """Into how many partitions to deal a stored table: by its rows, and not less than the session asks for."""
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(few, math.ceil(rows.count() / ROWS_PER_RANGE))


def rank_in_groups(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with the 0-based place of each row among those of its group, nulls first; ``rows`` is a stored table.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks. Each task counts along its
    sorted rows. Only the first group of a range can have begun in an earlier one; what came before is added to it from a
    table of two rows for each range, which is broadcast. ``order`` must end in a column that tells all rows of a group
    apart, so that a repeated task deals out the same places. Null groups are groups.
    """
    keys = [*group, *order]
    dealt = rows.repartitionByRange(ranges(rows), *keys).sortWithinPartitions(*keys)
    fields = [*rows.schema.fields, *T.StructType.fromDDL("range_no int, range_row long, range_place long").fields]
    at = [rows.columns.index(column) for column in group]
    numbered = materialize(dealt.mapInArrow(lambda batches: _number(batches, at), T.StructType(fields)), "ranks")

    first = [F.min_by(column, "range_row").alias(column) for column in group]
    last = [F.max_by(column, "range_row").alias(column) for column in group]
    by_range = numbered.groupBy("range_no")
    enters = by_range.agg(*first, F.lit(0).alias("leaves"), F.lit(0).cast("long").alias("n"))
    leaves = by_range.agg(*last, F.lit(1).alias("leaves"), (F.max_by("range_place", "range_row") + 1).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("range_no", "leaves").rowsBetween(Window.unboundedPreceding, -1)
    before = enters.union(leaves).withColumn("range_before", F.sum("n").over(earlier)).where("leaves = 0 AND range_before > 0")
    before = before.select(F.col("range_no").alias("before_no"), *(F.col(c).alias(f"before_{c}") for c in group), "range_before")
    same = F.col("range_no") == F.col("before_no")
    for column in group:
        same &= F.col(column).eqNullSafe(F.col(f"before_{column}"))
    placed = numbered.join(F.broadcast(before), same, "left")  # at most one row for each range
    return placed.select(*rows.columns, (F.col("range_place") + F.coalesce("range_before", F.lit(0))).alias(name))


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether any of the columns differs from the row before; nulls are equal."""
    found = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        here, there = column.slice(1), column.slice(0, len(column) - 1)
        found |= pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
        found |= here.is_null().to_numpy(zero_copy_only=False) != there.is_null().to_numpy(zero_copy_only=False)
    return found


def _number(batches: Iterator[pa.RecordBatch], group: list[int]) -> Iterator[pa.RecordBatch]:
    number, seen, run, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i) for i in group]
        begins = np.concatenate([[not seen or [c[0].as_py() for c in columns] != last], changes(columns)])
        rows = np.arange(n)
        start = np.maximum.accumulate(np.where(begins, rows, -1))
        place = np.where(start >= 0, rows - start, rows + run)
        run, last = int(place[-1]) + 1, [c[n - 1].as_py() for c in columns]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, number, np.int32)), pa.array(rows + seen), pa.array(place)],
            [*batch.schema.names, "range_no", "range_row", "range_place"],
        )
        seen += n


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted batches cut anew so that rows with equal first ``keys`` columns stay together, with the bounds of such runs."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        starts = [0, *(1 + np.flatnonzero(changes(batch.columns[:keys]))).tolist()]
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        rest = batch.slice(starts[-1])
    if rest is not None:
        yield rest, [0, rest.num_rows]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
