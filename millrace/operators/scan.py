"""Segmented scans: running numbers and sums, and neighbouring rows, per group in a given order, after one range shuffle.

A window needs a whole group in one task, and numbering by ranges with windows shuffles twice. Here rows are range-partitioned by
group and order once. Each task scans its sorted range; what a group that crosses ranges had before, and the row just beyond a range, are
known from the first and last row of each range. These two rows per range are all that the driver sees and broadcasts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, StructField, StructType

from millrace.session import shuffle_partitions, stored

# What runs in Python workers travels with the job.
cloudpickle.register_pickle_by_value(sys.modules["millrace"])

FIRST, LAST, HEAD = 1, 2, 4  # first and last row of a range, row of the range's first group


def _differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Where values differ; NULL equals NULL."""
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    return pc.or_(unequal, pc.xor(pc.is_null(left), pc.is_null(right))).to_numpy(zero_copy_only=False)


class _Range:
    """The scan of one sorted range, batch by batch; a batch is handed on when the one after it is known."""

    def __init__(self, keys, number, sums, lead, lag, schema):
        self.keys, self.number, self.sums, self.lead, self.lag, self.schema = keys, number, sums, lead, lag, schema
        self.held, self.seen = None, 0
        self.count, self.totals = 0, dict.fromkeys(sums.values(), 0)
        self.range = TaskContext.get().partitionId()

    def _starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose group is not that of the row before."""
        starts = np.zeros(batch.num_rows, bool)
        for key in self.keys:
            column = batch.column(key)
            starts[1:] |= _differs(column.slice(1), column.slice(0, len(column) - 1))
            if self.held is not None:
                before = self.held[0].column(key)
                starts[0] |= _differs(before.slice(len(before) - 1), column.slice(0, 1))[0]
        if self.held is None:
            starts[0] = True
        return starts

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        starts = self._starts(batch)
        n = batch.num_rows
        group = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # where each row's group starts, -1: before
        made = {}
        if self.number:
            numbers = np.arange(n) - group
            numbers[group < 0] += self.count
            numbers[group >= 0] += 1
            self.count = int(numbers[-1])
            made[self.number] = pa.array(numbers)
        for name, column in self.sums.items():
            values = pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            running = values.cumsum()
            running -= np.where(group >= 0, (running - values)[np.maximum(group, 0)], -self.totals[column])
            made[name] = pa.array(running)
        for name, column in self.sums.items():
            self.totals[column] = made[name][-1].as_py()
        for name, column in self.lag.items():
            values = batch.column(column)
            first = self.held[0].column(column).slice(self.held[0].num_rows - 1) if self.held is not None else pa.nulls(1, values.type)
            made[name] = pc.if_else(pa.array(starts), pa.scalar(None, values.type), pa.concat_arrays([first, values.slice(0, n - 1)]))
        edge = np.where(self.seen + starts.cumsum() <= 1, HEAD, 0).astype(np.int8)
        if self.held is None:
            edge[0] |= FIRST
        self.seen += int(starts.sum())
        out = self._emit(batch, starts)
        self.held = (batch, made, starts, edge)
        return out

    def _emit(self, following: pa.RecordBatch | None, following_starts: np.ndarray | None) -> pa.RecordBatch | None:
        if self.held is None:
            return None
        batch, made, starts, edge = self.held
        n = batch.num_rows
        ends = np.append(starts[1:], True if following is None else following_starts[0])
        for name, column in self.lead.items():
            values = batch.column(column)
            last = pa.nulls(1, values.type) if following is None else following.column(column).slice(0, 1)
            made[name] = pc.if_else(pa.array(ends), pa.scalar(None, values.type), pa.concat_arrays([values.slice(1), last]))
        if following is None:
            edge[-1] |= LAST
        made["_range"], made["_edge"] = pa.array(np.full(n, self.range, np.int32)), pa.array(edge)
        columns = {**{name: batch.column(name) for name in batch.schema.names}, **made}
        return pa.RecordBatch.from_arrays([columns[name] for name in self.schema], names=self.schema)

    def end(self) -> pa.RecordBatch | None:
        return self._emit(None, None)


def scan(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    number: str | None = None,
    sums: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with running columns per group of ``within`` in the order of ``order_by``.

    ``number`` names the 1-based position; ``sums`` maps new names to whole-number columns and gives their sum up to and with the row,
    NULL counting as 0; ``lead`` and ``lag`` map new names to columns of the row after and before, NULL at the ends of a group.
    Rows that are equal in ``order_by`` come in any order. NULL keys form a group; a group may be as large as the table.
    """
    spark = df.sparkSession
    sums, lead, lag, within = dict(sums or {}), dict(lead or {}), dict(lag or {}), list(within)
    kinds = {f.name: f for f in df.schema}
    added = [StructField(c, LongType()) for c in [*([number] if number else []), *sums]]
    added += [StructField(new, kinds[old].dataType) for new, old in [*lead.items(), *lag.items()]]
    schema = StructType([*df.schema, *added]).add("_range", IntegerType()).add("_edge", ByteType())
    names = schema.names

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Range(within, number, sums, lead, lag, names)
        for batch in batches:
            if batch.num_rows:
                done = state.take(batch)
                if done is not None:
                    yield done
        done = state.end()
        if done is not None:
            yield done

    by = [*within, *order_by]
    ranged = df.repartitionByRange(partitions or shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    rows = stored(ranged.mapInArrow(local, schema))
    fixes = _fixes(rows, within, number, sums, lead, lag)
    result = [F.col(c) for c in df.columns]
    if not fixes:
        return rows.select(*result, *(f.name for f in added))
    carried = [number] * bool(number) + list(sums)
    fields = [StructField("_range", schema["_range"].dataType), *(StructField(f"_fix_{f.name}", f.dataType) for f in added)]
    fix = F.broadcast(spark.createDataFrame(fixes, StructType(fields)))
    for f in added:
        own, other = F.col(f.name), F.col(f"_fix_{f.name}")
        if f.name in carried:
            value = F.when(F.col("_edge").bitwiseAND(HEAD) != 0, own + F.coalesce(other, F.lit(0))).otherwise(own)
        else:
            edge = LAST if f.name in lead else FIRST
            value = F.when(F.col("_edge").bitwiseAND(edge) != 0, F.coalesce(own, other)).otherwise(own)
        result.append(value.alias(f.name))
    return rows.join(fix, "_range", "left").select(*result)


def _fixes(rows: DataFrame, within, number, sums, lead, lag) -> list[tuple]:
    """For each range: what its first group had before it, and the rows just outside it. From two rows a range."""
    edges: dict[int, dict] = {}
    for row in rows.filter(F.col("_edge").bitwiseAND(FIRST | LAST) != 0).collect():
        place = edges.setdefault(row["_range"], {})
        if row["_edge"] & FIRST:
            place["first"] = row
        if row["_edge"] & LAST:
            place["last"] = row
    order, carried = sorted(edges), [number] * bool(number) + list(sums)
    found = {r: {} for r in order}
    for before, after in zip(order, order[1:]):
        left, right = edges[before]["last"], edges[after]["first"]
        if any(left[k] != right[k] for k in within):
            continue
        whole = left["_edge"] & HEAD
        for name in carried:
            found[after][name] = left[name] + (found[before].get(name, 0) if whole else 0)
        found[after] |= {new: left[old] for new, old in lag.items()}
        found[before] |= {new: right[old] for new, old in lead.items()}
    names = [*carried, *lead, *lag]
    return [(r, *(values.get(n) for n in names)) for r, values in found.items() if values]
