"""Exact positions of all rows within groups of any size by one range-partitioned sort.

Each task numbers the sorted rows of its groups and counts the rows of its first and its last group,
the only ones that can go on in another partition. The prefix sums of those counts turn local numbers
into exact positions, so that a large group isn't the task of a single window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewmill.session import written

EXTRA = [
    T.StructField("_part", T.IntegerType()),
    T.StructField("_local", T.LongType()),
    T.StructField("_open", T.BooleanType()),
    T.StructField("_rows", T.LongType()),
]


def _changes(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """True where a row's group differs from the row's before it (the first entry stays False)."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for name in group:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _numbered(batches: Iterable[pa.RecordBatch], group: list[str], n: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Numbers sorted rows within their groups; ends with one row of counts for the first and the last group."""
    part = TaskContext.get().partitionId()
    last, seen, first_group, sample = None, 0, True, None

    def totals(row: pa.RecordBatch, count: int) -> pa.RecordBatch:
        cells = [row.column(name) if name in group else pa.nulls(1, schema.field(name).type) for name in row.schema.names]
        extra = [part, None, True, count]
        cells += [pa.array([x], type=schema.field(f.name).type) for x, f in zip(extra, EXTRA, strict=True)]
        return pa.RecordBatch.from_arrays(cells, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes(batch, group)
        key = tuple(batch.column(g)[0].as_py() for g in group)
        change[0] = last is not None and key != last
        at = np.arange(batch.num_rows)
        starts = np.flatnonzero(change)
        base = np.maximum.accumulate(np.where(change, at, -1))
        local = np.where(base < 0, at + 1 + seen, at - base + 1)
        if first_group and len(starts):  # the first group of the partition ends here
            yield totals(sample if starts[0] == 0 else batch.slice(starts[0] - 1, 1), seen + int(starts[0]))
        is_open = (base < 0) & first_group
        first_group = first_group and not len(starts)
        keep = local <= n if n else np.ones(batch.num_rows, dtype=bool)
        kept = batch.filter(pa.array(keep))
        count = kept.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns,
                pa.array(np.full(count, part), pa.int32()),
                pa.array(local[keep], pa.int64()),
                pa.array(is_open[keep]),
                pa.nulls(count, pa.int64()),
            ],
            schema=schema,
        )
        seen = batch.num_rows - int(starts[-1]) if len(starts) else seen + batch.num_rows
        last = tuple(batch.column(g)[-1].as_py() for g in group)
        sample = batch.slice(batch.num_rows - 1, 1)
    if sample is not None:
        yield totals(sample, seen)


def positions(df: DataFrame, group: list[str], order: list[Column], n: int | None = None, name: str = "item_rank") -> DataFrame:
    """Adds ``name``: the exact position of each row in its group, 1 first; only positions up to ``n``.

    One range shuffle. The numbered rows are written once to the shared folder; what is joined back
    is at most two rows of counts for each partition of the sort, hence the broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [*(F.col(g) for g in group), *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + EXTRA)
    arrow = to_arrow_schema(schema)
    numbered = written(ordered.mapInArrow(lambda it: _numbered(it, group, n, arrow), schema), "positions")
    # The last group of a partition goes on only if the next partition begins with it; there it is open.
    counts = numbered.where("_rows is not null").select(*group, "_part", "_rows")
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.distinct().select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_offset"))
    rows = numbered.where("_rows is null")
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    shifted = rows.join(F.broadcast(offsets), match & F.col("_open"), "left")
    out = shifted.withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0)))
    if n is not None:
        out = out.where(F.col(name) <= n)
    return out.select(*df.columns, name)
