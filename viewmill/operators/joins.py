"""Joins with audits, conflict rules, tolerances and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewmill.operators.positions import positions
from viewmill.session import written


def override_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a non-null value of the right side replaces the left one of the same name."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.select(*keys, *(F.col(c).alias(f"_r_{c}") if c in both else F.col(c) for c in right.columns if c not in keys))
    joined = left.join(renamed, keys, how)
    return joined.withColumns({c: F.coalesce(f"_r_{c}", c) for c in both}).drop(*(f"_r_{c}" for c in both))


def audit_join(left: DataFrame, right: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Left join with ``status``: matched, missing_row, or missing_<first required column that is null>."""
    marked = right.withColumn("_there", F.lit(True))
    status = F.when(F.col("_there").isNull(), "missing_row")
    for c in required:
        status = status.when(F.col(c).isNull(), f"missing_{c}")
    return left.join(marked, keys, "left").withColumn("status", status.otherwise("matched")).drop("_there")


def keyed_merge(parts: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union by name in which one row of each key remains, the first of the first part; adds ``n_rows``."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    row = F.struct(*(c for c in union.columns if c not in key))
    ranks = F.struct(F.col("_part"), *order)
    kept = union.groupBy(*key).agg(F.min_by(row, ranks).alias("_row"), F.count(F.lit(1)).alias("n_rows"))
    return kept.select(*key, "_row.*", "n_rows").drop("_part")


def tolerance_first(left: DataFrame, right: DataFrame, on: str, tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of the smallest id whose ``on`` is within ``tolerance``.

    Both sides are put on a grid of that width; a left row looks into its own and both neighbouring
    cells, so the join stays an equi-join. Columns: left id, right id (null without a match).
    """
    cell = F.floor(F.col(on) / tolerance).cast("long")
    a = left.select(F.col(left_id).alias("_l"), F.col(on).alias("_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    b = right.select(F.col(right_id).alias("_r"), F.col(on).alias("_b"), cell.alias("_cell"))
    near = a.join(b, "_cell").where(F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    first = near.groupBy("_l").agg(F.min("_r").alias("_r"))
    out = left.select(F.col(left_id).alias("_l")).join(first, "_l", "left")
    return out.select(F.col("_l").alias(left_id), F.col("_r").alias(f"match_{right_id}"))


def nearest(
    queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 1, metric: str = "dot", block: int = 2048
) -> DataFrame:
    """Exact ``k`` best rows for each query: query_id, id, score (dot product, or negative squared distance).

    Queries are taken in blocks of bounded size; each block is broadcast, scored against every batch of
    rows as one matrix product, and only the ``k`` best of each task are shuffled. Ties: smaller id.
    ``metric``: dot, near (smallest distance) or far (largest distance).
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).where("v is not null")
    n_blocks = (asked.count() + block - 1) // block
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("q"), F.lit(max(1, n_blocks))))  # sizes close to ``block``
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    for i in range(n_blocks):
        part = numbered.where(F.col("_block") == i).select("q", F.col("v").cast("array<double>").alias("v")).collect()  # about ``block`` rows
        shared = spark.sparkContext.broadcast((np.array([r.q for r in part]), np.array([r.v for r in part])))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not len(ids):
                    return
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                own = batch.column(0).to_numpy()
                s = q @ x.T
                if metric != "dot":
                    s = (q * q).sum(1)[:, None] - 2 * s + (x * x).sum(1)[None, :]
                    s = -s if metric == "near" else s
                best.append((s, np.broadcast_to(own, s.shape)))
                s, own = (np.concatenate([b[j] for b in best], axis=1) for j in (0, 1))
                order = np.lexsort((own, -s), axis=1)[:, :k]
                best = [(np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1))]
            if best:
                s, own = best[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, s.shape[1]), pa.int64()), pa.array(own.ravel(), pa.int64()), pa.array(s.ravel(), pa.float64())],
                    ["query_id", "id", "score"],
                )

        out = out.unionByName(source.mapInArrow(run, schema))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def tolerance_anti(left: DataFrame, blocked: DataFrame, key: list[str], dims: list[str], atol: float) -> DataFrame:
    """Left rows that no blocked row of their key equals within ``atol`` in every dimension.

    Both sides lie on a grid of width 2 * atol; a blocked row is put into every cell that its tolerance
    touches (at most two a dimension) and a left row looks into its own, so the join is an equi-join and each
    left row is read once.
    """
    width = 2 * atol
    cells = [f"_cell{i}" for i in range(len(dims))]
    rows = left.withColumns({c: F.floor(F.col(d) / width).cast("long") for c, d in zip(cells, dims, strict=True)})
    touched = blocked.select(*key, *(F.col(d).alias(f"_b{d}") for d in dims)).distinct()
    for c, d in zip(cells, dims, strict=True):
        ends = [F.floor((F.col(f"_b{d}") + s * atol * (1 + 1e-9)) / width).cast("long") for s in (-1, 1)]
        touched = touched.withColumn(c, F.explode(F.array_distinct(F.array(*ends))))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, *cells)]
    near = [F.abs(F.col(f"l.{d}") - F.col(f"b._b{d}")) <= atol for d in dims]
    return rows.alias("l").join(touched.alias("b"), [*on, *near], "left_anti").drop(*cells)


def restored_order(left: DataFrame, right: DataFrame, key: str, right_order: list[Column], left_order: list[Column]) -> DataFrame:
    """Left rows in the order in which their keys first stand in ``right``, the others behind in their own order: adds place."""
    first = positions(right.select(key, F.struct(*right_order).alias("_o")), [], [F.asc("_o")], None, "_at")
    at = written(first.groupBy(key).agg(F.min("_at").alias("_at")), "key-order")
    joined = left.join(at, key, "left").withColumn("_late", F.col("_at").isNull())
    return positions(joined, [], [F.asc("_late"), F.asc("_at"), *left_order], None, "place").drop("_at", "_late")
