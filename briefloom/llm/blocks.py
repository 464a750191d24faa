"""A stated query set against all rows, cell by cell: blocks of rows of bounded size meet groups of queries of bounded size.

Rows are dealt to blocks at random and the deal is written before use, so a repeated task sees the same block, and a
row that occurs a million times spreads like any other. A cell answers for its block; callers merge the answers of
all blocks. The rows are shuffled once per group of queries, the queries once per block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from briefloom.llm.shared import cut_lineage

BLOCK, GROUP = 1 << 20, 1 << 18  # components of the vectors in a block of rows, in a group of queries


def finite(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf)), F.lit(False))


@dataclass
class Dealt:
    """Rows with ``row`` (a number of its own for every row), ``vector`` and ``block``, on disk; ``ask`` marks the queries."""

    rows: DataFrame
    blocks: int
    groups: int
    longest: int  # components of the longest vector
    largest: float  # the largest component's magnitude

    def queries(self) -> DataFrame:
        return self.rows.filter("ask")


def deal(rows: DataFrame, ask: Column, block: int = BLOCK, group: int = GROUP) -> Dealt:
    """Deal the rows (a column ``vector`` without nulls) to blocks; rows where ``ask`` holds are queries, too."""
    marked = rows.withColumn("ask", F.coalesce(ask, F.lit(False)))
    size = F.size("vector").cast("long")
    total = marked.agg(F.coalesce(F.sum(size), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("ask"), size)), F.lit(0)).alias("asked"),
                       F.coalesce(F.max(size), F.lit(0)).alias("longest"),
                       F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))), F.lit(0.0)).alias("largest")).first()
    blocks, groups = max(1, -(-total["all"] // block)), max(1, -(-total["asked"] // group))
    part = lambda n, seed: F.floor(F.rand(seed) * n).cast("int")
    dealt = cut_lineage(marked.withColumns({"row": F.monotonically_increasing_id(), "block": part(blocks, 11), "grp": part(groups, 13)}))
    return Dealt(dealt, blocks, groups, total["longest"], total["largest"])


def cells(dealt: Dealt, asked: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(rows of a block, queries of a group)`` for every block and group that have both; ``asked`` has queries and ``grp``."""
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def cell(block: pa.Table, group: pa.Table) -> pa.Table:
        return run(block, group) if block.num_rows and group.num_rows else none

    left = dealt.rows.drop("ask", "grp").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(dealt.groups - 1))))
    right = asked.drop("ask", "block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dealt.blocks - 1))))
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
    return left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(cell, schema)


def matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """The vectors of a list column, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=kind)
    where = np.repeat(np.arange(len(sizes)), sizes)
    out[where, np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest, largest first, ties in order of position."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")][:k]
