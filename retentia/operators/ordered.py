"""Distributed order-dependent operators: exact ranks and running totals.

A window ordered over a whole table (or partitioned by a two-valued label) runs
in one task. Here rows are range-partitioned on the full order key, so one hot
leading value is split by the keys behind it, and written once to the shared
folder with their partition number. Ranks or sums inside a partition are then
shifted by the totals of all earlier partitions, a table of at most
(partitions x groups) rows that is joined null-safely: rows of a NULL group
are ranked like those of any other group. Lost tasks reread the same file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.session import write_once

ROWS_PER_PART = 500_000


def _ranged(df: DataFrame, keys: list, n_parts: int | None) -> DataFrame:
    """Rows in ordered partitions of about ROWS_PER_PART, numbered ``_pid``."""
    n = n_parts or max(1, -(-df.count() // ROWS_PER_PART))
    return write_once(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()), "ranged")


def _shift(local: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    right = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return local.join(right, same)


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], n_parts: int | None = None,
                rank_col: str = "rank0", size_col: str = "group_n") -> DataFrame:
    """0-based row number of each row inside its group, in ``order_cols`` order,
    plus the group size. Equals ``row_number() over (partition by g order by o)
    - 1`` (with the full order key as tie-break) without a one-task window.
    NULL is a group like any other; an empty table stays empty."""
    parted = _ranged(df, order_cols, n_parts)
    w_local = Window.partitionBy("_pid", *group_cols).orderBy(*[F.col(k).asc() for k in order_cols])
    local = parted.select("*", F.row_number().over(w_local).alias("_lr"))
    counts = parted.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_c"))
    w_prev = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *group_cols,
        F.coalesce(F.sum("_c").over(w_prev), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*group_cols)).alias("_size"))
    out = _shift(local, offsets, ["_pid", *group_cols])
    return out.select(*df.columns, (F.col("_off") + F.col("_lr") - 1).cast("bigint").alias(rank_col),
                      F.col("_size").cast("bigint").alias(size_col))


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = True,
                   n_parts: int | None = None, prefix: str = "cum_", group_cols: list[str] | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` over ``order_col``, within ``group_cols`` if given.

    ``df`` should hold one row per distinct (group, ``order_col``) value
    (pre-aggregate first); the result adds ``cum_<col>`` for each column.
    """
    groups = group_cols or []
    parted = _ranged(df, [*groups, order_col], n_parts)
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_local = Window.partitionBy("_pid", *groups).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    local = parted.select("*", *[F.sum(c).over(w_local).alias(f"_l_{c}") for c in sum_cols])
    totals = parted.groupBy("_pid", *groups).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    bucket_order = F.col("_pid").desc() if descending else F.col("_pid").asc()
    # one row per partition and group
    w_prev = Window.partitionBy(*groups).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *groups, *[F.coalesce(F.sum(f"_t_{c}").over(w_prev), F.lit(0)).alias(f"_o_{c}")
                                               for c in sum_cols])
    out = _shift(local, offsets, ["_pid", *groups])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(prefix + c) for c in sum_cols])
