"""Ranks and running sums inside groups, without putting a group in one task.

``rank() OVER (PARTITION BY g ORDER BY k)`` sends every row of a group to one
task. A prolific author, a large subject or the whole population (a global
rank) then becomes a single sort. ``ordered_rows`` computes the same numbers
with one plan at every size, in which no task holds more than one range
partition:

1. rows are range-partitioned on (group, order keys, spread keys), so a hot group,
   and with a unique spread key also a mass of ties, spans many partitions in
   order; the partitioned rows are written once, so every later use sees the same
   partition ids and a lost executor re-reads them;
2. a window per (group, partition) gives local ranks and running sums;
3. a table with one row per (group, partition) holds counts, totals and the first and
   last key; a window over the partitions of a group gives each partition's
   offset, and the tie block at either end its start and end over all partitions;
4. rows add their partition's offset; rows of the first or last block take the
   block's start and end instead.

There is no aggregate over peers and no join back on a value: the boundary table
joins on (group, partition), which is how the rows are partitioned already.

``_rank`` is SQL ``rank()`` (ties share, gaps follow), ``_cum_<c>`` the RANGE
UNBOUNDED PRECEDING .. CURRENT ROW sum (peers included) as the window functions
define them, ``_size`` the rows of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import write_once

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sort_col(name: str, ascending: bool) -> Column:
    # window defaults: ascending puts NULL first, descending puts NULL last
    return F.col(name).asc_nulls_first() if ascending else F.col(name).desc_nulls_last()


def _group_keys(df: DataFrame, by: Sequence[str]) -> dict[str, Column]:
    """Nullable group columns as (is-null flag, value or default) pairs, for plain equi-joins."""
    out: dict[str, Column] = {}
    for i, b in enumerate(by):
        dt = df.schema[b].dataType
        default = F.lit("").cast(dt) if isinstance(dt, T.StringType) else F.lit(0).cast(dt)
        out |= {f"_g{i}n": F.col(b).isNull(), f"_g{i}v": F.coalesce(F.col(b), default)}
    return out


def ordered_rows(df: DataFrame, by: Sequence[str], order: Order, sums: Sequence[str] = (), *,
                 spread: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with ``_rank``, ``_size`` and ``_cum_<c>`` within ``by`` ordered by
    ``order``. ``spread``: columns that tell tied rows apart (a unique key), so that
    ties do not meet in one partition; they do not change the result."""
    by = list(by)
    order_cols = [_sort_col(c, a) for c, a in order]
    groups = _group_keys(df, by)
    ranged = df.withColumns(groups) if groups else df
    ranged = ranged.repartitionByRange(
        *[F.col(b).asc_nulls_first() for b in by], *order_cols, *[F.col(c).asc_nulls_first() for c in spread]
    ).withColumn("_pid", F.spark_partition_id())
    ranged = write_once(ranged, "ordered")

    gk = list(groups)
    part = gk + ["_pid"]
    w = Window.partitionBy(*part).orderBy(*order_cols)
    frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({"_lr": F.rank().over(w), **{f"_lc_{s}": F.sum(s).over(frame) for s in sums}})

    key = F.struct(*[F.col(c) for c, _ in order])
    bounds = local.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_lr").alias("_last_lr"),
        F.min_by(key, "_lr").alias("_first"), F.max_by(key, "_lr").alias("_last"),
        *[F.max_by(f"_lc_{s}", "_lr").alias(f"_tot_{s}") for s in sums],
        *[F.min_by(f"_lc_{s}", "_lr").alias(f"_fc_{s}") for s in sums],
    )
    # at most (number of range partitions) rows per group
    w_off = Window.partitionBy(*gk).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w_off), F.lit(0))
    bounds = bounds.withColumns({
        "_off": before("_n"), "_size": F.sum("_n").over(Window.partitionBy(*gk)),
        **{f"_off_{s}": before(f"_tot_{s}") for s in sums},
    })
    # the first and the last tie block of each partition; equal keys of a group are one block
    ends = [
        F.struct(F.lit(0).alias("end"), F.col("_first").alias("key"), F.col("_off").alias("start"),
                 *[(F.col(f"_off_{s}") + F.col(f"_fc_{s}")).alias(f"cum_{s}") for s in sums]),
        F.struct(F.lit(1).alias("end"), F.col("_last").alias("key"), (F.col("_off") + F.col("_last_lr") - 1).alias("start"),
                 *[(F.col(f"_off_{s}") + F.col(f"_tot_{s}")).alias(f"cum_{s}") for s in sums]),
    ]
    keep = [*part, "_off", "_size", "_last_lr", *[f"_off_{s}" for s in sums]]
    block = Window.partitionBy(*gk, "_b.key")
    blocks = bounds.select(*keep, F.explode(F.array(*ends)).alias("_b")).withColumns({
        "_start": F.min("_b.start").over(block),
        **{f"_end_{s}": F.max_by(F.col(f"_b.cum_{s}"), F.struct("_pid", "_b.end")).over(block) for s in sums},
    })
    table = blocks.groupBy(*part).agg(
        *[F.first(c).alias(c) for c in keep if c not in part],
        F.max(F.when(F.col("_b.end") == 0, F.col("_start"))).alias("_first_start"),
        *[F.max(F.when(F.col("_b.end") == 1, F.col(f"_end_{s}"))).alias(f"_last_end_{s}") for s in sums],
    ).withColumnRenamed("_last_lr", "_table_lr")
    out = local.join(table, part)
    cols = {"_rank": F.when(F.col("_lr") == 1, F.col("_first_start") + 1).otherwise(F.col("_off") + F.col("_lr"))}
    for s in sums:
        cols[f"_cum_{s}"] = F.when(F.col("_lr") == F.col("_table_lr"), F.col(f"_last_end_{s}")).otherwise(
            F.col(f"_off_{s}") + F.col(f"_lc_{s}"))
    return out.withColumns(cols).select(*df.columns, "_rank", "_size", *[f"_cum_{s}" for s in sums])


def ordered_prefix(df: DataFrame, by: Sequence[str], order: Order, sums: Sequence[str] = ()) -> DataFrame:
    """One row per distinct (by, order) key with ``_n`` (its rows), ``_rank``, and per
    column c in ``sums`` ``_sum_c`` and ``_cum_c``: a histogram, built map-side first,
    with ranks."""
    keys = [*by, *[c for c, _ in order]]
    peers = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    run = ordered_rows(peers, by, order, ["_n", *[f"_sum_{s}" for s in sums]])
    return run.select(
        *keys, "_n", *[f"_sum_{s}" for s in sums], (F.col("_cum__n") - F.col("_n") + 1).alias("_rank"),
        *[F.col(f"_cum__sum_{s}").alias(f"_cum_{s}") for s in sums])


def rank_rows(df: DataFrame, by: Sequence[str], order: Order, name: str = "rank", *, spread: Sequence[str] = ()) -> DataFrame:
    """Add SQL ``rank()`` over (PARTITION BY by ORDER BY order) to every row."""
    return ordered_rows(df, by, order, spread=spread).withColumnRenamed("_rank", name).drop("_size")
