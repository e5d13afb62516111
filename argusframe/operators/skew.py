"""Joins and orderings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.session import forget, write_down as cut_lineage


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``big`` to ``small``, which has one short row per key.

    Rows of a key in ``big`` are spread over ``salts`` partitions by a hash of
    the whole row and ``small`` is repeated once per salt, so no task gets a
    hot key alone. Where the repeated side turns out small enough, adaptive
    execution broadcasts it instead. ``how``: inner, left or left_semi.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, group: str, order: Sequence[Column | str], number: str = "n",
                ranges: int | None = None, per_group: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group from 1 in the given order, without ever
    bringing a group into one task.

    Rows are range-partitioned by group and order, so a hot group covers many
    partitions in sequence. A row's number is its place within its slice of the
    group plus the sizes of the slices before. Rows are cut off from their
    lineage before and after they move: the sampling pass does not compute them
    again, and sizes and places see the same boundaries even if an executor is
    lost. They are in columns and compressed, and the first copy goes when the second is written.
    ``per_group`` adds columns kept per group.
    """
    spark = df.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Columns of the rows are sorted by as they are; only what is computed is written beside them.
    computed = {f"_order{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    keys = [group, *[c if isinstance(c, str) else f"_order{i}" for i, c in enumerate(order)], "_tie"]
    # Ties are broken by an id that is written down before rows move by it.
    keyed = cut_lineage(df.select("*", *[c.alias(n) for n, c in computed.items()], F.monotonically_increasing_id().alias("_tie")))
    placed = (
        keyed.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .drop(*computed, "_tie")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # The id holds the partition above bit 33 and the place in it below.
    placed = cut_lineage(placed.select(
        *df.columns, F.shiftright("_id", 33).alias("_slice"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    forget(keyed)
    sizes = placed.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "_slice", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    if per_group is not None:
        offsets = offsets.join(per_group, group, "left")
    return (
        placed.join(offsets, [group, "_slice"])
        .withColumn(number, F.col("_place") + F.col("_shift"))
        .drop("_slice", "_place", "_shift")
    )
