"""Ordinals without a window over one group: rows are dealt by ranges of their keys, and ranges are counted before rows are numbered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.session import stored


def numbered(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of the columns `order` within each group of the columns `by`.

    Rows are range-partitioned by (by, order), so a group with many rows lies in many tasks, one after the other. Each task sorts
    and numbers its own rows; how many rows of a group stand in tasks before is a prefix sum over counts, one for each task and group that
    meet. Rows alike in by and order must be the same row, or their numbers may be either's. The dealt rows are written, as
    their ranges must not move between counting and numbering.
    """
    keys = [*by, *order]
    dealt = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part", *by).orderBy(*order)
    # a range is one task's work; its rows of one group are numbered where they lie
    local = dealt.withColumn("_at", F.row_number().over(own).cast("long"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    on = [F.col("_part") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]]
    offsets = offsets.select(F.col("_part").alias("_q"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "_before")
    joined = local.join(offsets, on)
    return joined.select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))
