"""Row numbers 1..n over a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def with_row_number(df: DataFrame, name: str, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition and sort, number inside each partition, then shift every
    partition by the rows before it. The sorted table is written first, so both
    passes see one partitioning; only one count per partition is broadcast."""
    order = list(order)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", in_partition),
        "ranked",
    )
    counts = placed.groupBy("_part").count().orderBy("_part").collect()  # one row per partition
    shifts, before = [], 0
    for row in counts:
        shifts.append((row["_part"], before))
        before += row["count"]
    offsets = spark.createDataFrame(shifts, "_part int, _before bigint")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )
