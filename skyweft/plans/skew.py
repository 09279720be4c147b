"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut_lineage

# A key is hot when one side has more rows of it than this, or when its pairs
# exceed this many rows times PAIRS_PER_ROW.
HOT_ROWS = 1_000_000
PAIRS_PER_ROW = 100


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, growth: int = 1) -> bool:
    """Whether the estimate, times a bound on rows added by explode, is under
    the session's broadcast limit."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) * growth <= conf.autoBroadcastJoinThreshold()


def rows_fit_broadcast(spark: SparkSession, rows: int, row_bytes: int = 100) -> bool:
    """The same check from an exact row count, for sides whose explode factor
    depends on the data and which Catalyst therefore underestimates."""
    return rows * row_bytes <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, other: DataFrame | None = None) -> DataFrame:
    """Hot keys and the number of salts each gets, judged by the rows of ``df``
    and, with ``other``, by the pairs they make. The list has at most one entry
    per ``hot_rows`` rows or per so many pairs; it is never cut."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    salts = F.col("_n") / hot_rows
    if other is not None:
        pairs = other.groupBy(*keys).agg(F.count("*").alias("_m"))
        counts = counts.join(pairs, list(keys), "left")
        salts = F.greatest(salts, F.least(F.col("_n"), F.col("_n") * F.coalesce("_m", F.lit(0)) / (hot_rows * PAIRS_PER_ROW)))
    return counts.where(salts > 1).select(*keys, F.ceil(salts).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    condition: Column | None = None,
    hot_side: str = "left",
    hot_rows: int = HOT_ROWS,
    growth: int = 1,
    cold_rows: int | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Equi-join on ``keys`` with an optional residual ``condition``.

    When the cold side is under the broadcast limit the join needs no shuffle
    and no salt. Otherwise rows of hot keys are spread over salts on
    ``hot_side`` and the other side is replicated to the same salts.
    ``keys`` must exist on both sides; in the result they come from the left.
    With ``hot_side="right"`` and a semi join, the left rows of hot keys are
    replicated, so the caller must de-duplicate. ``growth`` bounds the rows an
    explode adds to the cold side; ``cold_rows`` is its exact size when known.
    ``spread_by`` names the row key of the hot side that is hashed into the
    salt; without it all columns are hashed, which also makes the scan read
    them all. (A row number would not be stable when a task is repeated.)

    Rows with a NULL key match nothing: they are set aside before the shuffle
    and, in anti and left joins, come back untouched. The list of hot keys is
    written once, so both sides see the same salts.
    """
    keys = list(keys)
    cold = right if hot_side == "left" else left
    if how in ("left_anti", "left", "left_outer") and hot_side == "right":
        raise ValueError("replicating the left side changes outer and anti joins")
    if cold_rows is None:
        small = fits_broadcast(cold, growth)
    else:
        small = rows_fit_broadcast(cold.sparkSession, cold_rows)
    if small:
        return _join(left, right, keys, how, condition)

    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    unmatched = left.where(~keyed) if how in ("left_anti", "left", "left_outer") else None
    left, right = left.where(keyed), right.where(keyed)
    hot, other = (left, right) if hot_side == "left" else (right, left)
    listed = cut_lineage(hot_keys(hot, keys, hot_rows, other), "hot-keys")

    def spread(df: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by or df.columns]), F.col("_salts").cast("bigint"))
        return (
            df.join(listed, keys, "left")
            .withColumn("_salt", F.coalesce(salt.cast("int"), F.lit(0)))
            .drop("_salts")
        )

    def replicate(df: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        return df.join(listed, keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")

    if hot_side == "left":
        left, right = spread(left), replicate(right)
    else:
        left, right = replicate(left), spread(right)
    # The size check failed, so Catalyst must not broadcast on its own estimate.
    out = _join(left.hint("merge"), right.hint("merge"), [*keys, "_salt"], how, condition).drop("_salt")
    return out if unmatched is None else out.unionByName(unmatched, allowMissingColumns=True)


def _join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, condition: Column | None
) -> DataFrame:
    renamed = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = [F.col(k) == F.col(r) for k, r in renamed.items()]
    if condition is not None:
        on.append(condition)
    joined = left.join(right, on, how)
    return joined.drop(*renamed.values())
