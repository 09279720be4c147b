"""Exact order statistics and clipped statistics without gathering a group.

Non-finite values are missing values for every statistic here. A group's values
are sorted as one array when the largest group is known to hold at most
``DIRECT`` of them. Beyond that the rank is found by repeated histograms: each
round counts bins on the map side and zooms into the bin that holds the rank, so
no task ever sees more than a histogram or ``SMALL`` values. Both ways look up
the same two neighbours and blend them by one expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RgbStretch
from ..functions import photometry as ph
from ..functions.sky import finite
from ..plans.lineage import cut_lineage, drop_table
from ..plans.skew import salted_join

BINS = 1024
SMALL = 4096
DIRECT = 1_000_000
ALL = "_all"


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Monotone bin index; halves keep the span finite for any doubles."""
    span = hi * 0.5 - lo * 0.5
    return F.least(F.floor(F.try_divide(value * 0.5 - lo * 0.5, span) * BINS), F.lit(BINS - 1))


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based ``rank`` per group. ``ranks`` has the group columns,
    rank, and the group's lo, hi and cnt. NULL values are ignored."""
    by = list(by)
    keys = by or [ALL]
    data = df.select(*by, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    state = ranks
    if not by:
        data, state = data.withColumn(ALL, F.lit(0)), state.withColumn(ALL, F.lit(0))
    state = cut_lineage(state.withColumn("base", F.lit(0).cast("bigint")), "ranks")

    def within(intervals: DataFrame) -> DataFrame:
        inside = F.col("_v").between(F.col("lo"), F.col("hi"))
        return salted_join(data, intervals.select(*keys, "lo", "hi").distinct(), keys, "inner", inside)

    wide = (F.col("lo") < F.col("hi")) & (F.col("cnt") > SMALL)
    before_round = None
    while True:
        active = state.where(wide)
        left = active.agg(F.sum("cnt")).first()[0]
        if left is None:
            break
        if left == before_round:
            raise RuntimeError("histogram bins no longer split")
        before_round = left
        hist = (
            within(active)
            .groupBy(*keys, "lo", "hi", _bin(F.col("_v"), F.col("lo"), F.col("hi")).alias("_bin"))
            .agg(F.count("*").alias("n"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2"))
        )
        upto = W.partitionBy(*keys, "lo", "hi").orderBy("_bin")  # at most BINS rows
        hist = hist.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        at = F.col("rank") - F.col("base")
        zoomed = (
            active.join(hist, [*keys, "lo", "hi"])
            .where((at >= F.col("before")) & (at < F.col("before") + F.col("n")))
            .select(*keys, "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                    F.col("n").alias("cnt"), (F.col("base") + F.col("before")).alias("base"))
        )
        state = cut_lineage(state.where(~wide).unionByName(zoomed, allowMissingColumns=True), "ranks", supersedes=state)

    settled = state.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("value"))
    rest = state.where(F.col("lo") < F.col("hi"))
    gathered = within(rest).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    looked_up = rest.join(gathered, [*keys, "lo", "hi"]).select(
        *keys, "rank", F.get("_vs", (F.col("rank") - F.col("base")).cast("int")).alias("value")
    )
    out = settled.unionByName(looked_up)
    return out if by else out.drop(ALL)


def ranked_values(values: DataFrame) -> tuple[DataFrame, int]:
    """Every different value of ``_v`` once, with its copies ``n`` and how many values
    are ``before`` it, in sorted order; and the number of values. One shuffle and one
    written table, in which any rank is found by a plain scan."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = held + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(upto - n), pa.array(np.full(len(n), part, np.int32))], names=["_v", "n", "_pos", "_part"])
            held = int(upto[-1]) if len(n) else held

    counted = values.groupBy("_v").agg(F.count("*").alias("n")).repartitionByRange(parts, "_v").sortWithinPartitions("_v")
    placed = cut_lineage(counted.mapInArrow(run, "_v double, n bigint, _pos bigint, _part int"), "values")
    shifts, before = [], 0
    for row in placed.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():  # one row per partition
        shifts.append((row["_part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(shifts, "_part int, _before bigint")
    ranked = placed.join(F.broadcast(offsets), "_part").select("_v", "n", (F.col("_pos") + F.col("_before")).alias("before"))
    ranked._written_to = placed._written_to
    return ranked, before


def _holds(rank: int) -> Column:
    return (F.col("before") <= rank) & (F.col("before") + F.col("n") > rank)


def _quantiles_of_ranked(ranked: DataFrame, total: int, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    spots = [float(p) * (total - 1) for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    found = ranked.agg(*[F.max(F.when(_holds(r), F.col("_v"))).alias(f"r{r}") for r in ranks]).first()
    blended = [found[f"r{math.floor(s)}"] + (s - math.floor(s)) * (found[f"r{math.ceil(s)}"] - found[f"r{math.floor(s)}"]) for s in spots]
    return ranked.sparkSession.range(1).select(*[F.lit(b).alias(n) for b, n in zip(blended, names, strict=True)])


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = (),
    direct: int = DIRECT, largest: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles, one column per name (numpy's default).
    ``largest`` bounds the rows of a group where the caller knows it."""
    by = list(by)
    data = df.select(*by, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    if largest is None:
        largest = data.groupBy(*by).agg(F.count("*").alias("cnt")).agg(F.max("cnt")).first()[0] or 0
    if largest <= direct:
        found = data.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_vs")).where(F.size("_vs") > 0)
        spot = [F.lit(float(p)) * (F.size("_vs") - 1) for p in probs]
        at = [[F.get("_vs", r(s).cast("int")) for r in (F.floor, F.ceil)] for s in spot]
        return found.select(*by, *[_blend(s, *v).alias(n) for s, v, n in zip(spot, at, names, strict=True)])
    if not by:
        ranked, total = ranked_values(data)
        if not total:
            return data.groupBy().agg(*[F.max("_v").alias(n) for n in names]).limit(0)
        try:
            return _quantiles_of_ranked(ranked, total, probs, names)
        finally:
            drop_table(ranked)
    return _quantiles_by_rank(data, "_v", probs, names, by)


def _blend(position: Column, below: Column, above: Column) -> Column:
    return below + (position - F.floor(position)) * (above - below)


def _quantiles_by_rank(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], by: list[str]) -> DataFrame:
    stats = df.groupBy(*by).agg(
        F.count(value).alias("cnt"), F.min(F.col(value).cast("double")).alias("lo"),
        F.max(F.col(value).cast("double")).alias("hi"),
    ).where(F.col("cnt") > 0)
    stats = cut_lineage(stats, "extent")
    position = F.lit(list(map(float, probs)))
    spots = stats.select(
        "*", F.posexplode(F.transform(position, lambda p: p * (F.col("cnt") - 1))).alias("_q", "_pos")
    )
    both = F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))
    ranks = spots.select(*by, F.explode(both).alias("rank"), "lo", "hi", "cnt").distinct()
    found = order_statistics(df, value, ranks, by)
    low = found.select(*by, F.col("rank").alias("_r0"), F.col("value").alias("_v0"))
    high = found.select(*by, F.col("rank").alias("_r1"), F.col("value").alias("_v1"))
    spots = spots.withColumns({"_r0": F.floor("_pos"), "_r1": F.ceil("_pos")})
    blend = _blend(F.col("_pos"), F.col("_v0"), F.col("_v1"))
    joined = spots.join(low, [*by, "_r0"]).join(high, [*by, "_r1"]).withColumn("_blend", blend)
    picks = [F.max(F.when(F.col("_q") == i, F.col("_blend"))).alias(n) for i, n in enumerate(names)]
    return joined.groupBy(*by).agg(*picks)


def median(df: DataFrame, value: str, direct: int = DIRECT, largest: int | None = None) -> float | None:
    row = exact_quantiles(df, value, [0.5], ["m"], direct=direct, largest=largest).first()
    return None if row is None else row["m"]


def robust_sigma(df: DataFrame, value: str, direct: int = DIRECT) -> tuple[float, float]:
    """(median, sigma): 1.4826 MAD, or the population deviation when the MAD is
    zero; no spread at all is an error."""
    center = median(df, value, direct)
    if center is None:
        raise ValueError("no values")
    mad = median(df.select(F.abs(F.col(value) - center).alias("d")), "d", direct)
    sigma = 1.4826 * mad
    if sigma <= 0:
        sigma = df.agg(F.stddev_pop(finite(value))).first()[0]
    if not sigma > 0:
        raise ValueError("cannot estimate a non-zero noise sigma")
    return center, sigma


def clipped_stats(df: DataFrame, value: str, sigma: float = 3.0, max_iters: int = 5,
                  direct: int = DIRECT) -> dict[str, float]:
    """Sigma-clipped mean, median and deviation over the whole column. Only a few
    scalars per round pass through the driver; each round is a scan with two
    more literal bounds. Past ``direct`` values the rounds read the sorted table of
    different values, in which the survivors are a range."""
    data = df.select(finite(value).alias(value)).where(F.col(value).isNotNull())
    bounds: list[tuple[float, float]] = []

    def survivors() -> DataFrame:
        out = data
        for lo, hi in bounds:
            out = out.where(F.col(value).between(lo, hi))
        return out

    def measure(at_most: int) -> dict[str, float]:
        parts = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]
        row = survivors().agg(*parts).first()
        return {**row.asDict(), "median": median(survivors(), value, direct, at_most)}

    def measure_ranked(at_most: int) -> dict[str, float]:
        lo, hi = (max(b[0] for b in bounds), min(b[1] for b in bounds)) if bounds else (-math.inf, math.inf)
        inside = ranked.where(F.col("_v").between(lo, hi))
        row = inside.agg(F.sum("n").alias("n"), F.sum(F.col("_v") * F.col("n")).alias("total"), F.min("before").alias("first")).first()
        if not row["n"]:
            return {"n": 0, "mean": None, "std": None, "median": None}
        mean, low, high = row["total"] / row["n"], row["first"] + (row["n"] - 1) // 2, row["first"] + row["n"] // 2
        away = F.col("_v") - F.lit(mean)
        rest = inside.agg(F.sum(away * away * F.col("n")).alias("squares"), *[
            F.max(F.when(_holds(r), F.col("_v"))).alias(c) for r, c in ((low, "low"), (high, "high"))]).first()
        median = rest["low"] + (row["n"] - 1) / 2 % 1 * (rest["high"] - rest["low"])
        return {"n": row["n"], "mean": mean, "std": math.sqrt(rest["squares"] / row["n"]), "median": median}

    rows, ranked = data.count(), None
    if rows > direct:
        ranked, _ = ranked_values(data.withColumnRenamed(value, "_v"))
        measure = measure_ranked
    now = measure(rows)
    for _ in range(max_iters):
        if not now["n"]:
            break
        half = sigma * now["std"]
        bounds.append((now["median"] - half, now["median"] + half))
        before = now["n"]
        now = measure(before)
        if now["n"] == before:
            break
    drop_table(ranked)
    return now


def clipped_stats_by(
    df: DataFrame, value: str, by: Sequence[str], sigma: float = 3.0, max_iters: int = 5, direct: int = DIRECT
) -> DataFrame:
    """The same per group: (by..., n, mean, std, median), one row per group with
    finite values. A round narrows every group's bounds; groups that no longer
    lose values keep theirs."""
    by = list(by)
    data = df.select(*by, finite(value).alias("_v")).where(F.col("_v").isNotNull())

    def measure(kept: DataFrame) -> DataFrame:
        sums = kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
        return cut_lineage(sums.join(exact_quantiles(kept, "_v", [0.5], ["median"], by, direct), by), "clipped")

    now, total, bounds = measure(data), None, None
    for _ in range(max_iters):
        rows = now.agg(F.sum("n")).first()[0]
        if rows is None or rows == total:
            break
        half = F.lit(float(sigma)) * F.col("std")
        new = now.select(*by, (F.col("median") - half).alias("_lo"), (F.col("median") + half).alias("_hi"))
        if bounds is not None:
            old = bounds.select(*by, F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
            new = new.join(old, by).select(*by, F.greatest("_lo", "_a").alias("_lo"), F.least("_hi", "_b").alias("_hi"))
        bounds, total = cut_lineage(new, "bounds", supersedes=bounds), rows
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        now = measure(salted_join(data, bounds, by, "inner", inside).drop("_lo", "_hi"))
    return now


def stretch_channels(
    channels: DataFrame,
    names: Sequence[str],
    p_low: float = 1.0,
    p_high: float = 99.7,
    asinh_a: float = 8.0,
) -> DataFrame:
    """Percentile range per channel, then the asinh stretch, per pixel."""
    names, probs = list(names), [p_low / 100.0, p_high / 100.0]
    rows = channels.count()
    limits = {c: _pair(exact_quantiles(channels, c, probs, ["lo", "hi"], largest=rows).first()) for c in names}
    out = channels
    for c in names:
        lo, hi = limits[c] or (math.nan, math.nan)
        out = out.withColumn(c, ph.asinh_stretch(F.col(c), F.lit(lo), F.lit(hi), asinh_a))
    return out


def _pair(row) -> tuple[float, float] | None:
    return None if row is None else (row["lo"], row["hi"])


def rgb_composite(channels: DataFrame, cfg: RgbStretch = RgbStretch()) -> DataFrame:
    """Stretched, gained, gamma-corrected r, g, b in [0, 1] on one pixel grid."""
    out = stretch_channels(channels, ("r", "g", "b"), cfg.p_low, cfg.p_high, cfg.asinh_a)
    for c, gain in (("r", cfg.r_gain), ("g", cfg.g_gain), ("b", cfg.b_gain)):
        limited = F.least(F.greatest(F.col(c) * gain, F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(c, F.pow(limited, F.lit(cfg.gamma)))
    return out


def rgb_fractions(rgb: DataFrame) -> DataFrame:
    """One row: fraction of saturated and of nearly black pixels."""
    saturated = (F.col("r") >= 0.995) & (F.col("g") >= 0.995) & (F.col("b") >= 0.995)
    gray = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return rgb.agg(
        F.avg(saturated.cast("double")).alias("sat_frac"),
        F.avg((gray < 0.03).cast("double")).alias("near_black_frac"),
    )


def unit_range(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Missing and strongly negative values to 0, then min-max scaling."""
    held = finite(value)
    v = F.when(held.isNull() | (held < -10.0), 0.0).otherwise(held)
    row = pixels.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    return pixels.withColumn(value, F.try_divide(v - F.lit(lo), F.lit(hi) - F.lit(lo)))
