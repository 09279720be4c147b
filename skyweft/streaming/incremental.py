"""Structured Streaming forms of the file-by-file accumulation loops: exposures
or catalog chunks that arrive over time are folded into a running result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import Coadd
from ..operators.coadd import PIXEL, sanitize_weights


def exposure_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_sums(samples: DataFrame, cfg: Coadd = Coadd(), by: tuple[str, ...] = PIXEL) -> DataFrame:
    """Sum of weights and of weight times value per pixel; on a stream the state
    is two doubles per pixel, whatever the number of exposures."""
    clean = sanitize_weights(samples, cfg)
    product = F.when(F.col("wht") == 0.0, 0.0).otherwise(F.col("sci") * F.col("wht"))
    return clean.groupBy(*by).agg(F.sum("wht").alias("sum_w"), F.sum(product).alias("sum_wx"))


def accumulate(samples: DataFrame, target: str, checkpoint: str, cfg: Coadd = Coadd()) -> StreamingQuery:
    """Write the changed pixels of every batch under batch=<id>; readers take the
    newest batch per pixel (``latest_coadd``). Rewriting a batch after a restart
    overwrites its own folder only, so results stay exact."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        running_sums(samples, cfg).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_coadd(spark: SparkSession, target: str, by: tuple[str, ...] = PIXEL) -> DataFrame:
    sums = spark.read.parquet(target).groupBy(*by).agg(
        F.max_by(F.struct("sum_w", "sum_wx"), "batch").alias("_s"))
    w = F.when(F.col("_s.sum_w") > 0.0, F.col("_s.sum_w"))
    return sums.select(*by, (F.col("_s.sum_wx") / w).alias("sci"), F.col("_s.sum_w").alias("wht"))


def append_catalog(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append arriving catalog chunks to one table."""
    return (
        chunks.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
