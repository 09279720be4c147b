"""Cut lineage by writing a table to the shared checkpoint folder.

A written Parquet table survives executor loss, computes its input once (a
``checkpoint()`` computes it twice unless cached) and gives Catalyst real sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skyweft-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def cut_lineage(df: DataFrame, label: str, supersedes: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table. ``supersedes``
    is an earlier result of this function that nothing reads any more once the
    new table is there, such as the last round of a loop; its files go."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_table(supersedes)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete the files behind a result of ``cut_lineage``."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)
