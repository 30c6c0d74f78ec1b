"""Tables written to the folder that all executors share, to cut lineage and to fix a partitioning."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most rows and bytes that go to a Python worker at once; blocks and contents are long rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1500", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and everything runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "stratarc-shared")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and read back; Python batches of its plan are bounded, and the session's own settings come back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratarc-{name}-{uuid.uuid4().hex[:12]}"
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
