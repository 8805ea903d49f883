"""Tables that are written once and read several times."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local master without one gets a folder of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="velotrace-core-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/velotrace-core/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that its several readers do not compute it again."""
    path = scratch_path(df.sparkSession, name)
    void = [c for c, kind in df.dtypes if kind == "void"]  # parquet has no such type
    df = df.withColumns({c: F.lit(None).cast("string") for c in void})
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).withColumns({c: F.lit(None) for c in void})
