"""Tables that several queries share, written once per session to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of files, which outlive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What ``make`` gives for this folder, worked out once in a session; ``forget`` if the folder's files change."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _PATHS:
        df = make(spark, sf_dir)
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def forget() -> None:
    _PATHS.clear()
