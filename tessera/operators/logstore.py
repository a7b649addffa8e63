"""The prediction log in a folder that several writers add to at once.

A batch claims a range of ids by a folder named after its first id that says how
many ids it takes; it is made elsewhere and renamed, which only one writer can.  It is written
beside the others, in a folder of its own and in the order of its ids, and counts once Spark has
put its mark of success there; readers take such batches only, so a lost writer
leaves a gap in the ids and nothing else.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import predlog

CLAIMS, BATCHES = "claims", "batches"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _end(fs, at, folder: str, name: str, wait: float) -> int:
    """Last id of a claim; where a rename is no single step, its size may come a moment after its folder."""
    until = time.time() + wait
    while not (sizes := [x for x in _names(fs, at(f"{folder}/{name}")) if not x.startswith(".")]):
        if time.time() > until:
            return int(name) - 1  # it never came to it: nothing was taken
        time.sleep(0.05)
    return int(name) + int(sizes[0]) - 1


def claim(spark: SparkSession, path: str, n: int, wait: float = 5.0) -> int:
    """The first of ``n`` ids that no other batch gets, greater than all claimed before."""
    fs, at = _files(spark, path)
    folder = f"{path.rstrip('/')}/{CLAIMS}"
    fs.mkdirs(at(folder))
    mine = at(f"{folder}/.{uuid.uuid4().hex}")
    fs.mkdirs(mine)
    fs.create(at(f"{mine}/{max(n, 1)}"), False).close()
    while True:
        names = [x for x in _names(fs, at(folder)) if not x.startswith(".")]
        first = _end(fs, at, folder, names[-1], wait) + 1 if names else 1
        target = at(f"{folder}/{first:019d}")
        # A rename to a name that is there moves the folder into it or fails; either way it is not ours.
        if not fs.exists(target) and fs.rename(mine, target):
            inside = at(f"{target}/{mine.getName()}")
            if not fs.exists(inside):
                return first
            fs.rename(inside, mine)
        time.sleep(0.01)


def append(rows: DataFrame, path: str, key: str = "id") -> tuple[int, int]:
    """Adds a batch under ids of the log's own; its first id and its size.  No rows take no ids."""
    n = rows.count()
    if not n:
        return 0, 0
    first = claim(rows.sparkSession, path, n)
    numbered = predlog.numbered(rows, first - 1, key)
    numbered.sortWithinPartitions("model", key).write.parquet(f"{path.rstrip('/')}/{BATCHES}/{first:019d}")
    return first, n


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All rows of finished batches; of an empty log no rows of ``schema``, or an error that names the path."""
    fs, at = _files(spark, path)
    folder = f"{path.rstrip('/')}/{BATCHES}"
    done = [f"{folder}/{x}" for x in _names(fs, at(folder)) if fs.exists(at(f"{folder}/{x}/_SUCCESS"))]
    if done:
        return spark.read.parquet(*done)
    if schema is None:
        raise FileNotFoundError(f"no finished batch in the log at {path}")
    return spark.createDataFrame([], schema)


def unknown(events: DataFrame, log: DataFrame) -> DataFrame:
    """Ids of feedback that the log does not have, and how many events ask for each."""
    return events.join(log.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").cast("long").alias("events"))


def give_feedback(events: DataFrame, log: DataFrame) -> DataFrame:
    """``log`` with its feedback; an error that names some of the ids if the log lacks any."""
    lost = unknown(events, log)
    some = [r["id"] for r in lost.orderBy("id").limit(10).collect()]
    if some:
        raise KeyError(f"feedback on ids that the log does not have, among them {some}")
    return predlog.resolved(log, events)
