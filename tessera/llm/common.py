"""Helpers that the operators of this subpackage share.

Work folders: intermediate tables go below ``spark.checkpoint.dir``, which a
cluster must point at storage that the driver and all executors see.  Only
where it is unset on one machine (tests) a temporary folder is made for it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def lowest(df: DataFrame, hashed: Column, want: int, rows: int, *ties: str) -> DataFrame:
    """The ``want`` rows of ``df``, which has ``rows`` with distinct keys, of the smallest 64-bit hashes.

    Rows are left out beforehand by a bound that some 4 x want + 1,000 of them
    pass (fewer than ``want`` of so many is out of reach by chance), so what is
    sorted and sent grows with ``want``, not with the number of partitions.
    """
    below = (4 * want + 1000) / max(rows, 1)
    if below < 1:
        df = df.filter(hashed <= F.lit(int(-(2**63) + 2**64 * below)).cast("long"))
    return df.orderBy(hashed, *ties).limit(want)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage beyond files that survive lost executors.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_files(df: DataFrame) -> bool:
    """Whether ``df`` is a table just as a reader of files gives it, whose rows can be told apart by file and place."""
    try:
        place = df.metadataColumn("_metadata")
        df.select(place["file_path"], place["row_index"])
    except AnalysisException:
        return False
    return True


def release(df: DataFrame, path: str) -> None:
    """Empty a table of the shared folder that is no longer read; its schema stays."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; null keys get -1."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % buckets, F.lit(-1))


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null: empty, bad UTF-8 replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: Iterable[int], limit: int, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive items whose sizes stay near ``limit``."""
    start = total = i = 0
    for i, n in enumerate(sizes, 1):
        total += n
        if total >= limit or i - start >= most:
            yield start, i
            start, total = i, 0
    if start < i:
        yield start, i


def slices(column: pa.Array, limit: int = 4_000_000, most: int = 4096) -> Iterator[tuple[int, int, list[str]]]:
    """(a, b, texts of rows [a, b)), about ``limit`` bytes at a time.

    A batch can hold a whole input split; only one slice of it is held as
    Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in chunks(sizes, limit, most):
        yield a, b, strings(column.slice(a, b - a))


def lower_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and the six ASCII
    white-space bytes only, which is that rule; no regex is needed.
    """
    return text.encode("utf-8", "replace").lower().split()
