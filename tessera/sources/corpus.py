"""Scans that make the canonical corpus: doc_id, content, label, title, subject."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip_boilerplate, ws_strip

#: Bytes that are hashed at a time.
BLOCK = 1 << 20

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": None, "emptyValue": ""}


def raw_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("title", "text", "subject", "date")) -> DataFrame:
    """All columns as strings, none inferred; bodies may hold newlines and quotes."""
    return spark.read.options(**CSV).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def safe(df: DataFrame, name: str) -> Column:
    """The column with nulls empty, or an empty one where it is missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def canonical(df: DataFrame, label: Column, strip: bool = False, *more: str) -> DataFrame:
    """content (title and body), label, title, body, subject, date, and the columns ``more``; empty content is dropped.

    ``strip`` takes publisher boilerplate out of the content.
    """
    title, body = safe(df, "title"), safe(df, "text")
    content = ws_strip(F.concat(title, F.lit(" "), body))
    out = df.select((strip_boilerplate(content) if strip else content).alias("content"), label.cast("int").alias("label"), ws_strip(title).alias("title"), ws_strip(body).alias("body"), ws_strip(safe(df, "subject")).alias("subject"), ws_strip(safe(df, "date")).alias("date"), *more)
    return out.filter(F.length("content") > 0)


def labelled_files(spark: SparkSession, files: dict[str, int], drop_duplicates: bool = True, strip: bool = False) -> DataFrame:
    """One canonical frame of several CSV files or folders of them, each with its own label.

    ``strip`` takes publisher boilerplate out of the content first.  Of equal
    contents the first row stays, in the order of ``files``, then of file names,
    then of rows, whatever the labels.  Files that are not there are all named
    in one error.
    """
    out, missing = None, []
    for at, (path, label) in enumerate(files.items()):
        try:
            raw = raw_csv(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
            continue
        # A file with line breaks inside fields is read by one task from its start, so ids grow along it.
        placed = raw.withColumn("_place", F.struct(F.lit(at).alias("part"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))
        rows = canonical(placed, F.lit(label), strip, "_place")
        out = rows if out is None else out.unionByName(rows)
    if missing:
        raise FileNotFoundError(f"no such files: {', '.join(missing)}")
    if out is None:
        raise ValueError("no files named")
    if drop_duplicates:
        columns = [c for c in out.columns if c != "_place"]
        first = F.min_by(F.struct(*columns), F.col("_place")).alias("first")
        out = out.groupBy(F.md5(F.col("content").cast("binary")).alias("_h"), F.length("content").alias("_n")).agg(first).select("first.*")
    return out.drop("_place")


def second_corpus(df: DataFrame, aliases=(("title", ("title",)), ("text", ("text", "content")), ("label", ("label", "class", "target"))), sample: int | None = None, seed: int = 42) -> DataFrame:
    """Canonical frame of a table with other column names; labels outside {0, 1} go.

    With ``sample``, that many rows in the order of a seeded hash of their
    content, so that equal tables give equal samples however they are stored;
    all, if there are fewer.
    """
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a] for a in names if a in have), None) for name, names in aliases}
    if not (found["text"] and found["label"]):
        raise ValueError(f"no text or label column among {df.columns}")
    named = df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items() if c])
    value = F.col("label").cast("string").try_cast("double")
    rows = canonical(named.filter(value.isin(0.0, 1.0)), value)
    if sample is None:
        return rows
    return rows.orderBy(F.md5(F.concat_ws("-", "content", F.lit(str(seed))).cast("binary")), "label", "title").limit(sample)


def text_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column to score: the named one, a usual name, or the longest strings."""
    if wanted:
        if wanted not in df.columns:
            raise ValueError(f"no column {wanted}")
        return wanted
    for name in ("content", "text", "article", "body", "title"):
        if name in df.columns:
            return name
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        raise ValueError("no string column")
    means = df.agg(*[F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(c) for c in texts]).first()
    return max(texts, key=lambda c: means[c])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of files by their paths, read a block at a time."""
    for b in batches:
        found = []
        for path in b.column("file").to_pylist():
            fs, place = _place(path)
            digest = hashlib.sha256()
            with fs.open_input_stream(place) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.record_batch([b.column("file"), pa.array(found, pa.string()), b.column("bytes"), b.column("modified")], ["file", "sha256", "bytes", "modified"])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path as Spark writes it, with its special characters as they are."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@"))


def fingerprints(spark: SparkSession, path: str, whole: int = 256 << 20) -> DataFrame:
    """file, sha256, bytes, modified of every file of a path, of any size.

    Files of at most ``whole`` bytes are hashed as one value by Spark.  Larger
    ones are listed without their content and read in blocks of 1 MiB in the
    tasks, a file from end to end in one task as the hash asks for, through the
    file systems that Arrow knows (local, hdfs, s3, gs).  Empty files have no
    row: Spark does not list them.
    """
    listed = spark.read.format("binaryFile").load(path)
    place = [F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    small = listed.filter(F.col("length") <= whole).select(*place, F.sha2("content", 256).alias("sha256"))
    large = listed.filter(F.col("length") > whole).select(*place)
    streamed = large.mapInArrow(_streamed, "file string, sha256 string, bytes long, modified timestamp")
    return small.unionByName(streamed).select("file", "sha256", "bytes", "modified")


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """file and state: new, changed or unchanged since an earlier run."""
    old = before.select("file", F.col("sha256").alias("old"))
    return now.join(old, "file", "left").select("file", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha256"), "changed").otherwise("unchanged").alias("state"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical corpus of the document and label tables: quality is the label, the first line the title."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"), ws_strip(F.substring_index("text", "\n", 1)).alias("title"), F.col("source").alias("subject"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id")
