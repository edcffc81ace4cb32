"""Reading, naming and checkpoint helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binds pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python so many rows at once, where the session says no other number than Spark's own, ten times that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one is made only where none is named and all runs in one process (tests, laptops)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the checkpoint folder: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame) -> None:
    """Empty a table that `stored` gave and nobody reads any more; its files are replaced by one without rows."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends, start, total = [], 0, 0
        for i, size in enumerate(n.tolist()):
            if total and total + size > limit:
                ends.append((start, i))
                start, total = i, 0
            total += size
        ends.append((start, batch.num_rows))
        for a, b in ends:
            yield batch.slice(a, b - a)


def scratch_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names near the wanted ones that no column of df bears (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_rest(doc_id, mod: int):
    """crc32 of the id as text, modulo `mod`; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
