"""Small helpers shared by the corpus operators: shared storage, inputs, and Arrow batches cut to a byte budget."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python task, in UTF-8 bytes; arrays derived from it are 20 to 40 times as large.
CHUNK_BYTES = 1_000_000
#: Bytes of an Arrow batch between the JVM and Python, which both hold; Spark's own bound is 64 MB.
BATCH_BYTES = 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and
    the master is local, so that there is one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a stage table; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stage table that no later step reads."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """A text column as Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts come to about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(column).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        yield batch.slice(start)


def shards(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in runs whose texts come to at most ``limit`` bytes; a longer text is a run of its own. Runs go across the
    batches, so that only the rows and their order decide where one ends, not the settings of Arrow."""
    rows: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        start = 0
        for i, size in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()):
            if held and held + (size or 0) > limit:
                rows.append(batch.slice(start, i - start))
                yield pa.concat_batches(rows)
                rows, held, start = [], 0, i
            held += size or 0
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if rows:
        yield pa.concat_batches(rows)


def mapped(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(work, schema), in batches of BATCH_BYTES unless the session sets a bound itself. Spark has no such setting
    for a single DataFrame, so it stays in the session. Results do not depend on it, nor on the number of rows of a batch: what
    a batch holds is either worked on row by row, or gathered to runs of rows (``shards``)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def aside(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list]:
    """docs as (id, text, x0, x1, ..), names that cannot clash, and the columns that restore it."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    short = {id_col: "id", text_col: "text"} | {c: f"x{i}" for i, c in enumerate(others)}
    renamed = docs.select(*(F.col(f"`{c}`").cast("string" if c == text_col else docs.schema[c].dataType).alias(n) for c, n in short.items()))
    return renamed, [F.col(short[c]).alias(c) for c in docs.columns]


def kinds_of(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def packed(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column: each row's ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate(([0], np.cumsum(lengths) * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
