"""Helpers the corpus operators share: reading a table, the shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.session import cut_lineage, discard, shared_folder  # noqa: F401

BATCH = 8 << 20


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def release() -> None:
    """Give memory that a task no longer needs back to the system; a Python worker outlives its task by a minute."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH`` bytes; a task gives back its memory when its rows are over."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(whole, schema)


def ship_file(spark: SparkSession, stem: str, data: bytes) -> str:
    """Put ``data`` into the shared folder and let Spark copy it once to every executor; returns its name there.

    The name carries the digest of the content, so the same content is shipped once. Inside tasks
    ``pyspark.SparkFiles.get(name)`` is a local path that all workers of an executor can memory-map.
    """
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    context = spark.sparkContext
    if any(os.path.basename(f) == name for f in context.listFiles):
        return name
    folder = shared_folder(spark)
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        place = os.path.join(at.path, "index")
        os.makedirs(place, exist_ok=True)
        whole = os.path.join(place, name)
        part = f"{whole}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, whole)
        context.addFile(whole)
    else:
        jvm = context._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/index/{name}")
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        stream.write(data)
        stream.close()
        context.addFile(path.toString())
    return name


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
