"""Helpers shared by the operators: tables, folds, the shared folder, chunks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of characters other than ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
_TRIMMED = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether a document is held out; a document without id always is."""
    return F.coalesce(fold(doc_id) == remainder, F.lit(True))


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), _TRIMMED, "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


_OWN: dict[str, str] = {}  # temporary folder of each local application


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the session has to name.

    Only a session whose executors are threads of the driver may do without; it
    gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="gradeframe-")
        folder = _OWN[application]
    return folder.rstrip("/")


def give_back() -> None:
    """Hand freed memory back to the system: Python workers wait between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def thrifty(function: Callable) -> Callable:
    """A function of one or two columns or tables for workers that gives back what it used, call by call."""
    def done(out):
        give_back()
        return out

    # Spark counts the arguments.
    if function.__code__.co_argcount == 1:
        return functools.wraps(function)(lambda one: done(function(one)))
    return functools.wraps(function)(lambda one, two: done(function(one, two)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back, which cuts its lineage.

    The files outlive the query: the folder's owner clears it, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
