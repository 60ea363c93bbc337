"""Helpers shared by the operators of this subpackage: shared-folder tables and word rules."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to Python or comes from it.
BATCH_BYTES = 8 << 20
#: Bytes that separate words: space and \x09-\x0D.
SPACE_BYTES = re.compile(rb"[\x20\x09-\x0D]")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a temporary folder is chosen
    and set as checkpoint folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_barrspark_scratch", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="barrspark-")
        sc._barrspark_scratch = found
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barrspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage in a way that outlives a lost executor, and fixes generated ids.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barrspark_path = path
    return out


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``__row`` that stays the same however often it is read, as it is written once."""
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()), name)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing will read again."""
    path = getattr(df, "_barrspark_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, in the session's setting, as texts have no bounded length.

    A batch is held by the JVM and by Python, several times; a smaller bound in plain bytes stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, A-Z lower-cased, in lists from about ``size`` bytes each."""
    if len(text) <= size:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        found = SPACE_BYTES.search(text, min(at + size, len(text)))
        end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end


def give_back() -> None:
    """Return freed memory of this Python process to the system, as workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
