"""What the training-data operators share: tables, stages in the shared folder, text access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a local master, and an error on a
    cluster, whose executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_file(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file in the shared folder, for tasks that read and write files of their own."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: work is done once and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


_caches: dict[str, Callable[[], None]] = {}


def kept_between_tasks(name: str, clear: Callable[[], None]) -> None:
    """What an operator keeps in a Python worker from task to task; another operator's task in the same worker drops it."""
    _caches[name] = clear


def _free(keep: str | None) -> None:
    """Drop what other operators keep, and give unused memory back to the machine: workers live on beside the next stage's."""
    for name, clear in _caches.items():
        if name != keep:
            clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 6 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut the batches that Arrow brings so that no piece holds over `most` bytes of text (one row at least). `keep` names what the
    operator keeps between tasks."""
    _free(keep)
    for rb in batches:
        sizes = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and held + n > most:
                yield rb.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < rb.num_rows:
            yield rb.slice(begin)
    _free(keep)


def rows_and_text(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One struct `row` of the columns to carry along, whatever their names (all but text by default), and `text`.
    Arrow batches of the session are kept small from here on, for texts may be long and both sides hold a batch outside
    the heap; the setting is read when a job starts, so it cannot be put back here."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    names = columns or [c for c in documents.columns if c != "text"]
    return documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("text"))


def unpacked(documents: DataFrame) -> list[Column]:
    """The columns of documents out of `row` and `text`, in their order."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns]
