"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09-\x0D. bytes.split() without arguments splits on exactly these.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within the one all executors share, which is spark.checkpoint.dir as the cluster names it. A
    local one takes its place only where it is unset and the driver runs all tasks itself, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/charloom-{spark.sparkContext.applicationId}"


_libc = None


def lean() -> None:
    """Has this Python worker give memory back as soon as it is free: Arrow allocates by malloc, and blocks from 4 MB on are
    maps of their own, so what one task held isn't there when the next one runs. Workers are reused, hence once per process."""
    global _libc
    if _libc is None:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL(None)
            _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            _libc.mallopt(-8, 1)  # M_ARENA_MAX
        except (OSError, AttributeError):  # another C library
            _libc = False


def trim() -> None:
    """Returns what malloc has kept; called as a task ends."""
    if _libc:
        _libc.malloc_trim(0)


def save(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    path = getattr(df, "_saved_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns needed, under fixed names, whatever else the table has; a null text is empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, work: Callable[[], Callable[..., Iterable[tuple]]], schema: str, every: int = 2000) -> DataFrame:
    """mapInArrow with rows as tuples. work() runs once in a task and gives the function of a row that yields its output rows;
    at most `every` output rows are held before they are handed on."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        each = work()
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(each(*row))
                    if len(out) >= every:
                        yield _batch(out, fields)
                        out = []
        if hasattr(each, "finish"):
            out.extend(each.finish())
        if out:
            yield _batch(out, fields)
        del each, out
        trim()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
